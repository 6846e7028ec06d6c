"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmem.llm.util import lean
from corpusmem.llm.vocab import Encoder, whole_tokens


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row: tokens of the whole text as the tokenizers library counts them.

    Vocabulary strings proven to be one token alone count 1 wherever they are a pre-token; only other pre-tokens are
    merged, each distinct one once. Null texts count as empty (0 bytes, 0 tokens); repeated rows give repeated results;
    null ids stay null; other columns are not read, so clashing names do no harm. There is no shuffle: texts are read
    once where they lie. A very long text is cut into pre-tokens like any other.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    @lean
    def run(batches):
        encoder = Encoder(path, whole.value, words=False)
        for b in batches:
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            n = [pa.array(counts, pa.int64()) for _, counts, _ in encoder.batches(b.column(1), want_ids=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.concat_arrays(n) if n else pa.array([], pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
