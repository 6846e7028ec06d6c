"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmem.llm.util import extended, lean, slices, utf8

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Training uses at most about this many labelled rows of each language, chosen by a hash of the id.
SAMPLE_PER_LANG = 4_000
#: Longer texts are counted in slices of so many characters, and scored by their counts.
SLICE = 100_000
#: A model of more labels than this is refused: its matrix is broadcast, 64 Ki doubles a label.
MAX_LABELS = 256
_U = np.uint32


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, a space on either side."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)


def _grams(codes: np.ndarray, last: bool = True) -> np.ndarray:
    """Buckets of all character n-grams that begin in codes; not the last: only those that begin before its last 3."""
    longest = max(SIZES)
    out, h = [], np.zeros(len(codes), np.uint32)
    for k in range(longest):
        m = len(codes) - k
        if m <= 0:
            break
        h = (h[:m] ^ codes[k:]) * _U(0x85EBCA6B)
        h = h ^ (h >> _U(15))
        if k + 1 in SIZES:
            g = (h + _U(k * 0x9E3779B1 & 0xFFFFFFFF)) * _U(0xC2B2AE35)
            g = (g ^ (g >> _U(16))) & _U(BUCKETS - 1)
            out.append(g if last else g[: len(codes) - longest + 1])
    return np.concatenate(out)


def gram_counts(text: str) -> np.ndarray:
    """Counts of all buckets of a text, in slices: memory doesn't follow its length beyond that of its code points."""
    codes, sums = _codes(text), np.zeros(BUCKETS, np.int64)
    for a in range(0, len(codes), SLICE):
        b = a + SLICE + max(SIZES) - 1
        sums += np.bincount(_grams(codes[a:b], b >= len(codes)), minlength=BUCKETS)
        if b >= len(codes):
            break
    return sums


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Log-probabilities of buckets by language: langs in code point order, matrix BUCKETS x langs, prior."""

    langs: list[str]
    matrix: np.ndarray
    prior: np.ndarray


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fits the model on rows with a text that has a letter and a non-null language.

    A language with more than `per_lang` rows is thinned to about that many by a hash of the id, a documented bound of
    the labelled sample; the sampled texts are used whole. Counts are summed on the executors and shuffled as (language,
    bucket, count); the driver receives at most BUCKETS rows a language.
    No labelled row: a model without languages, which predicts `und`.
    """
    rows = rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and t is not null")
    totals = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(totals) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct languages")
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    unit = F.pmod(F.xxhash64(F.lit("lang_id"), F.col("i").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for l in langs for x in (F.lit(l), F.lit(min(1.0, per_lang / totals[l])))])
    sample = rows.where(unit < share[F.col("l")]).select("l", "t")
    index = {l: i for i, l in enumerate(langs)}

    @lean
    def count(batches):
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    sums[index[l]] += gram_counts(t)
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums[at], pa.int64())], ["l", "b", "n"])

    got = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(langs)), 0.5)
    counts[got["b"].to_numpy(), got["l"].to_numpy()] += got["n"].to_numpy()
    prior = np.array([totals[l] for l in langs], float)
    return Model(langs, np.log(counts / counts.sum(0)), np.log(prior / prior.sum()))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text, scored as one sparse batch: (documents x buckets, CSR) times the matrix."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return langs, scores
    rows, parts, sizes, held = [], [], [], 0

    def flush() -> None:
        if rows:
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = np.add.reduceat(model.matrix[np.concatenate(parts)], starts, axis=0) + model.prior
            p = np.exp(sums - sums.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for i, k, s in zip(rows, best, p[np.arange(len(rows)), best], strict=True):
                langs[i], scores[i] = model.langs[k], s
            rows.clear(), parts.clear(), sizes.clear()

    for i, t in enumerate(texts):
        if not has_letter(t):
            continue
        if len(t) > SLICE:
            sums = gram_counts(t) @ model.matrix + model.prior
            best = int(sums.argmax())
            langs[i], scores[i] = model.langs[best], 1 / np.exp(sums - sums[best]).sum()
            continue
        g = _grams(_codes(t))
        if held + len(g) > 500_000:
            flush()
            held = 0
        rows.append(i), parts.append(g), sizes.append(len(g))
        held += len(g)
    flush()
    return langs, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs' columns with the predicted language and its posterior appended; only the text is an input of the prediction.

    A null text or one without a letter gives `und` with score 0. Ties go to the first language in code point order.
    `into` names the two columns; a column of docs with one of these names is an error. The matrix is broadcast; its
    size is bounded by MAX_LABELS. Repeated rows give repeated results.
    """
    if clash := set(into) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; name others by `into`")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [*docs.columns, *into]

    @lean
    def run(batches):
        for b in batches:
            column, langs, scores = b.column(at), [], [np.zeros(0)]
            for i, j in slices(utf8(column)[1]):
                some = score_texts(shared.value, column.slice(i, j - i).to_pylist())
                langs += some[0]
                scores.append(some[1])
            scores = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return docs.mapInArrow(run, extended(docs.schema, **{into[0]: "string", into[1]: "double"}))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the labelled rows outside the held-out fold and predicts every row: (id, held_out, lang_pred, score)."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return predict(rows, model, "__text").drop("__text")
