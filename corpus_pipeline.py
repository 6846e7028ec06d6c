"""The training-data pipeline: each stage takes the documents its predecessor kept and returns documents.

Stages are (name, function); a function takes (spark, docs, sf_dir). The last stage returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmem.llm import fair_mix, jaccard_join, lang_id, packing, rlbwt_dedup
from corpusmem.llm.queries import tokenizer_path
from corpusmem.llm.util import small_batches, stored

#: A document whose language has a lower posterior is rejected.
MIN_SCORE = 0.5

#: SQL can't express the language model, the index or the packing.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language: rejects null texts, texts without a letter and undecided ones.

    lang becomes the predicted language. The model is trained on the labelled rows of its own input, all folds; without
    labelled rows nothing has a language. Repeated rows fare alike; other columns stay, whatever their names.
    """
    small_batches(spark)
    found = lang_id.predict(docs, lang_id.train(docs), into=("__lang", "__score"))
    kept = found.where((F.col("__lang") != "und") & (F.col("__score") >= MIN_SCORE))
    return kept.withColumn("lang", F.col("__lang").cast(docs.schema["lang"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8 stays, the one with the least id.

    Null ids and texts without a word stay; rows that repeat the id that stays are kept as they are.
    """
    return jaccard_join.keep_one(docs, threshold=(80, 100), size=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a document with a smaller id has; all documents stay, n_chars follows.

    Null texts become empty; rows with one id don't repeat each other; other columns stay, whatever their names.
    """
    cut = rlbwt_dedup.mark_repeats(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")), cut_texts=True)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, up to twice each, by the mix; a document taken twice is two rows. Texts without a word go."""
    return fair_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row a piece. A document taken twice is packed twice."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeats), ("mixing", mixing), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
