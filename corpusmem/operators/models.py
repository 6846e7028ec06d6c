"""Model answers as data: parsing, the summary hook, query variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmem.functions.text import summary, token_set, trim

ENTRY = "struct<title:string,summary:string,keywords:array<string>>"
#: Characters of a chunk that a model is given, and keywords kept of its answer.
PROMPT_CHARS, KEYWORDS = 6000, 8


def json_slice(answer: Column, opening: str) -> Column:
    """The JSON text inside an answer: without a code fence, from the first bracket to the last that closes it.

    Null unless the first bracket is `opening` ('{' or '[').
    """
    text = trim(F.coalesce(answer, F.lit("")))
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    text = F.when(text.rlike(r"(?is)```(?:json)?\s*.*?```"), trim(fenced)).otherwise(text)
    closing = "}" if opening == "{" else "]"
    rest = F.substr(text, F.nullif(F.regexp_instr(text, F.lit(r"[\[{]")), F.lit(0)))
    end = F.length(rest) - F.instr(F.reverse(rest), closing) + 1
    return F.when((F.substring(rest, 1, 1) == opening) & (F.instr(rest, closing) > 0), F.substr(rest, F.lit(1), end))


def parse_entry(answer: Column) -> Column:
    """struct(title, summary, keywords) of an answer, null if it is no JSON object."""
    return F.from_json(json_slice(answer, "{"), ENTRY)


def parse_list(answer: Column) -> Column:
    """array<string> of an answer, null if it is no JSON array."""
    return F.from_json(json_slice(answer, "["), "array<string>")


def entries_with_answers(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """Document entries with model answers (id, answer) in place of extractive ones where an answer has a summary."""
    parsed = answers.select("id", parse_entry(F.col("answer")).alias("a"))
    good = trim(F.coalesce("a.summary", F.lit(""))) != ""
    words = F.slice(F.filter(F.coalesce("a.keywords", F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != "")), 1, KEYWORDS)
    title = trim(F.coalesce("a.title", F.lit("")))
    out = entries.join(parsed, "id", "left")
    return (
        out.withColumn("keywords", F.when(good & (F.size(words) > 0), words).otherwise(F.col("keywords")))
        .withColumn("title", F.when(good & (title != ""), title).otherwise(F.col("title")))
        .withColumn("summary", F.when(good, summary(F.col("a.summary"))).otherwise(F.col("summary")))
        .select(entries.columns)
    )


def ask(entries: DataFrame, model: Callable[[list[str]], list[str | None]], parallelism: int | None = None) -> DataFrame:
    """(id, answer): model is called with batches of chunk texts on the executors; a failing batch gives nulls."""
    rows = entries.select("id", F.substring("text", 1, PROMPT_CHARS).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                got = model(b["text"].tolist())
            except Exception:  # a model's failure means the extractive entry
                got = [None] * len(b)
            yield pd.DataFrame({"id": b["id"], "answer": got})

    return (rows.repartition(parallelism) if parallelism else rows).mapInPandas(run, "id string, answer string")


def answer_key(prompt_version: str, text: Column) -> Column:
    """What names an answer: the hash of the prompt's version and the whole chunk, wherever the chunk stands."""
    return F.sha2(F.concat(F.lit(prompt_version + "\n"), text).cast("binary"), 256)


def usable(answer: Column) -> Column:
    """Whether an answer is a JSON object with a summary; others are failures, to be asked again."""
    return F.coalesce(trim(parse_entry(answer)["summary"]) != "", F.lit(False))


def expand(queries: DataFrame, answers: DataFrame | None, count: int = 6) -> DataFrame:
    """(query_id, variant, text): the first variants of a model's answer (query_id, answer), else the query itself."""
    if answers is None:
        return queries.select("query_id", F.lit(0).alias("variant"), "text")
    parsed = answers.select("query_id", F.slice(F.filter(parse_list(F.col("answer")), lambda v: trim(F.coalesce(v, F.lit(""))) != ""), 1, count).alias("v"))
    found = queries.join(parsed, "query_id", "left")
    return found.select("query_id", F.posexplode(F.when(F.size("v") > 0, F.col("v")).otherwise(F.array("text"))).alias("variant", "text"))


def title_keywords(title: Column) -> Column:
    return F.slice(token_set(title), 1, 5)
