"""Documents to chunks and entries: sections, blocks, caps; pages and text spans to documents."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmem.config import WS, WS_CHARS
from corpusmem.functions.text import _let, mangled, summary, token_set, trim

_HEADING = r"\A[^\S\n]*#{1,6}[^\S\n]"


def _with_sections(docs: DataFrame, key: str, text: str, most: int = 0) -> DataFrame:
    """(key, s): the sections of each text in order, an array of (section, title, line, body); blank ones go.

    A heading starts a section, a preamble is one without title. A text is cut into lines once, the places of headings
    are picked from them, and each section is a slice of the lines: linear in the text, and without a shuffle. Lines and
    places are columns of their own, so that nothing is cut twice. most: only so many sections are made (0: all).
    """
    plain = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    heading = lambda line: F.contains(line, F.lit("#")) & line.rlike(_HEADING)
    rows = docs.select(key, F.split(plain, "\n").alias("__lines"))
    at = F.array_compact(F.transform("__lines", lambda line, i: F.when((i == 0) | heading(line), i)))
    rows = rows.select(key, "__lines", (F.slice(at, 1, most + 2) if most else at).alias("__at"))

    def section(first: Column, k: Column) -> Column:
        line, end = F.get("__lines", first), F.coalesce(F.get("__at", k + 1), F.size("__lines"))
        title = F.when(heading(line), trim(F.regexp_replace(line, F.lit(rf"\A{WS}*#{{1,6}}{WS}*"), F.lit("")))).otherwise("")
        body = trim(F.array_join(F.slice("__lines", first + 1, end - first), "\n"))
        return F.struct(k.alias("section"), title.alias("title"), (first + 1).alias("line"), body.alias("body"))

    # one more place than asked says where the last section ends
    starts = F.slice("__at", 1, most + 1) if most else F.col("__at")
    return rows.select(key, F.filter(F.transform(starts, section), lambda s: s["body"] != "").alias("s"))


def sections(docs: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, section, title, line, body): see _with_sections.

    An outer generator, since for an inner one Spark infers a filter on the array, and moves it with all that makes the
    array below the columns that were made once.
    """
    return _with_sections(docs, key, text).select(key, F.inline_outer("s")).where("body is not null")


def cuts(text: str, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of a long text's chunks, white space at their ends left out.

    A chunk ends at the last blank line within the limit, or else the last space, or else at the limit; breaks in its
    first half don't count. The places of all breaks are found once.
    """
    breaks = [[m.start() for m in re.finditer(p, text)] for p in ("(?=\n\n)", " ")]
    solid = re.compile(rf"[^{re.escape(WS_CHARS)}]")
    end_of = re.compile(rf"[{re.escape(WS_CHARS)}]*\Z")
    begin = 0
    while len(text) - begin > limit:
        found = (places[i] for places in breaks if (i := bisect_right(places, begin + limit) - 1) >= 0)
        end = next((at for at in found if at - begin >= limit / 2), begin + limit)
        stop = begin + len(text[begin:end].rstrip(WS_CHARS))
        if stop > begin:
            yield begin, stop
        onward = solid.search(text, end)
        begin = onward.start() if onward else len(text)
    if begin < len(text):
        yield begin, end_of.search(text, begin).start()


def split_block(block: str, line: int, chunk_chars: int, max_chunks: int) -> list[dict]:
    """The chunks of a long block with their first lines; a break between chunks counts as one line.

    The definition in Python, with which tests compare the column of chunks()."""
    out = []
    for begin, end in islice(cuts(block, chunk_chars), max_chunks + 1):
        out.append({"text": block[begin:end], "line": line})
        line += block.count("\n", begin, end) + 1
    return out


def _split(body: Column, line: Column, limit: int, most: int) -> Column:
    """split_block as a column: array of (text, line), `most` at most. Texts stay in the engine, a row at a time."""
    last = lambda window, what: F.when(F.instr(window, what) > 0, F.length(window) - F.instr(F.reverse(window), what) + 1 - len(what)).otherwise(-1)
    chars = F.lit(WS_CHARS)

    def end(window: Column) -> Column:
        blank, space = last(window, "\n\n"), last(F.substring(window, 1, limit + 1), " ")
        return F.when(blank >= limit / 2, blank).otherwise(_let(space, lambda at: F.when(at >= limit / 2, at).otherwise(limit)))

    def cut(rest: Column) -> Column:
        parts = lambda at: F.struct(F.rtrim(F.substr(rest, F.lit(1), at), chars).alias("text"), F.ltrim(F.substr(rest, at + 1), chars).alias("rest"))
        whole = F.struct(rest.alias("text"), F.lit("").alias("rest"))
        return F.when(F.length(rest) > limit, _let(_let(F.substring(rest, 1, limit + 2), end), parts)).otherwise(whole)

    def step(state: Column, _: Column) -> Column:
        lines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        more = lambda p: F.struct(p["rest"].alias("rest"), (state["line"] + lines(p["text"])).alias("line"), F.concat(state["out"], F.array(F.struct(p["text"].alias("text"), state["line"].alias("line")))).alias("out"))
        return F.when(state["rest"] == "", state).otherwise(_let(cut(state["rest"]), more))

    none = F.array().cast("array<struct<text:string,line:int>>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(body.alias("rest"), line.alias("line"), none.alias("out")), step, lambda state: state["out"])


def chunks(docs: DataFrame, chunk_chars: int = 3000, max_chunks: int = 40, key: str = "path", text: str = "text") -> DataFrame:
    """(key, chunk, title, text, line): the first max_chunks chunks of each document; sizes below 1 mean the defaults.

    Sections and chunks are numbered within the document's row, so there is no shuffle, and no batch of texts is held.
    Repeated rows are documents of their own.
    """
    chunk_chars, max_chunks = (int(v) if v and v >= 1 else d for v, d in ((chunk_chars, 3000), (max_chunks, 40)))
    whole = lambda s: F.array(F.struct(s["body"].alias("text"), s["line"].alias("line")))
    blocks = lambda s: F.when(F.length(s["body"]) > chunk_chars, _split(s["body"], s["line"], chunk_chars, max_chunks)).otherwise(whole(s))
    titled = lambda s: F.transform(blocks(s), lambda c: F.struct(s["title"].alias("title"), c["text"].alias("text"), c["line"].alias("line")))
    rows = _with_sections(docs, key, text, max_chunks)
    # an outer generator: see sections
    rows = rows.select(key, F.posexplode_outer(F.slice(F.flatten(F.transform("s", titled)), 1, max_chunks)).alias("chunk", "c")).where("chunk is not null")
    return rows.select(key, "chunk", F.col("c.title").alias("title"), F.col("c.text").alias("text"), F.col("c.line").alias("line"))


def doc_entries(chunked: DataFrame, key: str = "path") -> DataFrame:
    """Entries of chunks without a model: the section's title or the path, an extractive summary, title words as keywords."""
    path = F.col(key).cast("string")
    titled = F.col("title") != ""
    return chunked.select(
        path.alias("path"), F.col("chunk").alias("seq"), F.concat(mangled(path), F.lit("#"), F.col("chunk").cast("string")).alias("id"), F.lit("doc").alias("type"),
        F.when(titled, F.col("title")).otherwise(path).alias("title"), summary(F.col("text")).alias("summary"), F.slice(token_set(F.col("title")), 1, 5).alias("keywords"),
        path.alias("source_path"), F.col("line").alias("source_line"), "text",
    )


def assemble_pages(pages: DataFrame, key: str | tuple[str, ...] = "doc_id", selection: Column | None = None, max_pages: int = 1000) -> DataFrame:
    """(key, n_pages, text, error): pages in order under page headings (one page: alone); too many or none is an error.

    Pages of a document beyond max_pages are counted, never gathered.
    """
    key = [key] if isinstance(key, str) else list(key)
    total = pages.groupBy(*key).agg(F.count("*").alias("total"))
    chosen = pages.where(selection) if selection is not None else pages
    chosen = chosen.join(total.where(F.col("total") <= max_pages).select(key), key, "left_semi")
    parts = chosen.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    heading = lambda x: F.concat(F.lit("## Page "), x["page"].cast("string"), F.lit("\n\n"), F.coalesce(x["text"], F.lit("")))
    text = F.when(F.size("p") > 1, F.array_join(F.transform("p", heading), "\n\n")).otherwise(F.coalesce(F.col("p")[0]["text"], F.lit("")))
    error = F.when(F.col("total") > max_pages, "too many pages").when(F.col("p").isNull(), "no pages selected")
    out = total.join(parts, key, "left").select(*key, F.coalesce(F.size("p"), F.lit(0)).cast("long").alias("n_pages"), text.alias("text"), error.alias("error"))
    return out.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


def span_lines(spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(keys, line_no, line): consecutive text items within 2 units of height of the one before form one line."""
    order = W.partitionBy(*keys).orderBy("item_no")
    rows = spans.where(trim(F.coalesce("str", F.lit(""))) != "")
    apart = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) >= 2, F.lit(False))
    rows = rows.withColumn("line_no", F.sum(apart.cast("long")).over(order))
    items = rows.groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(F.struct("item_no", "str"))).alias("i"))
    glue = lambda acc, x: F.when(acc.isNull(), x["str"]).otherwise(F.concat(acc, F.when(acc.endswith(" "), "").otherwise(" "), x["str"]))
    return items.select(*keys, "line_no", F.aggregate("i", F.lit(None).cast("string"), glue).alias("line"))


def page_text(lines: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Lines of a page joined."""
    parts = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return parts.select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def layout_stats(pages: DataFrame, key: str = "doc_id", sample: int = 5) -> DataFrame:
    """(key, total_chars, avg_images): characters of all pages, images per page over the first few."""
    nth = F.row_number().over(W.partitionBy(key).orderBy("page"))
    rows = pages.withColumn("nth", nth)
    return rows.groupBy(key).agg(F.sum(F.length("text")).cast("long").alias("total_chars"), F.avg(F.when(F.col("nth") <= sample, F.col("image_count"))).alias("avg_images"))
