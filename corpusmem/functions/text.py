"""Text scalars as column expressions: tokens, trimming, summaries, field texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmem.config import CJK, WS, WS_CHARS


def trim(text: Column) -> Column:
    """Strips white space of any script at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Bag of tokens: runs of [a-z0-9_] of the lower-cased text, then each CJK run as overlapping pairs (alone: itself)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pairs = lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2))))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    cjk = F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0))
    return F.concat(latin, F.flatten(F.transform(cjk, pairs)))


def token_set(text: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(tokens(text))


def summary(text: Column, limit: int = 300) -> Column:
    """White space collapsed; a text over the limit is cut after its last full stop beyond 40 %, else with an ellipsis.

    A summary is decided by the text's first characters: the rest is only read if those are nearly all white space.
    """
    flat = lambda t: trim(F.regexp_replace(t, F.lit(WS + "+"), F.lit(" ")))
    last = lambda head, back, c: F.when(F.instr(back, c) > 0, F.length(head) - F.instr(back, c)).otherwise(-1)

    def cut(head: Column) -> Column:
        stop = _let(F.reverse(head), lambda back: F.greatest(last(head, back, "。"), last(head, back, "."), last(head, back, ";")))
        return _let(stop, lambda at: F.when(at > (limit - 1) * 0.4, F.substr(head, F.lit(1), at + 1)).otherwise(F.concat(head, F.lit("…"))))

    shown = lambda f: F.when(F.length(f) <= limit, f).otherwise(_let(F.substring(f, 1, limit - 1), cut))
    some, whole = flat(F.substring(F.coalesce(text, F.lit("")), 1, 4 * limit)), flat(F.coalesce(text, F.lit("")))
    return _let(_let(some, lambda f: F.when(F.length(f) > limit, f).otherwise(whole)), shown)


def truncate(text: Column, limit: int) -> Column:
    """At most `limit` characters, with a note where a text was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(f"\n\n...[truncated at {limit} chars]"))).otherwise(text)


def _or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def entry_text(title="title", keywords="keywords", summary_="summary", path="source_path") -> Column:
    """The searched text of an entry: its title five times, keywords, summary and path."""
    words = F.array_join(F.coalesce(F.col(keywords), F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", *[_or_empty(title)] * 5, words, _or_empty(summary_), _or_empty(path))


def note_text(problem="problem", solution="solution", source="source_file") -> Column:
    """The searched text of a note: its problem three times, solution and source."""
    return F.concat_ws(" ", *[_or_empty(problem)] * 3, _or_empty(solution), _or_empty(source))


def mangled(path: Column) -> Column:
    """A path as the stem of entry ids."""
    return F.regexp_replace(path, F.lit(rf"[\\/:]|{WS}"), F.lit("_"))
