"""Registered queries of the library's own operators: shapes derived from the given tables, and SQL that says the same.

Derivations are SQL that Spark and DuckDB both read ({documents} names a table), so both sides start from equal rows.
Entries are made by the library's chunker instead; their SQL has the same chunks from a recursion.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmem.config import CJK, WS
from corpusmem.functions import text as fn
from corpusmem.operators import chunk, links, models, notes, rank, symbols
from corpusmem.plans import index, jobs, postings
from corpusmem.plans.scratch import shared_dir, stored
from corpusmem.sources import files
from corpusmem.streaming import observe

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_O: dict[str, str] = {}


class Made(NamedTuple):
    """A source that DataFrame operations make of derivations; `sql` has the same rows for DuckDB."""

    make: Callable[..., DataFrame]
    sources: tuple[str, ...]
    sql: str


def _rows(spark: SparkSession, sf_dir: str, sql: str | Made) -> DataFrame:
    if isinstance(sql, Made):
        return sql.make(*[_rows(spark, sf_dir, s) for s in sql.sources])
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def _duck(sql: str | Made) -> str:
    if isinstance(sql, Made):
        return sql.sql
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("{{", "{")


def _query(name: str, oracle: str | None, *sources: str | Made):
    """Registers f(*DataFrames of sources) under a name; the oracle reads the sources as {0}, {1}, ..."""

    def wrap(f):
        _Q[name] = lambda spark, sf_dir: f(*[_rows(spark, sf_dir, s) for s in sources])
        if oracle is not None:
            _O[name] = re.sub(r"\{(\d)\}", lambda m: "(" + _duck(sources[int(m[1])]) + ")", oracle)
        return f

    return wrap


# --- derivations -------------------------------------------------------------------------------------------------
V = "cast({} as varchar(20))".format
DOCS = "select " + V("doc_id") + " as path, text from {documents}"
HEADED = "select " + V("doc_id") + " as path, '# Intro' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || '## ') as text from {documents}"
PARAGRAPHS = "select " + V("doc_id") + " as path, replace(text, chr(10), chr(10) || chr(10)) as text from {documents}"
CJK_TEXT = "select " + V("doc_id") + " as id, translate(text, 'abcdefgh', '中文索引记忆检录') as text from {documents}"
TREE = "select 'org' || " + V("doc_id % 5") + " || '/p' || " + V("doc_id % 17") + " || '/src/m' || " + V("doc_id % 3") + " || '/f' || " + V("doc_id") + " || '.md' as path from {documents}"
NAMES = "replace(p_name, ' ', '_') || '_' || " + V("p_partkey")
CODE = (
    "select 'src/f' || " + V("p_partkey") + " || case p_partkey % 8 when 0 then '.py' when 1 then '.js' when 2 then '.go' when 3 then '.rs' when 4 then '.java' when 5 then '.sh' when 6 then '.rb' else '.ts' end as path, "
    "'# head' || chr(10) || chr(10) || case p_partkey % 8 when 0 then 'def ' || nm || '(x):' when 1 then 'export function ' || nm || '() {{' when 2 then 'func (r *T) ' || nm || '(a int) {{' when 3 then 'pub struct ' || nm || ' {{' "
    "when 4 then '  public static int ' || nm || '(int a) {{' when 5 then nm || '() {{' when 6 then 'def ' || nm else 'const ' || nm || ' = async (a) => {{' end || ' // note' || chr(10) || 'return x;' || chr(13) || chr(10) || case p_partkey % 8 when 0 then 'class C' || nm || ':' when 2 then 'type ' || nm || ' struct {{' when 3 then 'pub(crate) async fn ' || nm || '() {{' when 4 then 'else if (a) {{' else 'class ' || nm || ' {{' end as text "
    "from (select p_partkey, " + NAMES + " as nm from {part}) t"
)
LISTING = "select 'p' || " + V("doc_id % 3") + " as project, 'd/f' || " + V("doc_id") + " || case doc_id % 4 when 0 then '.py' when 1 then '.TXT' when 2 then '.md' else '.bin' end as path, text, n_chars as size from {documents}"
HASHED = LISTING.replace("text, n_chars", "text, sha2_256 as sha256, n_chars")
BANNER = "select doc_id, case doc_id % 4 when 0 then '=== A loaded: X, Version=1.0.0.0' || chr(10) || '== TYPE x ' || text when 1 then '====' || chr(10) || text when 2 then '=== B' || chr(10) || ' Version=1.2.3.4 ' || text else text end as text from {documents}"
NOTES = (
    "select 'p' || " + V("u.conv_id % 4") + " as project, 'n' || " + V("u.conv_id * 100 + u.turn") + " as id, u.conv_id * 100 + u.turn as seq, u.text as problem, a.text as solution, "
    "case when u.conv_id % 3 = 0 then 'src/' || " + V("u.conv_id") + " || '.py' end as source_file, u.conv_id as day from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant' where u.role = 'user'"
)
SYMBOLS = (
    "select 's' || " + V("item_id") + " as id, 'symbol' as type, name || ' (function)' as title, 'function ' || name as summary, split(name || ' function', ' ') as keywords, 'src/a.py' as source_path, cast(item_id + 1 as int) as source_line "
    "from (select item_id, lower(regexp_extract(text, '^[A-Za-z]+ ([A-Za-z]+)', 1)) as name from {benchmark}) b"
)
ASKED = "select item_id as query_id, 0 as variant, text from {benchmark}"
# the second variant is the whole text of the next item: one that held the first, or was part of it, would decide every maximum
VARIANTS = ASKED + " union all select a.item_id, 1, b.text from {benchmark} a join {benchmark} b on b.item_id = a.item_id + 1"
EVENTS = "select 'f' || " + V("user_id") + " as path, event_type as sha, ts as observed_at, event_id as seq, case when event_id % 5 = 0 then 'absent' else 'present' end as kind from {events}"

# --- SQL of the shared functions ---------------------------------------------------------------------------------


def _toks(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    pairs = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END"
    return f"list_concat(regexp_extract_all({low}, '[a-z0-9_]+'), flatten(list_transform(regexp_extract_all({low}, '{CJK}+'), lambda r: {pairs})))"


def _distinct(x: str) -> str:
    """Distinct members in order of first occurrence."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\A{WS}+', ''), '{WS}+\\z', '')"


def _summary(x: str) -> str:
    flat = _trim(f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")
    stop = "greatest(" + ", ".join(f"CASE WHEN instr(reverse(h), '{c}') > 0 THEN length(h) - instr(reverse(h), '{c}') ELSE -1 END" for c in "。.;") + ")"
    return f"(SELECT CASE WHEN length(f) <= 300 THEN f WHEN {stop} > 119.6 THEN substr(h, 1, {stop} + 1) ELSE h || '…' END FROM (SELECT f, substr(f, 1, 299) AS h FROM (SELECT {flat} AS f)))"


_SECTIONS = f"""
l AS (SELECT path, generate_subscripts(a, 1) AS pos, unnest(a) AS ln FROM (SELECT path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM {{0}})),
h AS (SELECT *, sum(CASE WHEN regexp_matches(ln, '^\\s*#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS sec FROM l),
s0 AS (SELECT path, sec, min(pos) AS line, first(ln ORDER BY pos) AS head, {_trim("string_agg(ln, chr(10) ORDER BY pos)")} AS body FROM h GROUP BY path, sec),
s AS (SELECT path, line, CASE WHEN sec > 0 THEN {_trim("regexp_replace(head, '^\\s*#{1,6}\\s*', '')")} ELSE '' END AS title, body FROM s0 WHERE body <> '')
"""


def _chunks_sql(chars: int, most: int) -> str:
    at = f"CASE WHEN p1 >= {chars} * 0.5 THEN p1 WHEN p2 >= {chars} * 0.5 THEN p2 ELSE {chars} END"
    return f"""WITH RECURSIVE {_SECTIONS},
r AS (SELECT path, line AS sec, title, 0 AS k, body AS block, line AS ln, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS BIGINT) AS at_line FROM s
 UNION ALL SELECT path, sec, title, k + 1, CASE WHEN length(block) > {chars} THEN {_trim("substr(block, cut + 1)")} ELSE '' END,
   ln + CASE WHEN length(block) > {chars} THEN length(p) - length(replace(p, chr(10), '')) + 1 ELSE 0 END, CASE WHEN length(block) > {chars} THEN p ELSE block END, ln
 FROM (SELECT *, {_trim("substr(block, 1, cut)")} AS p FROM (SELECT *, {at} AS cut FROM (SELECT *,
   CASE WHEN instr(reverse(substr(block, 1, {chars} + 2)), chr(10) || chr(10)) > 0 THEN length(substr(block, 1, {chars} + 2)) - instr(reverse(substr(block, 1, {chars} + 2)), chr(10) || chr(10)) - 1 ELSE -1 END AS p1,
   CASE WHEN instr(reverse(substr(block, 1, {chars} + 1)), ' ') > 0 THEN length(substr(block, 1, {chars} + 1)) - instr(reverse(substr(block, 1, {chars} + 1)), ' ') ELSE -1 END AS p2
   FROM r WHERE block <> '')))),
c AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY sec, k) - 1 AS chunk, title, part AS text, at_line AS line FROM r WHERE part <> '')
SELECT * FROM c WHERE chunk < {most}"""


def _chunk_entries(docs: DataFrame, symbols_: DataFrame) -> DataFrame:
    return chunk.doc_entries(chunk.chunks(docs)).select(symbols_.columns).unionByName(symbols_)


_CHUNK_ENTRIES = (
    f"SELECT path || '#' || chunk AS id, 'doc' AS type, CASE WHEN title <> '' THEN title ELSE path END AS title, {_summary('text')} AS summary, list_slice({_distinct(_toks('title'))}, 1, 5) AS keywords, path AS source_path, CAST(line AS INT) AS source_line "
    f"FROM ({_chunks_sql(3000, 40).replace('{0}', '(' + _duck(DOCS) + ')')}) UNION ALL {_duck(SYMBOLS)}"
)
CHUNK_ENTRIES = Made(_chunk_entries, (DOCS, SYMBOLS), _CHUNK_ENTRIES)


def _declared(ln: str, ext: str) -> tuple[str, str]:
    """CASE expressions of a declaration's name and kind, from the rule table."""
    name, kind = "CASE", "CASE"
    for lang, rules in symbols.RULES.items():
        of = f"{ext} IN ({', '.join(repr(e) for e in symbols.LANGUAGES[lang])})" if lang in symbols.LANGUAGES else "true"
        n = k = "CASE"
        for r in rules:
            p = r.pattern.replace("'", "''")
            test = f"WHEN regexp_matches({ln}, '{p}') THEN "
            value = f"regexp_extract({ln}, '{p}', {r.groups[0]})" if r.groups else f"'{r.name}'"
            if r.groups == (2,):
                value = f"CASE WHEN regexp_extract({ln}, '{p}', 1) NOT IN ({', '.join(map(repr, symbols.CONTROL))}) THEN {value} END"
            n += f" {test}{value}"
            k += f" {test}" + (f"CASE WHEN contains({ln}, 'impl') THEN 'impl' ELSE 'type' END" if lang == "rust" and r.kind == "type" else f"'{r.kind}'")
        name += f" WHEN {of} THEN {n} END"
        kind += f" WHEN {of} THEN {k} END"
    return name + " END", kind + " END"


_EXT = r"regexp_extract(lower(path), '(\.[^./]*)\z', 1)"
_NAME, _KIND = _declared("line", "ext")
_LINES = f"""l AS (SELECT path, {_EXT} AS ext, CAST(generate_subscripts(a, 1) AS INT) AS line_no, unnest(a) AS raw FROM (SELECT path, string_split_regex(text, '\\r?\\n') AS a FROM {{0}})),
b AS (SELECT *, {_trim("regexp_replace(regexp_replace(raw, '//.*$', ''), '#.*$', '')")} AS line FROM l),
n AS (SELECT * FROM b WHERE line <> '')"""
_SYMBOLS = f"""WITH {_LINES}, d AS (SELECT *, {_NAME} AS name, {_KIND} AS kind FROM n),
m AS (SELECT *, regexp_replace(path, '[\\\\/:\\s]', '_', 'g') || '#' || line_no AS id FROM d WHERE name IS NOT NULL)"""


def _bm25(rows: str, queries: str, pools: str = "true") -> str:
    """s: (query_id, variant, pool, id, score); rows have (pool, id, txt), queries (query_id, variant, text)."""
    return f"""e AS (SELECT pool, id, {_toks("txt")} AS tk FROM ({rows}) WHERE {pools}),
p AS (SELECT pool, id, t AS term, count(*) AS tf FROM (SELECT pool, id, unnest(tk) AS t FROM e) GROUP BY ALL),
z AS (SELECT pool, id, len(tk) AS n, count(*) OVER (PARTITION BY pool) AS c, avg(len(tk)) OVER (PARTITION BY pool) AS a FROM e),
f AS (SELECT pool, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT DISTINCT query_id, variant, unnest({_toks("text")}) AS term FROM ({queries})),
s AS (SELECT query_id, variant, p.pool, p.id, sum(ln(1 + (z.c - f.df + 0.5) / (f.df + 0.5)) * (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * greatest(z.n, 1) / z.a))) AS score
      FROM q JOIN p USING (term) JOIN f ON f.pool = p.pool AND f.term = p.term JOIN z ON z.pool = p.pool AND z.id = p.id GROUP BY ALL HAVING score > 0),
m AS (SELECT query_id, pool, id, max(score) AS score FROM s GROUP BY ALL),
k AS (SELECT query_id, pool, CAST(row_number() OVER w AS INT) AS rank, id, round(score, 6) AS score, CAST(round(100 * score / max(score) OVER (PARTITION BY query_id, pool)) AS INT) AS rel_score
      FROM m WINDOW w AS (PARTITION BY query_id, pool ORDER BY round(score, 6) DESC, id))"""


_ENTRY_TEXT = "concat_ws(' ', title, title, title, title, title, array_to_string(keywords, ' '), summary, source_path)"
_ENTRY_ROWS = f"SELECT 'all' AS pool, id, {_ENTRY_TEXT} AS txt FROM {{1}}"
_NOTE_TEXT = "concat_ws(' ', problem, problem, problem, solution, coalesce(source_file, ''))"

# --- sources -----------------------------------------------------------------------------------------------------
ODD_TREE = "select 'org' || " + V("doc_id % 5") + " || case doc_id % 7 when 0 then '/vendor' when 1 then '/.git' when 2 then '/obj' when 3 then '/_priv' else '/src' end || case when doc_id % 11 = 0 then '/.f' else '/f' end || " + V("doc_id") + " || '.md' as path from {documents}"
_IGNORED = ", ".join(map(repr, files.IGNORED))


@_query("s1_tree_filter", f"SELECT path FROM {{0}} WHERE len(list_filter(string_split(path, '/'), lambda p: starts_with(p, '.'))) = 0 AND len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda p: p IN ({_IGNORED}))) = 0", ODD_TREE)
def _(paths):
    return paths.where(files.listed(F.col("path")))


@_query("s2_extension_routing", f"SELECT path, CASE WHEN {_EXT} IN ({', '.join(map(repr, files.DOCUMENTS))}) THEN 'doc' WHEN {_EXT} IN ({', '.join(map(repr, files.CODE))}) THEN 'code' END AS kind FROM {{0}}", LISTING)
def _(rows):
    return rows.select("path", files.kind(F.col("path")).alias("kind"))


@_query("s3_size_cap", "SELECT path, size, sha256(text) AS sha256, text FROM {0} WHERE size <= 3145", LISTING)
def _(rows):
    return files.read_texts(rows.withColumn("content", F.col("text").cast("binary")), 0.003)


@_query("s4_rejected", "SELECT path, CASE WHEN path = '' THEN 'file_path must be a non-empty string' WHEN size IS NULL THEN 'not readable' ELSE 'too large' END AS reason FROM {0} WHERE path = '' OR size IS NULL OR size > 3145", "select case when doc_id % 9 = 0 then '' else 'f' || " + V("doc_id") + " end as path, case when doc_id % 7 <> 0 then n_chars end as size from {documents}")
def _(rows):
    return files.rejected(rows, 0.003)


@_query("s5_content_hash", "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM {0}", "select doc_id, text from {documents}")
def _(rows):
    content = F.col("text").cast("binary")
    return rows.select("doc_id", F.sha2(content, 256).alias("sha256"), F.length(content).cast("long").alias("size"))


@_query("s6_store_key", "SELECT path, lower(substr(path, 6)) AS key FROM {0}", "select '/org/' || case doc_id % 2 when 0 then 'Docs/' else 'a/' end || 'F' || " + V("doc_id") + " || '.MD' as path from {documents}")
def _(rows):
    return rows.select("path", files.store_key(F.col("path"), "/org", case_insensitive=True).alias("key"))


LISTED = LISTING + " where doc_id % 13 <> 0"
MANIFEST = (LISTING + " where doc_id % 11 <> 0").replace("text, n_chars", "case when doc_id % 7 = 0 then text || 'x' else text end as text, n_chars")
_PLAN = f"""a AS (SELECT *, sha256(text) AS sha, CASE WHEN {_EXT} IN ('.txt', '.md') THEN 'doc' WHEN {_EXT} = '.py' THEN 'code' END AS kind FROM {{0}}),
m AS (SELECT *, sha256(text) AS sha, CASE WHEN {_EXT} IN ('.txt', '.md') THEN 'doc' WHEN {_EXT} = '.py' THEN 'code' END AS kind FROM {{1}}),
pl AS (SELECT coalesce(a.project, m.project) AS project, coalesce(a.path, m.path) AS path, coalesce(a.kind, m.kind) AS kind,
       CASE WHEN a.path IS NULL THEN 'removed' WHEN a.size > 10485 THEN 'oversize' WHEN a.sha = m.sha THEN 'unchanged' WHEN m.path IS NULL THEN 'new' ELSE 'changed' END AS status
       FROM (SELECT * FROM a WHERE kind IS NOT NULL) a FULL JOIN (SELECT * FROM m WHERE kind IS NOT NULL) m ON a.project = m.project AND a.path = m.path)"""


def _manifest(rows: DataFrame) -> DataFrame:
    return rows.select("project", "path", F.sha2("text", 256).alias("sha256"), "size", files.kind(F.col("path")).alias("kind"), F.lit("2024-01-01").cast("timestamp").alias("indexed_at")).where("kind is not null")


def _plan(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    return index.change_plan(listing.withColumn("sha256", F.sha2("text", 256)), _manifest(manifest), 0.01)


@_query("s7_change_plan", f"WITH {_PLAN} SELECT * FROM pl", LISTED, MANIFEST)
def _(listing, manifest):
    return _plan(listing, manifest).select("project", "path", "kind", "status")


@_query("s8_report", f"WITH {_PLAN} SELECT project, count(*) FILTER (WHERE status IN ('new', 'changed') AND kind = 'doc') AS docs, count(*) FILTER (WHERE status IN ('new', 'changed') AND kind = 'code') AS code, count(*) FILTER (WHERE status IN ('unchanged', 'oversize', 'dump')) AS skipped, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'failed') AS n_failed FROM pl GROUP BY project", LISTED, MANIFEST)
def _(listing, manifest):
    return index.report(_plan(listing, manifest)).drop("failed")


@_query("s9_dump_detection", r"SELECT doc_id, regexp_matches(substr(text, 1, 4096), '\A\s*={3,}') AND regexp_matches(substr(text, 1, 4096), '==\s*TYPE\s|\bVersion=\d+\.\d+\.\d+\.\d+|loaded:\s*\S+,\s*Version=') AS dump FROM {0}", BANNER)
def _(rows):
    return rows.select("doc_id", files.is_dump(F.col("text")).alias("dump"))


@_query("s10_single_index", f"WITH {_PLAN} SELECT * FROM pl WHERE path IN (SELECT path FROM {{2}})", LISTED, MANIFEST, "select 'd/f' || " + V("doc_id") + " || '.md' as path from {documents}")
def _(listing, manifest, asked):
    return index.index_single(listing.withColumn("sha256", F.sha2("text", 256)), _manifest(manifest), asked, 0.01).select("project", "path", "kind", "status")


@_query("s11_upsert", "SELECT project, path, sha256(text) AS id FROM {1} x WHERE NOT EXISTS (SELECT 1 FROM {0} y WHERE y.project = x.project AND y.path = x.path AND size % 2 = 0) UNION ALL SELECT project, path, sha256(text) FROM {0} WHERE size % 2 = 0", LISTED, MANIFEST)
def _(listing, manifest):
    entry = lambda df: df.select("project", "path", F.sha2("text", 256).alias("id"))
    touched = listing.where("size % 2 = 0")
    return index.upsert(entry(manifest), entry(touched), touched)


@_query("s12_all_entries", "SELECT id, type, title, summary FROM {0}", CHUNK_ENTRIES)
def _(entries):
    return index.flatten(entries, kinds=("doc", "symbol")).select("id", "type", "title", "summary")


@_query("s13_inventory", "SELECT coalesce(f.project, n.project) AS project, coalesce(files, 0) AS files, coalesce(entries, 0) AS entries, coalesce(notes, 0) AS notes FROM (SELECT project, count(*) FILTER (WHERE lower(path) NOT LIKE '%.bin') AS files, count(*) AS entries FROM {0} GROUP BY 1) f FULL JOIN (SELECT project, count(*) AS notes FROM {1} GROUP BY 1) n ON f.project = n.project", LISTING, NOTES)
def _(listing, kept):
    return index.inventory(_manifest(listing), listing, kept).drop("indexed_at")


MARKS = (
    "select distinct 'org' || " + V("doc_id % 5") + " || '/p' || " + V("doc_id % 17") + " || case when doc_id % 17 % 4 = 0 then '/package.json' when doc_id % 2 = 0 then '/README.md' else '/src' end as path, doc_id % 17 % 4 <> 0 and doc_id % 2 <> 0 as is_dir from {documents} "
    "union all select 'org0/.git', true"
)


@_query(
    "s14_project_roots",
    """WITH l AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, is_dir FROM {1}),
    f AS (SELECT dir, bool_or(name = '.git') AS strong, bool_or(name = 'package.json') AS weak, count(*) FILTER (WHERE is_dir AND name = 'src') AS k, bool_or(lower(name) LIKE 'readme%' AND NOT is_dir) AS readme FROM l GROUP BY dir),
    a AS (SELECT path, d AS depth, array_to_string(list_slice(p, 1, len(p) - d), '/') AS dir FROM (SELECT path, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS p FROM {0}), LATERAL (SELECT unnest(range(0, len(p))) AS d)),
    j AS (SELECT path, depth, a.dir, strong, weak AND depth < 8 AS weak, depth < 8 AND (k >= 2 OR (readme AND k >= 1)) AS looks FROM a LEFT JOIN f USING (dir))
    SELECT path, coalesce(min_by(dir, depth) FILTER (WHERE strong), min_by(dir, depth) FILTER (WHERE weak), max_by(dir, depth) FILTER (WHERE looks), min_by(dir, depth)) AS root FROM j GROUP BY path""",
    TREE, MARKS,
)
def _(paths, marks):
    return files.project_roots(paths, marks)


@_query("s15_code_first", f"SELECT CAST(row_number() OVER (PARTITION BY project ORDER BY CASE WHEN {_EXT} = '.py' THEN 0 ELSE 1 END, seq) AS INT) AS rank, project, path FROM {{0}}", LISTING.replace("n_chars as size", "doc_id as seq"))
def _(rows):
    return files.code_first(rows)


# --- documents ---------------------------------------------------------------------------------------------------
@_query("d1_sections", f"WITH {_SECTIONS} SELECT path, title, CAST(line AS INT) AS line, body FROM s", HEADED)
def _(docs):
    return chunk.sections(docs).drop("section")


@_query("d2_blocks", _chunks_sql(500, 40), PARAGRAPHS)
def _(docs):
    return chunk.chunks(docs, 500, 40)


@_query("d3_chunk_cap", _chunks_sql(200, 5), HEADED)
def _(docs):
    return chunk.chunks(docs, 200, 5)


@_query("d4_summary", f"SELECT path, {_summary('text')} AS summary FROM {{0}}", DOCS)
def _(docs):
    return docs.select("path", fn.summary(F.col("text")).alias("summary"))


@_query("d5_doc_entries", f"SELECT path || '#' || chunk AS id, CASE WHEN title <> '' THEN title ELSE path END AS title, {_summary('text')} AS summary, array_to_string(list_slice({_distinct(_toks('title'))}, 1, 5), ' ') AS keywords, CAST(line AS INT) AS source_line FROM ({_chunks_sql(3000, 40)})", HEADED)
def _(docs):
    return chunk.doc_entries(chunk.chunks(docs)).select("id", "title", "summary", F.array_join("keywords", " ").alias("keywords"), "source_line")


# answers to the first chunk of each document: a whole one, one without title and keywords, a list, and none
ANSWERS = "select " + V("doc_id") + " || '#0' as id, case doc_id % 4 when 0 then '```json' || chr(10) || '{\"title\": \"T' || " + V("doc_id") + " || '\", \"summary\": \"about ' || lang || '.\", \"keywords\": [\"k1\", \"' || source || '\"]}' || chr(10) || '```' when 1 then 'Sure: {\"summary\": \"only ' || source || '\", \"keywords\": []} done' when 2 then '[\"a\", \"b ' || lang || '\"]' else 'no json' end as answer from {documents}"
ANSWERS = ANSWERS.replace('{"', "\x02").replace('"}', '"\x03').replace("]}", "]\x03")


def _braces(sql: str) -> str:
    """JSON braces in a derivation, written through chr() so that they aren't taken for table names."""
    return sql.replace("\x02", "' || chr(123) || '\"").replace("\x03", "' || chr(125) || '")


ANSWERS = _braces(ANSWERS)


@_query("d6_model_entries", "SELECT e.id, CASE WHEN n % 4 = 0 THEN 'T' || n ELSE title END AS title, CASE n % 4 WHEN 0 THEN 'about ' || lang || '.' WHEN 1 THEN 'only ' || source ELSE summary END AS summary, CASE WHEN n % 4 = 0 THEN 'k1 ' || source ELSE array_to_string(keywords, ' ') END AS keywords FROM (SELECT * FROM {0} WHERE type = 'doc') e LEFT JOIN (SELECT doc_id AS n, doc_id || '#0' AS id, lang, source FROM documents) d ON d.id = e.id", CHUNK_ENTRIES, ANSWERS)
def _(entries, answers):
    got = models.entries_with_answers(entries.where("type = 'doc'"), answers)
    return got.select("id", "title", "summary", F.array_join("keywords", " ").alias("keywords"))


@_query("d7_model_answers", "SELECT doc_id || '#0' AS id, CASE WHEN doc_id % 4 = 0 THEN 'T' || doc_id END AS title, CASE doc_id % 4 WHEN 0 THEN 'about ' || lang || '.' WHEN 1 THEN 'only ' || source END AS summary, CASE WHEN doc_id % 4 = 2 THEN 'a|b ' || lang END AS list FROM documents", ANSWERS)
def _(answers):
    a = models.parse_entry(F.col("answer"))
    return answers.select("id", a["title"].alias("title"), a["summary"].alias("summary"), F.array_join(models.parse_list(F.col("answer")), "|").alias("list"))


PAGES = "select conv_id as doc_id, turn + 1 as page, text, turn % 3 as image_count from {conversations}"


@_query("d8_page_assembly", "SELECT doc_id, count(*) AS n_pages, CASE WHEN count(*) > 1 THEN string_agg('## Page ' || page || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page) ELSE first(text) END AS text, CAST(NULL AS VARCHAR) AS error FROM {0} GROUP BY doc_id", PAGES)
def _(pages):
    return chunk.assemble_pages(pages)


SPANS = "select conv_id as doc_id, turn as page, text from {conversations}"


def _spans(rows: DataFrame) -> DataFrame:
    words = rows.select("doc_id", "page", F.posexplode(F.filter(F.split("text", "[ \n]"), lambda w: w != "")).alias("item_no", "str"))
    return words.withColumn("y", (F.floor(F.col("item_no") / 7) * 10 + F.col("item_no") % 2).cast("double"))


@_query("d9_span_lines", "SELECT doc_id, page, CAST(floor(i / 7) AS BIGINT) AS line_no, string_agg(w, ' ' ORDER BY i) AS line FROM (SELECT doc_id, page, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, page, list_filter(string_split_regex(text, '[ \\n]'), lambda x: x <> '') AS ws FROM {0})) GROUP BY ALL", SPANS)
def _(rows):
    return chunk.span_lines(_spans(rows))


@_query("d10_layout_stats", "SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS total_chars, avg(image_count) FILTER (WHERE r <= 5) AS avg_images FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM {0}) GROUP BY doc_id", PAGES)
def _(pages):
    return chunk.layout_stats(pages)


# --- symbols -----------------------------------------------------------------------------------------------------
@_query("y1_code_lines", f"WITH {_LINES} SELECT path, line_no, raw, line FROM n", CODE)
def _(code):
    return symbols.lines(code)


def _symbols_of(extensions: tuple[str, ...]):
    def run(code):
        found = symbols.symbol_entries(code.where(symbols.extension(F.col("path")).isin(*extensions)))
        return found.select("id", "title", "source_line")

    return run


for _n, _lang in (("y2_js", "js"), ("y3_python", "python"), ("y4_go", "go"), ("y5_rust", "rust"), ("y6_c_family", "c"), ("y7_shell", "shell"), ("y8_fallback", "other")):
    _exts = symbols.LANGUAGES.get(_lang, symbols.OTHER_CODE)
    _query(_n + "_symbols", f"{_SYMBOLS} SELECT id, name || ' (' || kind || ')' AS title, line_no AS source_line FROM m WHERE ext IN ({', '.join(map(repr, _exts))})", CODE)(_symbols_of(_exts))


@_query("y9_symbol_entries", f"""{_SYMBOLS} SELECT id, 'symbol' AS type, name || ' (' || kind || ')' AS title, kind || ' "' || name || '" declared at ' || path || ':' || line_no AS summary, name || '|' || kind AS keywords, path AS source_path, line_no AS source_line, substr({_trim('raw')}, 1, 200) AS text FROM m""", CODE)
def _(code):
    return symbols.symbol_entries(code).select("id", "type", "title", "summary", F.array_join("keywords", "|").alias("keywords"), "source_path", "source_line", "text")


# --- text --------------------------------------------------------------------------------------------------------
@_query("t1_tokens", f"SELECT id, len({_toks('text')}) AS n, array_to_string({_toks('text')}, ' ') AS tokens FROM {{0}}", CJK_TEXT)
def _(rows):
    t = fn.tokens(F.col("text"))
    return rows.select("id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


_TOKEN_SET = f"""WITH d AS (SELECT path, {_toks('text')} AS t FROM {{0}}), u AS (SELECT path, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM d), f AS (SELECT path, tok, min(i) AS i FROM u GROUP BY path, tok),
s AS (SELECT path, string_agg(tok, ' ' ORDER BY i) AS tokens FROM f GROUP BY path) SELECT d.path, coalesce(s.tokens, '') AS tokens FROM d LEFT JOIN s ON s.path = d.path"""


@_query("t2_token_set", _TOKEN_SET, DOCS)
def _(rows):
    return rows.select("path", F.array_join(fn.token_set(F.col("text")), " ").alias("tokens"))


@_query("t3_entry_text", f"SELECT id, {_ENTRY_TEXT} AS txt FROM {{0}}", CHUNK_ENTRIES)
def _(rows):
    return rows.select("id", fn.entry_text().alias("txt"))


@_query("t4_note_text", f"SELECT id, {_NOTE_TEXT} AS txt FROM {{0}}", NOTES)
def _(rows):
    return rows.select("id", fn.note_text().alias("txt"))


@_query("t5_truncate", "SELECT path, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || chr(10) || '...[truncated at 1000 chars]' ELSE text END AS text FROM {0}", DOCS)
def _(rows):
    return rows.select("path", fn.truncate(F.col("text"), 1000).alias("text"))


# --- ranking -----------------------------------------------------------------------------------------------------
DOC_ROWS = "select 'doc' as pool, " + V("doc_id") + " as id, text as txt from {documents}"


@_query("r1_postings", f"SELECT pool, id, t AS term, count(*) AS tf FROM (SELECT pool, id, unnest({_toks('txt')}) AS t FROM {{0}}) GROUP BY ALL", DOC_ROWS)
def _(rows):
    return rank.postings(rows, F.col("txt"))


POOLS = Made(lambda docs, symbols_: _chunk_entries(docs, symbols_).select(F.col("type").alias("pool"), "id", F.concat("title", F.lit(" "), "summary").alias("txt")), (DOCS, SYMBOLS), f"SELECT type AS pool, id, title || ' ' || summary AS txt FROM ({_CHUNK_ENTRIES})")


@_query("r2_statistics", f"SELECT p.pool, term, df, n, round(a, 6) AS avgdl FROM (SELECT pool, t AS term, count(DISTINCT id) AS df FROM (SELECT pool, id, unnest({_toks('txt')}) AS t FROM {{0}}) GROUP BY ALL) p JOIN (SELECT pool, count(*) AS n, avg(len({_toks('txt')})) AS a FROM {{0}} GROUP BY pool) s ON s.pool = p.pool", POOLS)
def _(rows):
    stats = rank.pool_stats(rank.lengths(rows, F.col("txt")))
    return rank.document_frequency(rank.postings(rows, F.col("txt"))).join(stats, "pool").select("pool", "term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


#: Files of a memory before (benchmark items, and documents of which all but the English ones hold their source alone) and now.
_NOW = "select 'f' || " + V("doc_id") + " || '.md' as path, '# ' || coalesce(lang, '') || chr(10) || chr(10) || coalesce(text, '') as text from {documents}"
_BEFORE = "select 'f' || " + V("doc_id") + " || '.md' as path, '# ' || coalesce(lang, '') || chr(10) || chr(10) || coalesce(case when lang = 'en' then text else source end, '') as text from {documents} union all select 'b' || " + V("item_id") + " || '.md', text from {benchmark}"


def _stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes the files of before, then those of now, and returns the statistics of the stored index: counts are sums of
    signed changes, tf those of the postings that no tombstone hides."""
    store = jobs.MemoryStore(spark, f"{shared_dir(spark)}/r2-{uuid.uuid4().hex}", buckets=8)
    for day, rows in enumerate((_BEFORE, _NOW), 1):
        files_ = _rows(spark, sf_dir, rows).select(F.lit("p").alias("project"), "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "text")
        jobs.index_listing(store, files_, f"2024-01-0{day}")
    counts = postings.summed(store.table("frequencies"))
    n = counts.where("term = ''").select(F.col("df").alias("n"), F.round(F.col("total") / F.col("df"), 6).alias("avgdl"))  # one row: one project and type
    tf = postings.live(store.table("postings"), store.table("tombstones")).where("term <> ''").groupBy("term").agg(F.sum("tf").alias("tf"))
    return counts.where("term <> '' and df > 0").join(tf, "term", "full").join(F.broadcast(n)).select("term", "df", "tf", "n", "avgdl")


_Q["r2_stored_statistics"] = _stored_statistics
_O["r2_stored_statistics"] = (
    f"WITH e AS MATERIALIZED (SELECT path || '#' || chunk AS id, {_toks(_ENTRY_TEXT)} AS t FROM (SELECT path, chunk, title, {_summary('text')} AS summary, list_slice({_distinct(_toks('title'))}, 1, 5) AS keywords, path AS source_path "
    f"FROM (SELECT path, chunk, CASE WHEN title <> '' THEN title ELSE path END AS title, text FROM ({_chunks_sql(3000, 40).replace('{0}', '(' + _duck(_NOW) + ')')})))), "
    "s AS (SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM e) SELECT term, df, tf, n, avgdl FROM (SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM e) GROUP BY term), s"
)


def _scored(queries, rows):
    terms = rank.query_terms(queries)
    few = rank.small(terms, rows)
    return rank.scores(terms, rank.asked_postings(rows, F.col("txt"), terms, few, rank.scored_parts(terms, rows)), few)


@_query("r3_bm25_scores", f"WITH {_bm25('SELECT * FROM {1}', 'SELECT * FROM {0}')} SELECT query_id, pool, id, round(score, 6) AS score FROM s", ASKED, DOC_ROWS)
def _(queries, rows):
    return _scored(queries, rows).select("query_id", "pool", "id", F.round("score", 6).alias("score"))


@_query("r4_top_k", f"WITH {_bm25('SELECT * FROM {1}', 'SELECT * FROM {0}')} SELECT query_id, rank, id, score FROM k WHERE rank <= 8", ASKED, DOC_ROWS)
def _(queries, rows):
    return rank.search(queries, rows, F.col("txt")).select("query_id", "rank", "id", "score")


@_query("r5_merged_variants", f"WITH {_bm25(_ENTRY_ROWS, 'SELECT * FROM {0}')} SELECT query_id, rank, id, score FROM k WHERE rank <= 8", VARIANTS, CHUNK_ENTRIES)
def _(queries, entries):
    return rank.search(queries, rank.layered(entries), fn.entry_text()).select("query_id", "rank", "id", "score")


@_query("r6_no_variants", "SELECT query_id, pool, CAST(rank AS INT) AS rank, id, 0.0::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM {0} WHERE query_id % 3 = 0) q, (SELECT pool, id, row_number() OVER (PARTITION BY pool ORDER BY id) AS rank FROM {1}) WHERE rank <= 8", ASKED, POOLS)
def _(queries, rows):
    asked = queries.select("query_id", F.explode(F.array(F.lit("doc"), F.lit("symbol"))).alias("pool"))
    return rank.without_variants(asked, queries.where("query_id % 3 <> 0"), rows)


@_query("r7_note_ranking", f"WITH {_bm25(f'SELECT project AS pool, id, {_NOTE_TEXT} AS txt FROM {{1}}', 'SELECT * FROM {0}')} SELECT query_id, pool, rank, id, score, rel_score FROM k WHERE rank <= 5", ASKED, NOTES)
def _(queries, kept):
    return rank.search(queries, kept.withColumnRenamed("project", "pool"), fn.note_text(), 5)


LISTS = _braces("select item_id as query_id, text, case item_id % 3 when 0 then '[\"one ' || text || '\", \" \", \"two\", \"3\", \"4\", \"5\", \"6\", \"7\"]' when 1 then 'oops' else '[]' end as answer from (select item_id, replace(replace(text, chr(10), ' '), chr(34), ' ') as text from {benchmark}) b")
_LIST_SQL = "SELECT query_id, CAST(i - 1 AS INT) AS variant, v[i] AS text FROM (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN ['one ' || text, 'two', '3', '4', '5', '6'] ELSE [text] END AS v FROM {0}), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i)"


@_query("r8_query_expansion", _LIST_SQL, LISTS)
def _(rows):
    return models.expand(rows.select("query_id", "text"), rows.select("query_id", "answer"))


@_query("r9_relative_score", f"WITH {_bm25(_ENTRY_ROWS, 'SELECT * FROM {0}')} SELECT query_id, rank, id, rel_score FROM k WHERE rank <= 20", ASKED, CHUNK_ENTRIES)
def _(queries, entries):
    return rank.search(queries, rank.layered(entries), fn.entry_text(), 99).select("query_id", "rank", "id", "rel_score")


@_query("r10_layer_filter", f"WITH {_bm25(f'SELECT type AS pool, id, {_ENTRY_TEXT} AS txt FROM {{1}}', 'SELECT * FROM {0}', chr(112) + 'ool = ' + repr('doc'))} SELECT query_id, pool, rank, id, score FROM k WHERE rank <= 8", ASKED, CHUNK_ENTRIES)
def _(queries, entries):
    return rank.search(queries, rank.layered(entries, "doc"), fn.entry_text()).drop("rel_score")


_LINKS = "lk AS (SELECT DISTINCT d.id AS doc_id, s.id AS symbol_id, s.title || ' @ ' || s.source_path || ':' || s.source_line AS label FROM (SELECT * FROM {%d} WHERE type = 'doc') d JOIN (SELECT * FROM {%d} WHERE type = 'symbol' AND length(keywords[1]) >= 3) s ON contains(lower(concat_ws(' ', d.title, d.summary, array_to_string(d.keywords, ' '))), lower(s.keywords[1])))"
_CITED = f"""WITH {_bm25(_ENTRY_ROWS, 'SELECT * FROM {0}')}, {_LINKS % (1, 1)},
rf AS (SELECT doc_id, list(label ORDER BY symbol_id) AS l FROM lk GROUP BY doc_id),
ct AS (SELECT query_id, rank, k.id, score, rel_score, e.title, e.summary, e.source_path || ':' || e.source_line AS source, array_to_string(list_slice(rf.l, 1, 5), '; ') AS refs FROM k JOIN {{1}} e ON e.id = k.id LEFT JOIN rf ON rf.doc_id = k.id WHERE rank <= 8)"""


def _cited(queries, entries):
    # entries are searched, linked and shown: made once, as a stored memory has them
    entries = stored(entries)
    hits = stored(rank.search(queries, rank.layered(entries), fn.entry_text()))
    return rank.cite(hits, entries, rank.linked(hits, entries))


@_query("r11_citations", f"{_CITED} SELECT query_id, rank, id, title, source, refs FROM ct", ASKED, CHUNK_ENTRIES)
def _(queries, entries):
    return _cited(queries, entries).select("query_id", "rank", "id", "title", "source", F.array_join("refs", "; ").alias("refs"))


MISSES = ASKED + " union all select 1000000 + item_id, 0, 'łł' from {benchmark} where item_id < 3"


@_query(
    "r12_answers",
    f"""{_CITED}, an AS (SELECT query_id, '## Memory (docs + symbols)' || chr(10) || chr(10) || string_agg('### ' || title || ' (score: ' || rel_score || ')' || chr(10) || '- source: ' || source || chr(10) || '- ' || summary || CASE WHEN refs <> '' THEN chr(10) || chr(10) || '- references: ' || refs ELSE '' END, chr(10) || chr(10) ORDER BY rank) AS a FROM ct GROUP BY query_id),
    fin AS (SELECT q.query_id, coalesce(a, 'No memory matches for "' || q.text || '".') AS a FROM {{0}} q LEFT JOIN an ON an.query_id = q.query_id)
    SELECT query_id, CASE WHEN length(a) > 2000 THEN substr(a, 1, 2000) || chr(10) || chr(10) || '...[truncated at 2000 chars]' ELSE a END AS answer FROM fin""",
    MISSES, CHUNK_ENTRIES,
)
def _(queries, entries):
    return rank.render(queries, _cited(queries, entries), 2000)


# --- joins and notes ---------------------------------------------------------------------------------------------
@_query("j1_symbol_links", f"WITH {_LINKS % (0, 0)} SELECT doc_id, symbol_id FROM lk", CHUNK_ENTRIES)
def _(entries):
    return links.links(entries)


@_query("j2_manifest_diff", "SELECT project, path FROM {1} m WHERE NOT EXISTS (SELECT 1 FROM {0} l WHERE l.project = m.project AND l.path = m.path) AND lower(path) NOT LIKE '%.bin'", LISTED, MANIFEST)
def _(listing, manifest):
    return _plan(listing, manifest).where("status = 'removed'").select("project", "path")


# every note is on one side: of a conversation's notes (day is its number) the first, third, ... are old, the others new;
# near copies of the old notes of every other conversation are new notes besides
_NTH = "(select n.*, row_number() over (partition by day order by seq) as nth from (" + NOTES + ") n) o"
OLD_NOTES = "select project, id, seq, problem, solution, source_file, day from " + _NTH + " where nth % 2 = 1"
NEW_NOTES = (
    "select project, id, seq, problem, solution, source_file, day from " + _NTH + " where nth % 2 = 0 "
    "union all select project, id || 'c', seq + 50, substr(problem, 1, cast(floor(4 * length(problem) / 5.0) as int)), solution, source_file, day from " + _NTH + " where nth % 2 = 1 and day % 2 = 0"
)
_OVERLAP = """a AS (SELECT project, id, seq, problem, list_distinct({t}) AS tk FROM {{0}}), b AS (SELECT project, id, seq, problem, solution, source_file, day, list_distinct({t}) AS tk FROM {{1}}),
o AS (SELECT b.project, b.id AS left_id, a.id AS right_id, a.seq, len(list_intersect(a.tk, b.tk)) AS overlap, len(a.tk) AS na, len(b.tk) AS nb FROM a JOIN b ON a.project = b.project),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, left_id ORDER BY overlap DESC, seq) AS r FROM o WHERE least(na, nb) > 0 AND overlap / least(na, nb) >= 0.6) WHERE r = 1)""".format(t=_toks("problem"))


def _noted(rows: DataFrame) -> DataFrame:
    at = F.timestamp_seconds(F.col("day") * 86400)
    return rows.select("project", "id", "seq", "problem", "solution", "source_file", at.alias("created_at"), at.alias("updated_at"))


@_query("j3_overlap_join", f"WITH {_OVERLAP} SELECT project, left_id, right_id, overlap FROM h", OLD_NOTES, NEW_NOTES)
def _(old, new):
    sets = lambda df: df.select("project", "id", "seq", fn.token_set(F.col("problem")).alias("tokens"))
    return links.best_overlap(sets(new), sets(old))


@_query("j4_posting_join", f"WITH {_bm25('SELECT * FROM {1}', 'SELECT * FROM {0}')} SELECT query_id, id, round(score, 4) AS score FROM s", VARIANTS, DOC_ROWS)
def _(queries, rows):
    return _scored(queries, rows).select("query_id", "id", F.round("score", 4).alias("score"))


@_query(
    "n1_remember",
    f"""WITH {_OVERLAP}, u AS (SELECT * FROM (SELECT h.project, right_id, b.problem, b.solution, b.source_file, b.day, row_number() OVER (PARTITION BY h.project, right_id ORDER BY b.seq DESC) AS k FROM h JOIN b ON b.project = h.project AND b.id = h.left_id) WHERE k = 1)
    SELECT x.project, x.id, coalesce(u.problem, x.problem) AS problem, coalesce(u.solution, x.solution) AS solution, coalesce(u.source_file, x.source_file) AS source_file FROM {{0}} x LEFT JOIN u ON u.project = x.project AND u.right_id = x.id
    UNION ALL SELECT b.project, sha256(b.project || '|' || b.seq || '|' || b.problem), b.problem, b.solution, b.source_file FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.project = b.project AND h.left_id = b.id)""",
    OLD_NOTES, NEW_NOTES,
)
def _(old, new):
    return notes.remember(_noted(old), _noted(new)).select("project", "id", "problem", "solution", "source_file")


# projects of 25 conversations each: their number grows with the table
_BY_25 = "select 'p' || " + V("cast(floor(day / 25) as bigint)") + " as project, id, seq, problem, solution, source_file, day from ({}) b"


# the fold as a recursion: a project's notes are a list, and step k adds its k-th new note
_FOLD = f"""WITH RECURSIVE o AS (SELECT *, list_distinct({_toks("problem")}) AS tk FROM {{0}}), n AS (SELECT *, list_distinct({_toks("problem")}) AS tk, row_number() OVER (PARTITION BY project ORDER BY seq) AS k FROM {{1}}),
st AS (SELECT project, list({{'id': id, 'seq': seq, 'problem': problem, 'solution': solution, 'source_file': source_file, 'made': day, 'day': day, 'tk': tk}} ORDER BY seq) AS notes FROM o GROUP BY project),
r AS (SELECT p.project, CAST(0 AS BIGINT) AS k, CASE WHEN notes IS NULL THEN 100 ELSE 120 END AS cap, coalesce(notes, []) AS notes FROM (SELECT project FROM o UNION SELECT project FROM n) p LEFT JOIN st ON st.project = p.project
 UNION ALL SELECT project, k, cap, CASE
   WHEN most > 0 THEN list_transform(notes, lambda x, i: CASE WHEN i = list_position(shared, most) THEN {{'id': x.id, 'seq': x.seq, 'problem': problem, 'solution': solution, 'source_file': coalesce(nullif(source_file, ''), x.source_file), 'made': x.made, 'day': day, 'tk': tk}} ELSE x END)
   WHEN len(notes) < cap THEN list_append(notes, own)
   ELSE list_transform(list_sort(list_transform(list_sort(list_transform(list_append(notes, own), lambda x: {{'u': x.day, 's': x.seq, 'x': x}}))[-cap:], lambda y: {{'s': y.s, 'x': y.x}})), lambda y: y.x) END
 FROM (SELECT *, list_max(shared) AS most FROM (SELECT r.project, n.k, r.cap, r.notes, n.problem, n.solution, n.source_file, n.day, n.tk,
   {{'id': n.id, 'seq': n.seq, 'problem': n.problem, 'solution': n.solution, 'source_file': n.source_file, 'made': n.day, 'day': n.day, 'tk': n.tk}} AS own,
   list_transform(r.notes, lambda x: CASE WHEN least(len(x.tk), len(n.tk)) > 0 AND len(list_intersect(x.tk, n.tk)) / least(len(x.tk), len(n.tk)) >= 0.6 THEN len(list_intersect(x.tk, n.tk)) ELSE 0 END) AS shared
   FROM r JOIN n ON n.project = r.project AND n.k = r.k + 1)))
SELECT project, x.id AS id, x.seq AS seq, x.problem AS problem, x.solution AS solution, x.source_file AS source_file, x.made AS created_day, x.day AS updated_day
FROM (SELECT project, unnest(notes) AS x FROM (SELECT project, arg_max(notes, k) AS notes FROM r GROUP BY project))"""


@_query("n2_remember_in_order", _FOLD, _BY_25.replace("({})", "(" + OLD_NOTES + ")"), _BY_25.replace("({})", "(" + NEW_NOTES + ")"))
def _(old, new):
    counts = old.select("project").distinct().withColumn("n_files", F.lit(60))
    days = lambda c: (F.unix_seconds(c) / 86400).cast("long")
    found = notes.remember_in_order(_noted(old), _noted(new), counts)
    return found.select("project", "id", "seq", "problem", "solution", "source_file", days("created_at").alias("created_day"), days("updated_at").alias("updated_day"))


MANY_NOTES = "select 'p' || " + V("doc_id % 2") + " as project, 'n' || " + V("doc_id") + " as id, doc_id as seq, text as problem, lang as solution, source as source_file, doc_id % 97 as day from {documents}"


@_query("n3_prune", "SELECT project, id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY day DESC, seq DESC) AS r FROM {0}) WHERE r <= CASE project WHEN 'p0' THEN 100 ELSE 140 END", MANY_NOTES)
def _(rows):
    counts = rows.select("project").distinct().withColumn("n_files", F.when(F.col("project") == "p0", 10).otherwise(70))
    return notes.prune(_noted(rows), counts).select("project", "id")


@_query("n4_forget_by_id", "SELECT project, id FROM {0} WHERE day % 5 <> 0", NOTES)
def _(rows):
    return notes.forget(_noted(rows), rows.where("day % 5 = 0").select("project", F.col("id").alias("query"))).select("project", "id")


# every user turn asks the notes of the project after its own: in its own it would name its own note, and none would stay
KEYWORDS = "select 'p' || " + V("(conv_id + 1) % 4") + " as project, text as query from {conversations} where role = 'user'"


@_query("n5_forget_by_keywords", f"SELECT project, id FROM {{0}} n WHERE NOT EXISTS (SELECT 1 FROM {{1}} q WHERE q.project = n.project AND len(list_intersect({_toks('q.query')}, {_toks(chr(110) + '.problem || chr(32) || n.solution')})) / least(len(list_distinct({_toks('q.query')})), len(list_distinct({_toks('n.problem || chr(32) || n.solution')}))) >= 0.5)", NOTES, KEYWORDS)
def _(rows, asked):
    return notes.forget(_noted(rows), asked).select("project", "id")


# --- observations ------------------------------------------------------------------------------------------------
@_query("w1_observations", "SELECT path, seq FROM {0} WHERE kind = 'present'", EVENTS)
def _(events):
    return observe.observed(events).select("path", "seq")


@_query("w2_coalesced", "SELECT path, max_by(sha, (observed_at, seq)) AS sha FROM {0} GROUP BY path", EVENTS)
def _(events):
    return observe.coalesce_burst(events.withColumn("observed_at", F.struct("observed_at", "seq"))).select("path", "sha")


@_query("w3_changed_content", "SELECT path, sha, seq FROM (SELECT *, lag(sha) OVER (PARTITION BY path ORDER BY observed_at, seq) AS b FROM {0}) WHERE sha IS DISTINCT FROM b", EVENTS)
def _(events):
    return observe.changed_content(events).select("path", "sha", "seq")


SEEN = "select 'p' || " + V("doc_id % 3") + " as project, 'f' || " + V("doc_id") + " || '.md' as path, n_chars + case when doc_id % 10 = 0 then 1 else 0 end as size, doc_id % 100 as mtime from {documents} where doc_id % 11 <> 0"
FOUND = "select 'p' || " + V("doc_id % 3") + " as project, 'f' || " + V("doc_id") + " || '.md' as path, n_chars as size, doc_id % 100 as mtime from {documents} where doc_id % 17 <> 0"


OBSERVED = "select '/w/p/' || path || '.md' as path, sha, observed_at, seq, kind from (" + EVENTS + ") e"
# a file's text names the last event that was seen of it, so contents change as events come
_SEEN_TEXT = "select 'f' || " + V("d.doc_id") + " || '.md' as path, '# ' || e.sha || chr(10) || chr(10) || coalesce(d.text, '') as text from {documents} d join (select path, max_by(sha, {of}) as sha from (" + EVENTS + ") e where kind = 'present' group by path) e on e.path = 'f' || " + V("d.doc_id")


def _read_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams all events through the read-time index into a memory below the shared folder, and returns its entries.

    The session's state store and its number of partitions, which a stream can't change later, are set for the stream alone."""
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in settings}
    at = f"{shared_dir(spark)}/w4-{uuid.uuid4().hex}"
    store = jobs.MemoryStore(spark, f"{at}/memory", buckets=8)
    jobs.watch(store, spark.createDataFrame([("p", "/w/p")], "project string, root string"))
    texts = _rows(spark, sf_dir, _SEEN_TEXT.replace("{of}", "struct(observed_at, seq)")).select(F.lit("p").alias("project"), "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "text")
    table = f"{sf_dir}/events.parquet"
    # a pattern: the table may be a folder or one file, which a stream doesn't take as its path
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{sf_dir}/events.parque[t]")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        jobs.read_time_index(store, spark.sql(OBSERVED, events=stream), lambda look: texts.join(look.select("project", "path"), ["project", "path"], "left_semi"), f"{at}/stream", once=True).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return store.table("entries").select("path", "title", "summary", "source_line")


_Q["w4_read_time_index"] = _read_time
_O["w4_read_time_index"] = f"SELECT path, title, {_summary('text')} AS summary, CAST(line AS INT) AS source_line FROM (" + _chunks_sql(3000, 40).replace("{0}", "(" + _duck(_SEEN_TEXT.replace("{of}", "(observed_at, seq)")) + ")") + ")"


@_query("w5_polled_refresh", "SELECT project, path, 'read' AS what FROM {0} f WHERE NOT EXISTS (SELECT 1 FROM {1} s WHERE s.project = f.project AND s.path = f.path AND s.size = f.size AND s.mtime = f.mtime) UNION ALL SELECT project, path, 'gone' FROM {1} s WHERE NOT EXISTS (SELECT 1 FROM {0} f WHERE s.project = f.project AND s.path = f.path)", FOUND, SEEN)
def _(found, seen):
    read = observe.to_hash(found, seen).select("project", "path", F.lit("read").alias("what"))
    return read.unionByName(observe.vanished(found, seen).select("project", "path", F.lit("gone").alias("what")))


@_query("w6_retry", "SELECT project, path, mtime, size FROM {0} WHERE size % 6 <> 0", FOUND)
def _(found):
    return observe.next_snapshot(found, found.select("project", "path", F.when(F.col("size") % 6 == 0, "failed").otherwise("dump").alias("status")))


@_query("w7_watched_roots", "SELECT project, path FROM {0} WHERE project IN ('p0', 'p2')", FOUND)
def _(found):
    roots = found.select(F.col("project").alias("root")).distinct()
    kept = observe.remove_roots(observe.add_roots(roots, roots), roots.where("root = 'p1'"))
    return observe.watched(found, kept).select("project", "path")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
