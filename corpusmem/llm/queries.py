"""The registered queries of this subpackage: op1 to op13 and the pipeline, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmem.llm import bm25_search, centroids, chat_tools, fair_mix, hard_negatives, html_extract, jaccard_join, lang_id, merkle, minhash_join, packing, rlbwt_dedup, token_count
from corpusmem.llm.util import small_batches


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; the package is on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op2_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bm25_search.top_k(docs, docs.where("doc_id % 20 = 0"), k=10)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents"))


def op4_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_tools.calls_of_turns(_table(spark, sf_dir, "conversations"))
    return chat_tools.digest(chat_tools.format_chats(messages, chat_tools.SCHEMAS))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_rlbwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlbwt_dedup.digest(rlbwt_dedup.mark_repeats(_table(spark, sf_dir, "documents")))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(_table(spark, sf_dir, "documents"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_language_id, op2_bm25_topk, op3_ngram_jaccard, op4_chat_tools, op5_main_text, op6_packing, op7_rlbwt_dedup, op8_token_count, op9_fair_mix, op10_merkle, op11_hard_negatives, op12_centroids, op13_minhash_join, pipeline)
    return {f.__name__: f for f in named}


_OP9 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix') AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
f AS (SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
             sum(weight) OVER (ORDER BY source_size / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
o AS (SELECT *, CASE WHEN 4 * source_size * w_left > weight * left2 THEN source_size / weight END AS opened FROM f),
l AS (SELECT *, (SELECT min(opened) FROM o) AS first_open FROM o),
lv AS (SELECT left2, w_left FROM l WHERE opened IS NOT NULL ORDER BY source_size / weight, rk LIMIT 1),
t AS (SELECT l.source, l.source_size, l.rk,
             CASE WHEN (l.source_size / l.weight, l.rk) >= (SELECT (source_size / weight, rk) FROM l WHERE opened IS NOT NULL ORDER BY source_size / weight, rk LIMIT 1)
                  THEN CAST(l.weight * lv.left2 AS DOUBLE) / (2.0 * lv.w_left) ELSE l.source_size * 2.0 END AS target
      FROM l LEFT JOIN lv ON true),
c AS (SELECT d.doc_id, d.size, d.h, t.rk, t.source_size, CAST(t.target AS DOUBLE) AS target, k AS copy,
             CAST(k * t.source_size + sum(d.size) OVER (PARTITION BY t.rk, k ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(t.target AS DOUBLE) AS finish
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) v(k)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, h, doc_id, copy ROWS UNBOUNDED PRECEDING) AS total FROM c WHERE size > 0),
m AS (SELECT doc_id, sum(size) AS taken FROM g WHERE 2 * total <= 3 * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, CAST(coalesce(m.taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN m USING (doc_id)
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
l AS (SELECT doc_id, len(w) AS n, avg(len(w)) OVER () AS a, count(*) OVER () AS c FROM d),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1 + (l.c - f.df + 0.5) / (f.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * l.n / l.a))), 6) AS score
      FROM p q JOIN f USING (t) JOIN p USING (t) JOIN l ON l.doc_id = p.doc_id WHERE q.doc_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

_TREE = """array_to_string(list_transform(string_split({t}, chr(10) || chr(10)), lambda s: array_to_string(list_transform(string_split(s, chr(10)), lambda p: substr(sha256(p), 1, 32) || array_to_string(
  list_transform(list_filter(string_split(regexp_replace(regexp_replace(p, '([.!?;:,dkz]) ', '\\1 ' || chr(1), 'g'), '([^' || chr(1) || '\\n]{{200}})', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: substr(md5(x), 1, 8)), '')), ',')), '|')"""
_ROOT = """sha256(array_to_string(list_transform(string_split({t}, '|'), lambda s: sha256(array_to_string(list_transform(string_split(s, ','), lambda p: substr(p, 1, 32)), ''))), '')) || '/' || {t}"""
_LEAVES = """regexp_extract_all(array_to_string(list_transform(string_split(replace(substr({t}, 66), '|', ','), ','), lambda p: substr(p, 33)), ''), '.{{8}}')"""
# leaves in common, with repeats: by counts of each
_BOTH = """(SELECT coalesce(sum(least(u.k, w.k)), 0) FROM (SELECT v, count(*) AS k FROM (SELECT unnest({x}) AS v) GROUP BY v) u JOIN (SELECT v, count(*) AS k FROM (SELECT unnest({y}) AS v) GROUP BY v) w USING (v))"""
_NEAR = """CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 1.0 ELSE 2.0 * {both} / (len({x}) + len({y}) + 2) END"""
_EDITS = """array_to_string(flatten(list_transform(list_filter(range(1, greatest(len(sa), len(sb)) + 1), lambda i: sa[i] IS DISTINCT FROM sb[i]), lambda i: list_transform(
  list_filter(range(1, greatest(coalesce(len(string_split(sa[i], ',')), 0), coalesce(len(string_split(sb[i], ',')), 0)) + 1), lambda j: string_split(sa[i], ',')[j] IS DISTINCT FROM string_split(sb[i], ',')[j]), lambda j: (i - 1) || '.' || (j - 1)))), ' ')"""


def _near(a: str, b: str, x: str, y: str) -> str:
    return f"CAST({_NEAR.format(a=a, b=b, x=x, y=y, both=_BOTH.format(x=x, y=y))} AS DOUBLE)"


_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS nxt FROM d),
e AS (SELECT doc_id, n_chars, text, nxt, substr(text, 1, n_chars - n_chars // 4) || substr(nxt, 1, n_chars // 4) AS edited FROM n),
t AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_TREE.format(t='text')} AS a, {_TREE.format(t='edited')} AS b, {_TREE.format(t='nxt')} AS c FROM e),
f AS (SELECT doc_id, n_chars, edited_sha256, {_ROOT.format(t='a')} AS fingerprint, {_ROOT.format(t='b')} AS edited_fingerprint, {_ROOT.format(t='c')} AS next_print, string_split(a, '|') AS sa, string_split(b, '|') AS sb FROM t),
v AS (SELECT *, {_LEAVES.format(t='fingerprint')} AS x, {_LEAVES.format(t='edited_fingerprint')} AS y, {_LEAVES.format(t='next_print')} AS z FROM f)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint, {_near('fingerprint', 'edited_fingerprint', 'x', 'y')} AS near_edited, {_near('fingerprint', 'next_print', 'x', 'z')} AS near_next, {_EDITS} AS edits FROM v
"""


_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, x.vec_id, x.label, CAST(list_inner_product(a.q, x.q) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label = own) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def _op12(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Every round's centroids as a table (c, m): number and components."""
    apart = "CAST(list_sum(list_transform(range(1, {d} + 1), lambda i: (v.q[i] - c.m[i]) * (v.q[i] - c.m[i]))) AS BIGINT)".format(d=dims)
    near = lambda of: f"SELECT vec_id, q, c, apart FROM (SELECT v.vec_id, v.q, c.c, {apart} AS apart, row_number() OVER (PARTITION BY v.vec_id ORDER BY {apart}, c.c) AS r FROM v, {of} c) WHERE r = 1"  # noqa: E731
    sql = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q AS m FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    for r in range(rounds):
        sql += f""",
a{r} AS MATERIALIZED ({near(f'c{r}')}),
s{r} AS (SELECT c, i, CAST(floor(CAST(sum(q[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{r}, (SELECT unnest(range(1, {dims} + 1)) AS i) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(t.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{r} GROUP BY c) t USING (c))"""
    return sql + f""",
f AS MATERIALIZED ({near(f'c{rounds}')})
SELECT vec_id, CAST(f.c AS INT) AS cluster, apart AS distance, CAST(sum(apart) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(apart) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.c = f.c
"""


_OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {least} * (x.n + y.n - k)),
m AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT m.b, r.c FROM r JOIN m ON m.a = r.doc_id WHERE r.c < m.b),
f AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(f.c, d.doc_id) AS component_id, {more}
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    near = {"op3_ngram_jaccard": _OP13.format(least=90, more="CAST((SELECT count(*) FROM m WHERE m.a = d.doc_id) AS BIGINT) AS n_links"), "op13_minhash_join": _OP13.format(least=85, more="coalesce(f.c, d.doc_id) = d.doc_id AS kept")}
    return near | {"op11_hard_negatives": _OP11, "op12_centroids": _op12(), "op2_bm25_topk": _OP2, "op4_chat_tools": chat_tools.ORACLE, "op9_fair_mix": _OP9, "op10_merkle": _OP10}
