"""The library's operators on the literals of their definitions, and properties: blocked = nested loop, incremental = full."""

import os
import random
import re
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmem.config import Config
from corpusmem.functions import text as fn
from corpusmem.operators import chunk, links, models, notes, rank, symbols
from corpusmem.plans import index
from corpusmem.sources import files
from corpusmem.streaming import observe

PY = "class PaymentService:\n    def charge(self, amount):\n        return amount\n\ndef refund(order):\n    return order\n"


def _one(spark, expr, *values, schema):
    return spark.createDataFrame([values], schema).select(expr.alias("v")).first()["v"]


def test_sections(spark):
    docs = spark.createDataFrame([("p", "# A\n\ncontent one\n\n# B\n\ncontent two"), ("q", "intro\r\n## X y \r\nz"), ("r", None), ("e", " \n ")], "path string, text string")
    got = [(r["path"], r["title"], r["line"]) for r in chunk.sections(docs).orderBy("path", "line").collect()]
    assert got == [("p", "A", 1), ("p", "B", 5), ("q", "", 1), ("q", "X y", 2)]


def test_chunk_limits(spark):
    docs = spark.createDataFrame([("p", "abc def ghi"), ("q", "# A\n\nx\n\n# B\n\ny")], "path string, text string")
    assert chunk.chunks(docs, 0, 40).where("path = 'p'").count() == 1
    assert chunk.chunks(docs, -5, -3).where("path = 'q'").count() == 2
    assert [c["text"] for c in chunk.split_block("aa bb cc", 1, 3, 40)] == ["aa", "bb", "cc"]


def test_chunks_stay_in_the_engine(spark):
    """Long sections are cut as split_block cuts them, and no text goes through Python."""
    rnd = random.Random(5)
    pieces = ["a", "é", "中", "😀", " ", " ", "\n", "\n\n", "\u3000", "\n \n", "word"]
    texts = [t for t in ("".join(rnd.choice(pieces) for _ in range(rnd.randrange(10, 300))).strip(chunk.WS_CHARS) for _ in range(150)) if t]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    for limit, most in ((1, 3), (7, 40), (20, 5), (33, 40)):
        found = chunk.chunks(docs, limit, most)
        got = {}
        for r in found.orderBy("path", "chunk").collect():
            got.setdefault(int(r["path"]), []).append({"text": r["text"], "line": r["line"]})
        assert got == {i: chunk.split_block(t, 1, limit, most)[:most] if len(t) > limit else [{"text": t, "line": 1}] for i, t in enumerate(texts)}
        assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())


def test_symbols(spark):
    cs = "using System;\n\nclass Program {\n    static void Main(string[] args) {\n        if (args.Length > 0) return;\n        foreach (var a in args) { }\n    }\n\n    public string GetName() {\n        return Name();\n    }\n}\n"
    rust = "pub fn visible() {}\npub(crate) async fn scoped() {}\nfn hidden() {}\npub struct Thing {\n"
    table = spark.createDataFrame([("src/payments.py", PY), ("a.cs", cs), ("b.RS", rust), ("t.js", "export default class Q {\nconst f = async (x) => 1\n function (a) {}")], "path string, text string")
    got = {(r["path"], r["title"], r["source_line"]) for r in symbols.symbol_entries(table).collect()}
    assert {x for x in got if x[0] == "src/payments.py"} == {("src/payments.py", "PaymentService (class)", 1), ("src/payments.py", "charge (function)", 2), ("src/payments.py", "refund (function)", 5)}
    assert {x[1:] for x in got if x[0] == "a.cs"} == {("Program (class)", 3), ("Main (function)", 4), ("GetName (function)", 9)}
    assert {x[1] for x in got if x[0] == "b.RS"} == {"visible (function)", "scoped (function)", "hidden (function)", "Thing (type)"}
    assert {x[1] for x in got if x[0] == "t.js"} == {"Q (class)", "f (function)", "(anonymous) (function)"}


def _tokens(text):
    low = text.lower()
    out = re.findall("[a-z0-9_]+", low)
    for run in re.findall("[㐀-鿿豈-﫿぀-ヿ가-힯]+", low):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def test_tokens(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB_9 für中文の결,.-") for _ in range(rnd.randrange(30))) for _ in range(200)] + ["", "こんにちは の設定", "セーブデータ 確認", "결제 모듈 修正"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.tokens(F.col("t")).alias("k")).collect()
    assert all(r["k"] == _tokens(texts[r["i"]]) for r in got)


def _tables(tmp_path, spark, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_token_set_reads_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(("w", "中文", "B_")) + str(rnd.randrange(400)) for _ in range(n)) for n in (0, 5, 300, 3000)]
    at = _tables(tmp_path, spark, documents=(list(enumerate(texts)), "doc_id long, text string"))
    got = {int(r["path"]): r["tokens"] for r in entry.queries()["t2_token_set"](spark, at).collect()}
    assert got == {i: " ".join(dict.fromkeys(_tokens(t))) for i, t in enumerate(texts)}


def test_summary(spark):
    at = lambda t: _one(spark, fn.summary(F.col("t")), t, schema="t string")
    assert len(at("S" * 900)) == 300 and at("S" * 900).endswith("…")
    assert at("a. " * 200).endswith(".") and len(at("a. " * 200)) <= 300
    assert at(" a \n b ") == "a b" and at(None) == ""


def test_dumps(spark):
    at = lambda t: _one(spark, files.is_dump(F.col("t")), t, schema="t string")
    assert at("=== Assembly loaded: A, Version=1.0.0.0\n== TYPE X") and not at("====\nbanner") and not at("# Title") and not at("")


def test_tree(spark, tmp_path):
    for p in ("vendor/a.go", "obj/b.go", "src/main.go", "src/__init__.py", ".git/x.go", "src/.hid.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = files.read_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == ["src/__init__.py", "src/main.go"]
    assert {r["text"] for r in files.read_texts(got).collect()} == {"x"}


def test_roots(spark):
    paths = spark.createDataFrame([("g/a/b/f.md",), ("m/p/src/f.md",), ("r/app/x/f.md",), ("bare/f.md",)], "path string")
    listing = spark.createDataFrame([("g/.git", True), ("m/p/package.json", False), ("r/README.md", False), ("r/app", True)], "path string, is_dir boolean")
    got = {r["path"]: r["root"] for r in files.project_roots(paths, listing).collect()}
    assert got == {"g/a/b/f.md": "g", "m/p/src/f.md": "m/p", "r/app/x/f.md": "r", "bare/f.md": "bare"}


def test_code_first(spark):
    rows = spark.createDataFrame([("p", x, i) for i, x in enumerate(["a.md", "b.js", "c.ts", "d.txt"])], "project string, path string, seq int")
    assert [r["path"] for r in files.code_first(rows).orderBy("rank").collect()] == ["b.js", "c.ts", "a.md", "d.txt"]


def _rank(spark, rows, queries):
    table = spark.createDataFrame([("all", i, t, s, []) for i, t, s in rows], "pool string, id string, title string, summary string, keywords array<string>").withColumn("source_path", F.lit("x"))
    asked = spark.createDataFrame([(1, v, q) for v, q in enumerate(queries)], "query_id int, variant int, text string")
    return [r["id"] for r in rank.search(asked, table, fn.entry_text()).orderBy("rank").collect()]


def test_ranking(spark):
    assert _rank(spark, [("1", "Refund", "money back"), ("2", "Other", "nothing")], ["refund", "money back"]) == ["1"]
    assert _rank(spark, [("low", "a", "fees here"), ("high", "a", "fees fees fees")], ["fees"])[0] == "high"
    assert _rank(spark, [("body", "a b", "zephyr wind"), ("head", "zephyr", "a b")], ["zephyr"])[0] == "head"


def test_scores_of_a_task_are_bounded(spark, monkeypatch):
    """Spark doesn't join the partitions of scores, however few bytes the postings have: a task sums PAIRS scores at most."""
    rows = spark.range(600).selectExpr("'doc' as pool", "cast(id as string) as id", "concat('all w', id % 7) as txt")
    asked = spark.range(10).selectExpr("id as query_id", "0 as variant", "concat('all w', id) as text")
    terms = rank.query_terms(asked)
    whole = lambda parts: rank.scores(terms, rank.asked_postings(rows, F.col("txt"), terms, True, parts), True)
    want = {tuple(r) for r in whole(None).collect()}
    monkeypatch.setattr(rank, "PAIRS", 500)
    got = whole(rank.scored_parts(terms, rows)).withColumn("task", F.spark_partition_id()).collect()
    assert {tuple(r)[:-1] for r in got} == want and len(got) == 6000
    sums = [sum(r["task"] == t for r in got) for t in {r["task"] for r in got}]
    assert len(sums) >= 11 and max(sums) < 1500
    posted = rank.asked_postings(rows, F.col("txt"), terms, True).localCheckpoint()
    weighed = rank.weighed(terms, rank.term_stats(posted), True)
    assert rank._extent(weighed) == (True, 12)
    assert {r["task"] for r in rank._sums(posted, weighed, *rank._extent(weighed)).withColumn("task", F.spark_partition_id()).collect()} == {r["task"] for r in got}


def test_links_blocked_equal_nested(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 6)))
    rows = [(f"d{i}", "doc", word(), " ".join(word() for _ in range(9)), [word()]) for i in range(40)] + [(f"s{i}", "symbol", "t", "s", [word(), "function"]) for i in range(30)]
    table = spark.createDataFrame(rows, "id string, type string, title string, summary string, keywords array<string>")
    assert sorted(links.links(table).collect()) == sorted(links.nested_loop_links(table).collect())


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Plans of an indexing run: postings are counted within their entry, names go to the texts, a plan carries no text."""
    from corpusmem.plans import postings

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    entries = spark.createDataFrame([(f"d{i}", "p", f"f{i}", "doc", f"t{i % 3} T", f"about Alpha{i} alpha {'alpha ' * i}", ["k", "t"], "f") for i in range(9)] + [("s1", "p", "g", "symbol", "alpha (function)", "x", ["alpha3"], "g"), ("s2", "p", "h", "symbol", "", None, None, None)], "id string, project string, path string, type string, title string, summary string, keywords array<string>, source_path string")
    found = postings.posted(entries)
    assert "Exchange" not in plan(found)
    rows = entries.select(*postings.ENTRY, fn.tokens(fn.entry_text()).alias("t")).collect()
    want = {(t, r["project"], r["type"], r["path"], r["id"], len(r["t"]), r["t"].count(t)) for r in rows for t in {"", *r["t"]}}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what Spark broadcasts by itself in a small test doesn't count
    few = links.links(entries)
    joined = plan(few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [gram" in joined
    monkeypatch.setattr(links, "BROADCAST_GRAMS", 0)
    pairs = lambda df: {tuple(r) for r in df.collect()}
    assert pairs(few) == pairs(links.links(entries)) == pairs(links.nested_loop_links(entries)) == {("d3", "s1")}
    listing = spark.createDataFrame([("p", "a.md", "1", 9, "====\nVersion=1.2.3.4 "), ("p", "b.md", "2", 9, "text"), ("p", "c.py", "3", 9, "====\nVersion=1.2.3.4 ")], "project string, path string, sha256 string, size long, text string")
    manifest = spark.createDataFrame([], "project string, path string, sha256 string, size long, kind string, indexed_at timestamp")
    made = index.change_plan(listing, manifest)
    assert {r["path"]: r["status"] for r in made.collect()} == {"a.md": "dump", "b.md": "new", "c.py": "new"}
    carried = made._jdf.queryExecution().optimizedPlan().toString().split("Join FullOuter")[1]
    assert "dump#" in carried.split("\n")[1]


def test_entries_of_all_chunks_and_whole_queries(spark, tmp_path):
    import __spark_entry__ as entry

    long = " ".join(["filler"] * 420) + "\n\n" + "zephyr meets lateword " + " ".join(["other"] * 300)
    docs = [(0, long, "en", "web"), (1, "zephyr " + "plain " * 20, "en", "web"), (2, "nothing here", "en", "web")]
    items = [(0, "ask lateword " + "qqqq " * 10 + "zephyr"), (1, "say never " + "vvvv " * 20 + "nothing")]
    at = _tables(tmp_path, spark, documents=(docs, "doc_id long, text string, lang string, source string"), benchmark=(items, "item_id long, text string"))
    rows = lambda name: entry.queries()[name](spark, at).collect()
    hits = lambda name, query: {r["id"] for r in rows(name) if r["query_id"] == query}
    assert {r["id"] for r in rows("t3_entry_text")} == {"0#0", "0#1", "1#0", "2#0", "s0", "s1"}
    assert hits("r3_bm25_scores", 0) == hits("r4_top_k", 0) == {"0", "1"} and hits("r4_top_k", 1) == {"2"}
    assert hits("r9_relative_score", 0) == {"0#1", "1#0", "s0"} and hits("r10_layer_filter", 1) == {"2#0"}
    assert hits("r5_merged_variants", 0) == {"0#1", "1#0", "2#0", "s0", "s1"}
    assert {tuple(r) for r in rows("j1_symbol_links")} == {("0#1", "s0")}
    assert {(r["id"], r["refs"]) for r in rows("r11_citations") if r["id"] == "0#1"} == {("0#1", "lateword (function) @ src/a.py:1")}


NOTE = notes.SCHEMA


def _note(i, problem, day=0, project="p", solution="s"):
    at = datetime(2024, 1, 1) + timedelta(days=day)
    return (project, f"n{i}", i, problem, solution, None, at, at)


def test_notes_fold(spark):
    files_ = spark.createDataFrame([("p", 60)], "project string, n_files int")
    none = spark.createDataFrame([], NOTE)
    new = spark.createDataFrame([_note(1, "pdfjs import fails on Node 24", 1), _note(2, "different problem entirely", 2), _note(3, "pdfjs import fails on Node 24 again", 3)], NOTE)
    got = {r["id"]: r["problem"] for r in notes.remember_in_order(none, new, files_).collect()}
    assert got == {"n1": "pdfjs import fails on Node 24 again", "n2": "different problem entirely"}
    cjk = spark.createDataFrame([_note(1, "如何配置 nginx 反向代理", 1), _note(2, "如何配置 nginx 负载均衡", 2)], NOTE)
    assert notes.remember_in_order(none, cjk, files_).count() == 2


def test_notes_fold_in_bounded_batches(spark):
    rnd = random.Random(8)
    old = [_note(i, " ".join(rnd.sample("abcdefghij", 4)), i, f"p{i % 3}") for i in range(30)]
    new = [_note(100 + i, " ".join(rnd.sample("abcdefghijklmnop", 4)) + f" t{i // 2}", 50 + i, f"p{i % 3}") for i in range(400)]
    names = [c.split()[0] for c in NOTE.split(", ")]
    want = set()
    for p in ("p0", "p1", "p2"):
        own = lambda rows: [dict(zip(names, r, strict=True)) for r in rows if r[0] == p]  # noqa: B023, E731
        want |= {(p, n["id"], n["problem"]) for n in notes.fold(own(old), own(new), 60)}
    files_ = spark.createDataFrame([(f"p{k}", 60) for k in range(3)], "project string, n_files int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = notes.remember_in_order(spark.createDataFrame(old, NOTE), spark.createDataFrame(new, NOTE), files_)
        assert {(r["project"], r["id"], r["problem"]) for r in got.collect()} == want
        assert "MapInPandas" in got._jdf.queryExecution().toString() and "FlatMapGroups" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_notes_streamed_equal_the_fold(spark, tmp_path):
    """Three batches with a restart after the first; a project of many distinct notes exceeds its capacity."""
    rnd = random.Random(9)
    rows = [_note(i, rnd.choice("abcdefgh") + f" t{i // 2} u{i // 2} v{i // 2}", i, f"p{min(i % 5, 2)}") for i in range(450)]
    rows += [_note(450, "...", 450, "p0"), _note(451, "如何配置 nginx", 451, "p1")]
    names = [c.split()[0] for c in NOTE.split(", ")]
    want = {(p, n["id"], n["problem"], n["updated_at"]) for p in ("p0", "p1", "p2") for n in notes.fold([], [dict(zip(names, r, strict=True)) for r in rows if r[0] == p], 60)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = NOTE + ", n_files int"
    table, actions = {}, set()

    def apply(batch, _):
        for r in batch.collect():
            actions.add(r["action"])
            table.pop((r["project"], r["id"]), None)
            if r["action"] == "put":
                table[r["project"], r["id"]] = (r["problem"], r["updated_at"])

    for part in (rows[:200], rows[200:230], rows[230:]):
        spark.createDataFrame([(*r, 60) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = notes.remember_stream(stream).writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(p, i, *v) for (p, i), v in table.items()} == want and actions == {"put", "evict"}


def test_notes_batch_and_prune(spark):
    old = spark.createDataFrame([_note(1, "pdfjs import fails on Node 24"), _note(2, "something else here")], NOTE)
    new = spark.createDataFrame([_note(3, "pdfjs import fails on Node 24 again", 5, solution="new")], NOTE)
    got = {r["id"]: (r["problem"], r["solution"]) for r in notes.remember(old, new).collect()}
    assert got["n1"] == ("pdfjs import fails on Node 24 again", "new") and len(got) == 2
    many = spark.createDataFrame([_note(i, f"topic{i} trouble", i) for i in range(130)], NOTE)
    kept = {r["id"] for r in notes.prune(many, spark.createDataFrame([("p", 60)], "project string, n_files int")).collect()}
    assert len(kept) == 120 and "n9" not in kept and "n10" in kept and "n129" in kept


def test_remember_reads_texts_once_and_settles_ties(spark, tmp_path):
    old = [_note(1, "build script breaks on linux"), _note(2, "login page is slow"), _note(3, "...")]
    new = [_note(7, "build script breaks"), _note(7, "script breaks on linux"), _note(8, "..."), _note(9, "login page slow now")]
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, NOTE).write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / name)) for name in ("old", "new"))
    after = notes.remember(old, new)
    got = {(r["id"], r["problem"]) for r in after.collect()}
    ids = {r["problem"]: r["id"] for r in new.select("problem", notes.note_id().alias("id")).collect()}
    first = min(("build script breaks", "script breaks on linux"), key=ids.get)
    assert got == {("n1", first), ("n2", "login page slow now"), ("n3", "..."), (ids["..."], "...")}
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ReadSchema: struct<[^>]*solution", plan)) == 2


def test_forget(spark):
    table = spark.createDataFrame([_note(1, "build script breaks"), _note(2, "login page is slow")], NOTE)
    by_id = notes.forget(table, spark.createDataFrame([("p", "n1")], "project string, query string"))
    assert [r["id"] for r in by_id.collect()] == ["n2"]
    by_words = notes.forget(table, spark.createDataFrame([("p", "slow login"), ("p", "...")], "project string, query string"))
    assert [r["id"] for r in by_words.collect()] == ["n1"]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 1.0])
def test_overlap_by_prefixes_equals_all_pairs(spark, threshold):
    rnd = random.Random(int(threshold * 10))
    words = [f"w{i}" for i in range(40)]

    def side(name, n):
        out = []
        for i in range(n):
            size = rnd.choice([0, 1, 2, 3, 5, 10, 15, 35])
            # a word that nearly all rows have, skewed words, and repeated sets
            own = ["the"] * (rnd.random() < 0.9) + [words[min(int(rnd.expovariate(0.1)), 39)] for _ in range(size)]
            out.append((rnd.choice(["p", "p", "q"]), f"{name}{i}", rnd.randrange(20), list(dict.fromkeys(out[-1][3] if out and rnd.random() < 0.3 else own))))
        return spark.createDataFrame([*out, (None, f"{name}x", 1, ["the"]), ("r", f"{name}y", 1, [name])], "project string, id string, seq long, tokens array<string>")

    left, right = side("l", 120), side("r", 150)
    got = {tuple(r) for r in links.best_overlap(left, right, threshold).collect()}
    assert got == {tuple(r) for r in links.compared_overlap(left, right, threshold).collect()} and len(got) > 60
    assert links.best_overlap(left.limit(0), right, threshold).count() == 0 == links.best_overlap(left, right.limit(0), threshold).count()


def test_overlap_of_copies_is_compared_once(spark):
    """Thousands of equal notes, and a word that all have: candidates are pairs of distinct sets."""
    rows = lambda name, n: spark.range(n).selectExpr("'p' as project", f"concat('{name}', id) as id", "id as seq", "case when id % 3 = 0 then array('the', concat('u', id), 'a', 'b') else array('the', 'same', 'text') end as tokens")
    left, right = rows("l", 3000), rows("r", 3000)
    a, b = (links.distinct_sets(links.keyed_sets(x)) for x in (left, right))
    assert a.count() == 1001
    best = links.best_overlap(left, right)
    assert best.count() == 3000 and best.where("left_id = 'l1'").first()["right_id"] == "r1"
    assert best.where("left_id = 'l300'").first()["right_id"] == "r300"


@pytest.mark.parametrize("threshold", [0.5, 0.6])
def test_overlap_in_tiles_equals_all_pairs(spark, monkeypatch, threshold):
    """Slices and blocks of a few sets, common and rare tokens: what a tile returns is bounded by its sets, not by their pairs."""
    for name, value in (("SETS", 16), ("TOKENS", 90), ("BLOCK", 5), ("WIDTH", 3)):
        monkeypatch.setattr(links, name, value)
    rnd = random.Random(8)
    side = lambda name, n: spark.createDataFrame([("p", f"{name}{i}", rnd.randrange(9), list(dict.fromkeys(f"w{int(rnd.expovariate(0.04))}" for _ in range(rnd.randrange(1, 20))))) for i in range(n)], "project string, id string, seq long, tokens array<string>")
    left, right = side("l", 90), side("r", 110)
    want = links.compared_overlap(left, right, threshold).collect()
    assert {tuple(r) for r in links.best_overlap(left, right, threshold).collect()} == {tuple(r) for r in want} and want
    a, b = (links.distinct_sets(links.keyed_sets(x)).localCheckpoint() for x in (left, right))
    dealt = [df.collect() for df in links._dealt(a, b)]
    assert max(sum(r["i"] == i and r["j"] == 0 for r in dealt[0]) for i in range(9)) < 40 and len({(r["i"], r["j"]) for r in dealt[0]}) > 16
    met = {r["set"] for r in links.met(a, b, threshold).collect()}
    rows = {r["id"]: (set(r["tokens"]), r["set"]) for df in (links.keyed_sets(left), links.keyed_sets(right)) for r in df.collect()}
    pairs = [(x, y) for x, (p, _) in rows.items() for y, (q, _) in rows.items() if x[0] == "l" and y[0] == "r" and len(p & q) / min(len(p), len(q)) >= threshold]
    assert met == {rows[y][1] for _, y in pairs} and len(met) < len(pairs)


def test_slices_are_sent_packed(spark, monkeypatch):
    """What meets a further slice is one row of a few bytes a token, not the sets again: the sets themselves move once."""
    monkeypatch.setattr(links, "SETS", 250)
    rnd = random.Random(4)
    words = [f"token{i}" for i in range(500)]
    side = lambda name: spark.createDataFrame([("p", f"{name}{i}", i, rnd.sample(words, 30)) for i in range(1000)], "project string, id string, seq long, tokens array<string>")
    a, b = (links.distinct_sets(links.keyed_sets(side(x))).localCheckpoint() for x in "lr")
    sets = sum(len(r["set"]) + sum(map(len, r["tokens"])) for r in a.collect())
    for dealt in links._dealt(a, b):
        rows = dealt.collect()
        assert len(rows) == len({(r["i"], r["j"]) for r in rows}) == 16
        assert sum(len(r["packed"]) for r in rows) < 4 * sets / 2


def test_queries_read_all_rows(spark, tmp_path):
    import __spark_entry__ as entry
    from corpusmem import queries as own

    docs = [(i, f"text {i}", "en", "web", 6) for i in range(30)]
    turns = {0: ["user", "assistant"] * 3, 9: ["system"] + ["user", "assistant"] * 2, 13: ["user", "assistant"]}
    talk = [(c, t, role, f"{role}{c}x{t} " + f"only{c}x{t} " * 9 + f"last{c}x{t}") for c, roles in turns.items() for t, role in enumerate(roles)]
    items = [(i, f"ask text {i}") for i in range(4)]
    at = _tables(tmp_path, spark, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), conversations=(talk, "conv_id long, turn int, role string, text string"), benchmark=(items, "item_id long, text string"))
    rows = lambda name: entry.queries()[name](spark, at).collect()
    assert len(rows("s2_extension_routing")) == len(rows("s15_code_first")) == len(rows("s3_size_cap")) == 30
    assert sum(r["entries"] for r in rows("s13_inventory")) == 30 and {(r["path"], r["status"]) for r in rows("s7_change_plan")} > {("d/f13.TXT", "removed")}
    assert {r["query_id"] for r in rows("j4_posting_join")} == {0, 1, 2, 3}
    side = lambda sql: {r["id"] for r in own._rows(spark, at, sql).collect()}
    old, new = side(own.OLD_NOTES), side(own.NEW_NOTES)
    assert old == {"n0", "n4", "n901", "n1300"} and new == {"n2", "n903", "n0c", "n4c"}
    assert {(r["left_id"], r["right_id"]) for r in rows("j3_overlap_join")} == {("n0c", "n0"), ("n4c", "n4")}
    assert len(rows("n1_remember")) == len(rows("n2_remember_in_order")) == 6
    asked = {(r["project"], r["query"]) for r in own._rows(spark, at, own.KEYWORDS).collect()}
    assert asked == {(f"p{(c + 1) % 4}", text) for c, _, role, text in talk if role == "user"}
    assert {r["id"] for r in rows("n5_forget_by_keywords")} == {"n0", "n2", "n4", "n901", "n903", "n1300"}


def test_model_hook(spark):
    entries = spark.createDataFrame([("a", "T", "old", ["t"], "text a"), ("b", "U", "old", ["u"], "text b")], "id string, title string, summary string, keywords array<string>, text string")
    answers = models.ask(entries, lambda texts: ['```json\n{"title":"Payment","summary":"Pays.","keywords":[]}\n```' if t.endswith("a") else "no" for t in texts])
    got = {r["id"]: (r["title"], r["summary"], r["keywords"]) for r in models.entries_with_answers(entries, answers).collect()}
    assert got == {"a": ("Payment", "Pays.", ["t"]), "b": ("U", "old", ["u"])}


def _listing(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, kind string, text string").withColumn("sha256", F.sha2("text", 256)).withColumn("size", F.length("text").cast("long"))


def test_incremental_equals_full(spark):
    first = _listing(spark, [("p", "a.md", "doc", "# A\n\nabout charge"), ("p", "b.py", "code", PY), ("p", "c.md", "doc", "# C"), ("q", "b.py", "code", "def other():")])
    second = _listing(spark, [("p", "a.md", "doc", "# A\n\nabout refund"), ("p", "b.py", "code", PY), ("p", "d.md", "doc", "# D\n\nnew"), ("q", "b.py", "code", "def other():")])
    empty = spark.createDataFrame([], "project string, path string, sha256 string, size long, kind string, indexed_at timestamp")
    drop = lambda df: df.drop("kind")
    plan = index.change_plan(drop(first), empty)
    entries = index.extract(first)
    manifest = index.next_manifest(plan, empty, "2024-01-01")
    again = index.change_plan(drop(second), manifest)
    assert {(r["path"], r["status"]) for r in again.collect()} == {("a.md", "changed"), ("b.py", "unchanged"), ("c.md", "removed"), ("d.md", "new")}
    touched = again.where("status <> 'unchanged'")
    fresh = index.extract(second.join(touched.select("project", "path"), ["project", "path"], "left_semi"))
    assert sorted(map(str, index.upsert(entries, fresh, touched).collect())) == sorted(map(str, index.extract(second).collect()))
    assert index.report(again).where("project = 'p'").first()["removed"] == 1


def test_limits(spark):
    plan = index.change_plan(_listing(spark, [("p", "a.py", "code", "x" * 2000)]).drop("kind"), spark.createDataFrame([], "project string, path string, sha256 string, size long, kind string, indexed_at timestamp"), 0.001)
    assert plan.first()["status"] == "oversize"
    assert Config().chunk_chars == 3000 and Config(refresh_seconds=0).refresh_interval() == 1 and rank.clamp_limit(99) == 20 and rank.clamp_limit(None) == 8


def test_gate_on_a_stream(spark, tmp_path):
    rows = [("f1", "A", 1), ("f1", "B", 2), ("f1", "B", 3), ("f1", "A", 4), ("f2", "A", 5)]
    table = spark.createDataFrame([(p, s, datetime(2024, 1, 1) + timedelta(seconds=q), q) for p, s, q in rows], "path string, sha string, observed_at timestamp, seq long")
    want = sorted(r["seq"] for r in observe.changed_content(table).collect())
    assert want == [1, 2, 4, 5]
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = observe.gate(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_index_on_read(spark, tmp_path):
    rows = [("a.md", "present", 1, "x"), ("a.md", "present", 2, "y"), ("b.md", "absent", 3, "z"), ("", "present", 4, "z")]
    table = spark.createDataFrame([(p, k, datetime(2024, 1, 1) + timedelta(seconds=q), t) for p, k, q, t in rows], "path string, kind string, observed_at timestamp, content string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = observe.index_on_read(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), lambda b: seen.extend(b.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert [(r["path"], r["content"]) for r in seen] == [("a.md", "y")]


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {f"{k}{i}_" for k, n in (("s", 15), ("d", 10), ("y", 9), ("t", 5), ("r", 12), ("j", 4), ("n", 5), ("w", 7)) for i in range(1, n + 1)} <= {n.split("_")[0] + "_" for n in names}


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


@pytest.mark.parametrize("name", ["r4_top_k", "d5_doc_entries"])
def test_entry_runs(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_bad_bytes_and_large_files_never_fail_a_job(spark, tmp_path):
    (tmp_path / "bad.md").write_bytes(b"caf\xff\xc3\xa9")
    (tmp_path / "good.md").write_text("fine")
    (tmp_path / "large.md").write_bytes(b"x" * 3_000)
    listing = files.read_tree(spark, str(tmp_path), max_mb=0.001)
    assert {r["path"]: r["text"] for r in files.read_texts(listing, 0.001).collect()} == {"bad.md": "caf�é", "good.md": "fine"}
    assert {r["path"]: r["content"] is None for r in listing.collect()} == {"bad.md": False, "good.md": False, "large.md": True}
    assert [(r["path"], r["reason"]) for r in files.rejected(listing, 0.001).collect()] == [("large.md", "too large")]


def test_cut_points():
    words = "aa bb cc dd ee"
    assert [words[a:b] for a, b in chunk.cuts(words, 6)] == ["aa bb", "cc dd", "ee"]
    assert [(a, b) for a, b in chunk.cuts("x" * 25, 10)] == [(0, 10), (10, 20), (20, 25)]
    lines = "one two\n\nthree four five"
    assert [lines[a:b] for a, b in chunk.cuts(lines, 12)] == ["one two", "three four", "five"]
    assert chunk.split_block(lines, 5, 12, 40) == [{"text": "one two", "line": 5}, {"text": "three four", "line": 6}, {"text": "five", "line": 7}]
