"""Whole jobs over a stored memory, on small trees."""

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusmem.config import Config
from corpusmem.functions.text import entry_text
from corpusmem.operators import links, rank
from corpusmem.plans import index, jobs, postings

PY = "class PaymentService:\n    def charge(self, amount):\n        return amount\n"
FIRST = {("p", "a.md"): "# Fees\n\nabout charge and PaymentService", ("p", "b.py"): PY, ("p", "c.md"): "# Gone", ("q", "a.md"): "# Other\n\ncharge here too"}
SECOND = {("p", "a.md"): "# Fees\n\nabout refunds", ("p", "b.py"): PY, ("p", "d.md"): "# Fresh\n\nPaymentService again"}


def _listing(spark, files):
    rows = [(p, f, hashlib.sha256(t.encode()).hexdigest(), len(t), t) for (p, f), t in files.items()]
    return spark.createDataFrame(rows, "project string, path string, sha256 string, size long, text string")


def _state(store):
    drop = {"entries": [], "links": [], "manifest": ["indexed_at"]}
    return {name: sorted(map(str, store.table(name).drop(*cols).collect())) for name, cols in drop.items()}


@pytest.fixture
def store(spark, tmp_path):
    return jobs.MemoryStore(spark, str(tmp_path / "memory"))


def test_index_twice_equals_index_once(spark, store, tmp_path):
    got = {r["project"]: r for r in jobs.index_listing(store, _listing(spark, FIRST), "2024-01-01").collect()}
    assert (got["p"]["docs"], got["p"]["code"], got["p"]["files"], got["p"]["entries"]) == (2, 1, 3, 4)
    assert got["p"]["links"] == 2 and got["q"]["links"] == 0  # a document is linked to symbols of its own project only
    again = jobs.index_listing(store, _listing(spark, SECOND), "2024-01-02").where("project = 'p'").first()
    assert (again["docs"], again["skipped"], again["removed"], again["files"], again["links"]) == (2, 1, 1, 3, 1)
    whole = jobs.MemoryStore(spark, str(tmp_path / "whole"))
    jobs.index_listing(whole, _listing(spark, SECOND | {("q", "a.md"): FIRST["q", "a.md"]}), "2024-01-02")
    assert _state(store) == _state(whole)
    assert store.version() == 2


def test_lost_job_changes_nothing(spark, store):
    jobs.index_listing(store, _listing(spark, FIRST), "2024-01-01")
    before = _state(store)
    store.put("manifest", store.table("manifest").limit(0))  # lost before its commit
    fresh = jobs.MemoryStore(spark, store.path)
    assert _state(fresh) == before
    jobs.index_listing(fresh, _listing(spark, FIRST), "2024-01-02")
    assert _state(fresh) == before


def test_single_documents(spark, store):
    jobs.index_listing(store, _listing(spark, FIRST), "2024-01-01")
    asked = spark.createDataFrame([("p", "a.md"), ("p", "b.py"), ("p", "no.md")], "project string, path string")
    got = {r["path"]: r for r in jobs.index_documents(store, _listing(spark, SECOND), asked, "2024-01-02").collect()}
    assert set(got) == {"a.md", "b.py"}
    assert got["a.md"]["status"] == "changed" and got["a.md"]["preview"] == ["- Fees @ a.md:1"]
    assert got["b.py"]["status"] == "unchanged" and got["b.py"]["preview"] is None and got["b.py"]["n_entries"] == 2
    assert store.table("manifest").count() == 4  # files outside the request stay


def test_poll(spark, store):
    def listed(files, times):
        return spark.createDataFrame([(p, f, float(times.get(f, 1)), len(t)) for (p, f), t in files.items()], "project string, path string, mtime double, size long")

    asked = []

    def reader(files):
        def read(look):
            asked.append(sorted(r["path"] for r in look.collect()))
            return _listing(spark, files).join(look.select("project", "path"), ["project", "path"], "left_semi")

        return read

    own = {k: v for k, v in FIRST.items() if k[0] == "p"}
    jobs.poll(store, listed(own, {}), reader({k: v for k, v in own.items() if k[1] != "a.md"}), "2024-01-01")
    assert {r["path"] for r in store.table("manifest").collect()} == {"b.py", "c.md"}  # a.md could not be read
    plan = jobs.poll(store, listed(SECOND, {}), reader(SECOND), "2024-01-02")
    assert asked == [["a.md", "b.py", "c.md"], ["a.md", "d.md"]]  # the failed file is tried again, the unchanged one not read
    assert {r["path"]: r["status"] for r in plan.collect()} == {"a.md": "new", "c.md": "removed", "d.md": "new"}
    assert {r["path"] for r in store.table("entries").collect()} == {"a.md", "b.py", "d.md"}
    jobs.poll(store, listed(SECOND, {"b.py": 2}), reader({}), "2024-01-03")
    assert {r["path"] for r in store.table("entries").collect()} == {"a.md", "b.py", "d.md"}  # failed files keep their entries
    done = jobs.refresh_paths(store, spark.createDataFrame([("p", "b.py")], "project string, path string"), reader({("p", "b.py"): "def other():\n    pass\n"}), "2024-01-04")
    assert done.first()["status"] == "changed" and [r["title"] for r in store.table("entries").where("path = 'b.py'").collect()] == ["other (function)"]


def test_read_time_index(spark, store, tmp_path, monkeypatch):
    """Events of a stream are indexed below their roots; a batch lost before its commit is done once, a restart goes on."""
    files = {("p", "a.md"): "# Fees\n\nabout charge", ("p", "b.py"): PY, ("q", "c.md"): "# Inner"}
    jobs.watch(store, spark.createDataFrame([("p", "/w/p"), ("q", "/w/p/in"), ("r", "/w/r")], "project string, root string"))
    kept = jobs.watch(store, spark.createDataFrame([], "project string, root string"), spark.createDataFrame([("/w/r",)], "root string"))
    assert sorted(r["root"] for r in kept.collect()) == ["/w/p", "/w/p/in"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, reads = "path string, kind string, sha string, observed_at timestamp, seq long", []

    def read(look):
        reads.append(sorted((r["project"], r["path"]) for r in look.collect()))
        return _listing(spark, files).join(look, ["project", "path"], "left_semi")

    def run(events):
        rows = [(p, k, s, datetime(2024, 1, 1, 0, 0, q), q) for p, k, s, q in events]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.read_time_index(store, stream, read, str(tmp_path / "cp"), once=True).awaitTermination(120)

    first = [("/w/p/a.md", "present", "1", 1), ("/w/p/b.py", "present", "1", 2), ("/w/p/in/c.md", "present", "1", 3), ("/w/r/d.md", "present", "1", 4), ("/w/p/e.md", "absent", "1", 5), ("/w/px/f.md", "present", "1", 6), (None, "present", "1", 7)]
    commit = jobs.MemoryStore.commit
    monkeypatch.setattr(jobs.MemoryStore, "commit", lambda *a: 1 / 0)  # lost between write and commit
    with pytest.raises(Exception, match="division"):
        run(first)
    assert store.table("entries").count() == 0 and store.last_batch("reads") == -1
    monkeypatch.setattr(jobs.MemoryStore, "commit", commit)
    run([("/w/p/a.md", "present", "1", 8)])  # the lost batch comes again, then one that stops at the gate
    assert reads[0] == reads[1] == [("p", "a.md"), ("p", "b.py"), ("q", "c.md")] and all(not r for r in reads[2:])
    assert {(r["project"], r["path"]) for r in store.table("manifest").collect()} == set(files)
    files["p", "a.md"] = "# Fees\n\nabout refunds"
    run([("/w/p/a.md", "present", "2", 9)])
    assert reads[-1] == [("p", "a.md")]
    whole = jobs.MemoryStore(spark, str(tmp_path / "whole"))
    jobs.index_listing(whole, _listing(spark, files), "2024-01-01")
    assert _state(store) == _state(whole)
    version, batch = store.version(), spark.createDataFrame([("/w/p/b.py", datetime(2024, 1, 2))], "path string, observed_at timestamp")
    assert not jobs.observed_batch(store, batch, store.last_batch("reads"), read, "2024-01-02") and store.version() == version


def test_answers(spark, store):
    jobs.index_listing(store, _listing(spark, FIRST), "2024-01-01")
    note = spark.createDataFrame([("p", "n1", 1, "charge fails on retry", "use a key", "b.py")], "project string, id string, seq long, problem string, solution string, source_file string")
    at = F.lit("2024-02-03 04:05:06").cast("timestamp")
    store.put("notes", note.withColumn("created_at", at).withColumn("updated_at", at))
    store.commit()
    asked = spark.createDataFrame([(1, 0, "charge fees"), (2, 0, "zebra"), (3, 0, None)], "query_id int, variant int, text string")
    got = {r["query_id"]: r["answer"] for r in jobs.answers(store, asked, "p").collect()}
    assert got[1].startswith("## Memory (docs + symbols)\n\n### Fees (score: 100)\n- source: a.md:1\n- ")
    assert "\n\n- references: PaymentService (class) @ b.py:1; charge (function) @ b.py:2" in got[1]
    assert got[1].endswith("## Experience (past problems -> solutions)\n\n### Problem: charge fails on retry (score: 100, id: n1)\n- solution: use a key (source: b.py)\n- updated: 2024-02-03T04:05:06.000Z")
    stock = "\nThe memory of p holds 3 files, 4 entries, 1 notes."
    assert got[2] == f'No memory matches for "zebra" in p.{stock}' and got[3] == f'No memory matches for "" in p.{stock}'
    alone = jobs.answers(store, asked, "p", layer="experience", config=Config(max_output_chars=20)).where("query_id = 1").first()["answer"]
    assert alone == "## Experience (past \n\n...[truncated at 20 chars]"


def test_links_by_project_equal_links_of_each(spark):
    files = _listing(spark, FIRST | {("q", "b.py"): PY}).withColumn("kind", F.when(F.col("path").endswith(".py"), "code").otherwise("doc"))
    entries = index.extract(files)
    both = {tuple(r) for r in links.links(entries, keys=("project",)).collect()}
    one = {(p, *r) for p in "pq" for r in links.links(entries.where(F.col("project") == p)).collect()}
    assert both == one and {p for p, *_ in both} == {"p", "q"}


def test_one_changed_file_writes_only_its_buckets(spark, store, tmp_path):
    many = {("p", f"d{i}.md"): f"# Topic {i}\n\nabout charge {i}" for i in range(300)} | {("p", "b.py"): PY}
    jobs.index_listing(store, _listing(spark, many), "2024-01-01")
    whole = {n: len(store._list(f"{n}/v=1")) for n in ("entries", "links", "manifest")}
    assert whole["entries"] > 40
    changed = many | {("p", "d7.md"): "# Topic 7\n\nabout refunds"}
    jobs.index_listing(store, _listing(spark, changed), "2024-01-02")
    for name in ("entries", "links", "manifest"):
        assert [b for b in store._list(f"{name}/v=2") if b.startswith("bucket=")] == [f"bucket={store.buckets_of(spark.createDataFrame([('p', 'd7.md')], 'project string, path string'))[0]}"]
    rebuilt = jobs.MemoryStore(spark, str(tmp_path / "rebuilt"))
    jobs.index_listing(rebuilt, _listing(spark, changed), "2024-01-02")
    assert _state(store) == _state(rebuilt)
    before = _state(store)
    assert store.vacuum() > 0 and _state(store) == before and store.version() == 2
    renamed = changed | {("p", "b.py"): PY.replace("charge", "refunds")}  # names change: links of other files, too
    jobs.index_listing(store, _listing(spark, renamed), "2024-01-03")
    again = jobs.MemoryStore(spark, str(tmp_path / "again"))
    jobs.index_listing(again, _listing(spark, renamed), "2024-01-03")
    assert _state(store) == _state(again) and store.table("links").count() == 1


def test_pages_are_indexed_and_bytes_are_not(spark, store):
    listing = _listing(spark, {("p", "a.md"): "# A", ("p", "x.pdf"): "%PDF-1.4 stream", ("p", "long.pdf"): "%PDF"})
    pages = spark.createDataFrame([("p", "x.pdf", 2, "second about fees"), ("p", "x.pdf", 1, "first"), *[("p", "long.pdf", k, "t") for k in range(4)]], "project string, path string, page int, text string")
    report = jobs.index_listing(store, listing, "2024-01-01").first()
    assert (report["docs"], report["failed"]) == (1, ["long.pdf", "x.pdf"])
    assert {r["path"] for r in store.table("entries").collect()} == {"a.md"}
    report = jobs.index_listing(store, listing, "2024-01-02", Config(max_pages=3), pages=pages).first()
    assert (report["docs"], report["failed"]) == (1, ["long.pdf"])
    assert [(r["title"], r["source_line"]) for r in store.table("entries").where("path = 'x.pdf'").orderBy("seq").collect()] == [("Page 1", 1), ("Page 2", 5)]


def test_notes_and_many_projects(spark, store):
    jobs.index_listing(store, _listing(spark, FIRST), "2024-01-01")
    new = spark.createDataFrame([("p", 1, "login is slow on mondays", "cache it", None), ("p", 2, "login is slow on mondays again", "cache more", "b.py"), ("q", 1, "charge fails", "retry", None)], "project string, seq long, problem string, solution string, source_file string")
    got = {r["project"]: r["notes"] for r in jobs.remember(store, new, "2024-02-01").collect()}
    assert got == {"p": 1, "q": 1}  # the second note takes the place of the first
    asked = spark.createDataFrame([(1, 0, "charge", "p"), (2, 0, "charge", "q"), (3, 0, "zebra", "q")], "query_id int, variant int, text string, project string")
    answers = {r["query_id"]: r["answer"] for r in jobs.answers(store, asked).collect()}
    assert "Fees" in answers[1] and "Other" not in answers[1] and "charge fails" not in answers[1]
    assert "Other" in answers[2] and "Fees" not in answers[2] and "charge fails" in answers[2]
    assert answers[3] == 'No memory matches for "zebra" in q.\nThe memory of q holds 1 files, 1 entries, 1 notes.'
    more = spark.createDataFrame([(3, '["zebra", "charge"]')], "query_id int, answer string")
    wider = jobs.answers(store, asked, config=Config(expand_queries=True), expansions=more).where("query_id = 3").first()["answer"]
    assert "Other" in wider
    gone = jobs.forget(store, spark.createDataFrame([("p", "slow login"), ("q", "nothing like it")], "project string, query string"))
    assert {r["project"]: r["forgotten"] for r in gone.collect()} == {"p": 1, "q": 0} and store.table("notes").count() == 1


def _found(hits):
    return sorted((r["query_id"], r["pool"], r["rank"], r["id"], round(r["score"], 5)) for r in hits.collect())


def test_stored_index_equals_search_over_texts(spark, store):
    """Random inserts, changes and deletions: scores are those of the texts, counts those of a rebuild."""
    rng, words = random.Random(5), ["fee", "charge", "refund", "ledger", "retry", "key", "中文", "x_1"]
    files, numbers = {}, []
    for day in range(1, 5):
        for _ in range(4 if day > 1 else 30):
            path = (rng.choice("pq"), f"d{rng.randrange(40)}.md")
            files[path] = "\n\n".join(f"# {rng.choice(words)}\n\n{' '.join(rng.choices(words, k=rng.randrange(1, 30)))}" for _ in range(rng.randrange(1, 4)))
        for path in rng.sample(sorted(files), 2) if day > 1 else []:
            del files[path]
        jobs.index_listing(store, _listing(spark, files), f"2024-01-0{day}")
        numbers.append(sorted(store.segments()))
    assert numbers[:2] == [[1], [1, 2]] and len(numbers[-1]) < 4  # segments of about one size have merged
    asked = spark.createDataFrame([(1, 0, "fee ledger", "p"), (1, 1, "refund", "p"), (2, 0, "charge key 中文", "q"), (3, 0, "zebra", "q"), (4, 0, " ".join(words), "p"), (5, 0, None, "p")], "query_id int, variant int, text string, pool string")
    entries = store.table("entries").withColumn("id", postings.ident("id", "path")).withColumn("pool", F.col("project"))
    for kinds in (("doc", "symbol"), ("symbol",)):
        want = _found(rank.search(asked, entries.where(F.col("type").isin(*kinds)), entry_text(), 20))
        assert _found(postings.search(store, asked, kinds, 20)) == want and bool(want) == ("doc" in kinds)
    rows = lambda df: sorted(map(str, df.select("term", "project", "type", "df", "total").collect()))
    want = rows(postings.counted(postings.posted(store.table("entries"))))
    assert rows(postings.summed(store.table("frequencies"))) == want
    assert {r["version"] for r in postings.live(store.table("postings"), store.table("tombstones")).collect()} <= set(range(1, 5))
    postings.update(store, store.table("entries").limit(0), store.table("entries"), store.table("manifest"))  # lost before its commit
    assert rows(postings.summed(jobs.MemoryStore(spark, store.path).table("frequencies"))) == want
    store = jobs.MemoryStore(spark, store.path)
    postings.rebuild(store)
    store.commit()
    assert len(store.segments()) == 1 and rows(store.table("frequencies")) == want and store.table("tombstones").isEmpty()
    before = _found(postings.search(store, asked, ("doc",), 20))
    assert store.vacuum() > 0 and _found(postings.search(store, asked, ("doc",), 20)) == before


def test_answers_tokenise_no_entry(spark, store, monkeypatch):
    jobs.index_listing(store, _listing(spark, FIRST), "2024-01-01")
    monkeypatch.setattr(postings, "entry_text", None)
    asked = spark.createDataFrame([(1, 0, "charge fees")], "query_id int, variant int, text string")
    assert "### Fees (score: 100)" in jobs.answers(store, asked, "p").first()["answer"]


def test_segments_to_merge():
    assert postings.to_merge({}) == [] and postings.to_merge({1: 5}) == [] and postings.to_merge({1: 100, 2: 5}) == []
    assert postings.to_merge({1: 100, 2: 5, 3: 4}) == [3, 2] and postings.to_merge({1: 10, 2: 5, 3: 4}) == [3, 2, 1]
    sizes = {}
    for n in range(1, 200):  # a segment of one unit each time
        merged = postings.to_merge(sizes)
        sizes = {k: v for k, v in sizes.items() if k not in merged} | {n: 1 + sum(sizes[k] for k in merged)}
    assert sum(sizes.values()) == 199 and len(sizes) < 10


def test_model_answers_are_asked_once(spark, store, tmp_path):
    asked, down = str(tmp_path / "asked"), str(tmp_path / "down")

    def model(texts):
        with open(asked, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        with open(down) as f:
            failing = f.read()
        return [None if failing and failing in t else '{"title": "T %d", "summary": "About %s.", "keywords": ["k"]}' % (len(t), t[-7:]) for t in texts]

    def run(files, day, failing=""):
        open(down, "w").write(failing), open(asked, "w").close()
        report = jobs.index_listing(store, _listing(spark, files), day, model=model).first()
        return report, sorted(open(asked).read().splitlines())

    files = {("p", "a.md"): "# Fees\n\nabout refunds", ("p", "b.md"): "# Fees\n\nabout refunds", ("p", "c.md"): "# Late\n\nabout charges"}
    assert run(files, "2024-01-01", "Late")[1] == ["# Fees  about refunds", "# Late  about charges"]  # equal chunks once
    rows = lambda: {r["path"]: (r["id"], r["title"], r["summary"]) for r in store.table("entries").collect()}
    assert rows() == {"a.md": ("a.md#0", "T 21", "About refunds."), "b.md": ("b.md#0", "T 21", "About refunds."), "c.md": ("c.md#0", "Late", "# Late about charges")}
    assert [r["path"] for r in store.table("waiting").collect()] == ["c.md"]
    report, again = run(files, "2024-01-02")
    assert again == ["# Late  about charges"] and (report["docs"], report["skipped"]) == (1, 2)  # what failed is asked again
    assert rows()["c.md"] == ("c.md#0", "T 21", "About charges.") and store.table("waiting").isEmpty()
    report, third = run(files | {("p", "d.md"): "# Late\n\nabout charges"}, "2024-01-03")
    assert third == [] and rows()["d.md"][1:] == ("T 21", "About charges.")  # a chunk that another file had
    found = jobs.answers(store, spark.createDataFrame([(1, 0, "T")], "query_id int, variant int, text string"), "p").first()["answer"]
    assert found.count("### T 21") == 4
