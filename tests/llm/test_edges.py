"""Edges of the corpus operators: patterned strings, odd arguments, clashing names, long texts, unstable inputs."""

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmem.llm import bm25_search, chat_tools, fair_mix, jaccard_join, lang_id, merkle, rlbwt_dedup, token_count, util, vocab
from corpusmem.llm.queries import tokenizer_path


def thue_morse(a, b, n):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("name,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_patterned_strings_are_told_apart(name, words):
    path = tokenizer_path(name)
    texts = [w for letters in ("th", "er", "ou") for n in (64, 1024, 2048) for w in thue_morse(*letters, n)]
    texts += [f"{a} {b}" for a, b in zip(texts[::2], texts[1::2], strict=True)] + ["x", "", None]
    tok, encoder, i = vocab.load(path), vocab.Encoder(path, vocab.whole_tokens(path), words), 0
    for _, counts, ids in encoder.batches(pa.array(texts), want_ids=True):
        at = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(at, at[1:], strict=False):
            assert ids[a:b].tolist() == tok.encode(texts[i] or "", add_special_tokens=False).ids
            i += 1
    assert i == len(texts)


def test_patterned_words_have_different_hashes():
    text = " ".join(w for n in (64, 1024, 2048) for w in thue_morse("t", "h", n)).encode()
    hashes, _, _ = util.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(set(hashes.tolist())) == 6


def test_memo_entries_are_compared():
    a, b = np.frombuffer(b"abcdab", np.uint8).astype(np.uint32), np.frombuffer(b"abxab", np.uint8).astype(np.uint16)
    at = np.array([0, 0, 4, 2])
    assert vocab._differ(a, at, np.array([2, 3, 2, 0]), b, np.array([0, 0, 3, 1]), np.array([2, 3, 2, 0])).tolist() == [False, True, False, False]


def test_links_are_counted(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:-1], "end"]
    rows = [(1, base), (2, base), (3, near), (4, near), (5, near), (6, [f"v{i}" for i in range(60)]), (7, ["one"]), (8, ["one"])]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(9, None), (None, " ".join(base))], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.similar(table).collect()}
    assert got == {1: (1, 4), 2: (1, 4), 3: (1, 4), 4: (1, 4), 5: (1, 4), 6: (6, 0), 7: (7, 1), 8: (7, 1), 9: (9, 0), None: (None, 0)}


def test_arguments_that_json_text_cannot_say(spark):
    schema = "conv_id long, turn long, role string, kind string, call_id string, name string, content string, after array<string>"
    odd = ['{"query":"\\ud800"}', '{"query":' + "[" * 100_000 + "]" * 100_000 + "}", '{"query":NaN}', '{"query":1e999}', "{", None]
    table = spark.createDataFrame([(i, 1, "user", "call", "a", "search", x, None) for i, x in enumerate(odd)], schema)
    for r in chat_tools.format_chats(table, chat_tools.SCHEMAS).collect():
        assert (r["n_calls"], r["n_valid"]) == (1, 0)
        assert json.loads(r["chat"])["items"][0]["arguments"] == odd[r["conv_id"]]
    lone = spark.createDataFrame([(None, 1, "user", "message", None, None, "a", None)] * 3, schema)
    assert [r["conv_id"] for r in chat_tools.format_chats(lone, {}).collect()] == [None] * 3


def test_fingerprints_tell_texts_apart(spark):
    texts = ["a\n\nb", "a\n\n\nb", "a\n\n\n\nb", "a\x01b", "a\x01\x01b", "a\nb", "ab", "", "\n", "\n\n", "x. " * 400, "x. " * 401, "x. "]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = [r[0] for r in table.select(merkle.fingerprint(F.col("text"))).collect()]
    assert len({p[:64] for p in prints}) == len(texts)
    pairs = spark.createDataFrame([(a, b) for a in prints for b in prints], "a string, b string")
    for r in pairs.select("a", "b", merkle.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        x, y = (Counter(p[i : i + 8] for part in r[k][65:].replace("|", ",").split(",") for p in [part[32:]] for i in range(0, len(p), 8)) for k in "ab")
        assert r["l"] == (1.0 if r["a"] == r["b"] else pytest.approx(2 * (x & y).total() / (x.total() + y.total() + 2)))


def test_fingerprints_of_an_unstable_input_lose_no_row(spark):
    table = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(3).limit(9)
    assert merkle.compare_edited(table.union(table)).count() == 18


def test_edited_places(spark):
    table = spark.createDataFrame([(1, "one.\ntwo.\n\nthree.\nfour."), (2, "other text here")], "doc_id long, text string")
    got = {r["doc_id"]: r["edits"] for r in merkle.compare_edited(table).collect()}
    assert got[1] == "1.1"  # 5 of 23 characters are replaced: the last line


def test_long_text_is_counted_in_slices(monkeypatch):
    text = "Die schnelle Füchsin springt über den Zaun. " * 40
    whole = np.bincount(lang_id._grams(lang_id._codes(text)), minlength=lang_id.BUCKETS)
    for size in (7, 100, 10**6):
        monkeypatch.setattr(lang_id, "SLICE", size)
        assert (lang_id.gram_counts(text) == whole).all()


def test_language_by_brute_force(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {la: sum(lang_id.gram_counts(t) for _, t, x in rows if x == la) + 0.5 for la in ("de", "en", "fr")}
    asked = ["the dog", "le chien", "die katze", "chat and hund", "123", None]
    got = lang_id.predict(spark.createDataFrame([(i, t, "kept") for i, t in enumerate(asked)], "i long, text string, score string"), lang_id.train(table), into=("l", "p")).orderBy("i").collect()
    for r in got[:4]:
        sums = {la: (lang_id.gram_counts(r["text"]) * np.log(c / c.sum())).sum() for la, c in counts.items()}
        best = max(sums, key=sums.get)
        assert r["l"] == best and r["p"] == pytest.approx(1 / sum(np.exp(v - sums[best]) for v in sums.values())) and r["score"] == "kept"
    assert [(r["l"], r["p"]) for r in got[4:]] == [("und", 0.0)] * 2
    with pytest.raises(ValueError):
        lang_id.predict(table.withColumn("score", F.lit(1)), lang_id.Model([], np.zeros((1, 0)), np.zeros(0)))


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    names = ("size", "target", "taken", "copies", "source_size", "score", "lang_pred", "id", "chunk", "spans", "row", "uid")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    odd = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = util.stored(table.unionByName(table.limit(5)).unionByName(odd, allowMissingColumns=True))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = util.stored(stage(spark, docs, ""))
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*names).distinct().collect()} <= {tuple(f"own {n}" for n in names), (None,) * len(names)}
        assert stage(spark, docs.limit(0), "").count() == 0
        assert out.count() > 0


def test_search_by_steps(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 300)) for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    asked = table.where("doc_id % 7 = 0")
    want = [tuple(r) for r in bm25_search.top_k(table, asked, 4).orderBy("query_id", "rank").collect()]
    for shard, terms, block, step in ((2_000, 500, 4, 3), (9_000, 10**6, 32, 1000)):
        for k, v in (("SHARD_BYTES", shard), ("QUERY_TERMS", terms), ("DOC_BLOCK", block), ("_STEP", step)):
            monkeypatch.setattr(bm25_search, k, v)
        assert [tuple(r) for r in bm25_search.top_k(table, asked, 4).orderBy("query_id", "rank").collect()] == want


def test_search_sends_few_rows(spark, monkeypatch):
    """Over many shards a query's hits are those above its floor, not k a shard; floors leave out no hit, ties included."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(5, 60)) % 300) for _ in range(600)]
    table = spark.createDataFrame([(i, texts[i % 590]) for i in range(600)], "doc_id long, text string")
    asked = table.where("doc_id % 20 = 0")
    want = [tuple(r) for r in bm25_search.top_k(table, asked, 4).orderBy("query_id", "rank").collect()]
    made, store = [], util.Work.store

    def counted(work, df):
        out = store(work, df)
        if out.columns == ["query_id", "id", "score"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(util.Work, "store", counted)
    monkeypatch.setattr(bm25_search, "SHARD_BYTES", 2_000)
    assert [tuple(r) for r in bm25_search.top_k(table, asked, 4).orderBy("query_id", "rank").collect()] == want
    assert len(want) == 120 and 120 <= sum(made) < 120 * 18


def test_cut_texts(spark):
    long = "This sentence has rather more than fifty bytes in it, surely. "
    table = spark.createDataFrame([(1, "a" + long, "x"), (2, long + "é", "y"), (3, None, "z")], "doc_id long, text string, spans string")
    cut = {r["doc_id"]: (r["text"], r["spans"]) for r in rlbwt_dedup.mark_repeats(table, keep=("spans",), cut_texts=True).collect()}
    assert cut == {1: ("a" + long, "x"), 2: ("é", "y"), 3: ("", "z")}


def test_mixed_documents(spark):
    table = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2], "own") for i in range(80)], "doc_id long, text string, source string, size string")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in fair_mix.mix(table).collect() if r["taken"]}
    rows = fair_mix.mixed_documents(table).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(taken) and {r["size"] for r in rows} == {"own"}
    assert token_count.count_tokens(table.limit(0), tokenizer_path("byte_bpe_50k.json")).collect() == []


def test_queries_are_packed_in_parts(spark, monkeypatch):
    """A block of queries is merged from packed parts: never are all its (query, term) pairs in order at once."""
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 40, 90)
    term = np.concatenate([rng.choice(500, n, replace=False) for n in sizes]).astype(np.int64) * 7
    idf, ids = np.sqrt(term % 13), np.arange(90) * 3
    edge = np.concatenate([[0], np.cumsum(sizes)])
    part = lambda x, y: bm25_search.packed_queries(ids[x:y], sizes[x:y], term[edge[x] : edge[y]], idf[edge[x] : edge[y]])
    one, four = part(0, 90), bm25_search.merged_queries([part(0, 20), part(20, 21), part(21, 60), part(60, 90)])
    assert all((one[k] == four[k]).all() for k in one)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(5, 60)) % 300)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for parts, terms in ((1, 10**6), (4, 10**6), (3, 900)):
        monkeypatch.setattr(bm25_search, "PARTS", parts)
        monkeypatch.setattr(bm25_search, "QUERY_TERMS", terms)
        results.append([tuple(r) for r in bm25_search.top_k(table, table.where("doc_id % 3 = 0"), 4).orderBy("query_id", "rank").collect()])
    assert results[0] == results[1] == results[2] and results[0]


def test_repeats_are_dealt_in_few_rows(spark, monkeypatch):
    """Rows that chunks send grow with groups of buckets, not with buckets, and marks stay the same."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 9))
    common = [" ".join(word() for _ in range(9)) for _ in range(40)]
    table = spark.createDataFrame([(i, " ".join([word(), common[i % 40], word(), common[(7 * i) % 40]])) for i in range(200)], "doc_id long, text string")
    want = sorted(map(str, rlbwt_dedup.mark_repeats(table).collect()))
    rows, store = [], util.Work.store

    def counted(work, df):
        out = store(work, df)
        if "places" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(util.Work, "store", counted)
    monkeypatch.setattr(rlbwt_dedup, "CHUNK_BYTES", 5_000)
    monkeypatch.setattr(rlbwt_dedup, "BUCKET_BYTES", 600)
    assert sorted(map(str, rlbwt_dedup.mark_repeats(table).collect())) == want
    chunks, buckets = -(-sum(len(r["text"]) for r in table.collect()) // 5_000), -(-sum(len(r["text"]) for r in table.collect()) // 600)
    assert 0 < rows[0] <= chunks * -(-buckets // 8)
