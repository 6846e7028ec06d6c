"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmem.llm import bm25_search, chat_tools, fair_mix, html_extract, jaccard_join, lang_id, merkle, packing, rlbwt_dedup, token_count
from corpusmem.llm.components import components
from corpusmem.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, chunk int"


def base():
    rnd = random.Random(5)
    vocab = ["alpha", "Beta", "gamma", "déjà", "of", "the", "and", "über", "x1", "tion.", "'s", "don't", "日本"]
    word = lambda: rnd.choice(vocab) if rnd.random() < 0.5 else "".join(rnd.choice("aeioustrn") for _ in range(rnd.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(30)
    out = []
    for i in range(40):
        t = text(rnd.choice([1, 2, 5, 40, 120]))
        if i % 4 == 0:
            t = t[: len(t) // 2] + " " + shared + "\n\n" + t[len(t) // 2 :]
        out.append([i, t, ["en", "fr"][i % 2], f"s{i % 3}"])
    long = text(6000)
    out += [[50, None, "en", None], [51, "", None, "s0"], [52, " \n ", "en", "s1"], [53, "123 !!", "fr", "s1"], [54, long, "en", "s0"], [55, long, "en", "s0"]]
    words = text(200).split()
    for k in range(12):  # near copies
        w = list(words)
        for _ in range(k % 5):
            w[rnd.randrange(len(w))] = "zz%d" % rnd.randrange(99)
        out.append([60 + k, " ".join(w), "en", "s2"])
    return [(i, t, la, s, len(t or ""), 7, "clash", 3) for i, t, la, s in out]


@pytest.fixture(scope="module")
def rows():
    return base()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100), (95, 95), (100, 101)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90, 101: 90}


def test_language(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in lang_id.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, t or "")))
        assert 0 <= got[i]["score"] <= 1
    assert lang_id.identify(empty).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_id.identify(unlabelled).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lang_id.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_search(docs, rows, empty):
    got = defaultdict(list)
    for r in bm25_search.top_k(docs, docs.where("doc_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    bags = {i: Counter(split(t)) for i, t, *_ in rows}
    n, avg = len(rows), sum(sum(b.values()) for b in bags.values()) / len(rows)
    df = Counter(w for b in bags.values() for w in b)
    for q in [i for i in bags if i % 20 == 0]:
        scores = []
        for d, b in bags.items():
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg)) for w in bags[q] if w in b)
            if s:
                scores.append((-round(s, 6), d))
        assert got[q] == [(d, -s) for s, d in sorted(scores)[:5]]
    assert bm25_search.top_k(empty, empty).collect() == []


def brute_links(rows, num, den, size):
    sets = {}
    for i, t, *_ in rows:
        w = split(t)
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("threshold,size,block", [((90, 100), 3, 1000), ((90, 100), 3, 3), ((80, 100), 5, 4)])
def test_jaccard(docs, rows, threshold, size, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(docs, threshold, size).collect()}
    assert got == brute_links(rows, *threshold, size)


def test_jaccard_random(spark):
    rnd = random.Random(9)
    origin = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([9, 20, 60, 150]))] for _ in range(6)]
    rows = []
    for k in range(150):
        w = list(rnd.choice(origin))
        for _ in range(rnd.randrange(0, 1 + len(w) // 20)):
            p = rnd.randrange(len(w))
            w[p : p + rnd.randrange(2)] = [f"n{rnd.randrange(9)}"]
        rows.append((k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(table).collect()}
    assert got == brute_links(rows, 90, 100, 3)


@pytest.mark.parametrize("broadcast", [jaccard_join.BROADCAST_IDS, 0])
def test_keep_one(spark, docs, rows, empty, monkeypatch, broadcast):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", broadcast)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {c for _, c in brute_links(rows, 90, 100, 3).values()}
    assert jaccard_join.similar(empty).collect() == []


def test_chat_tools(spark):
    schema = "conv_id long, turn long, role string, kind string, call_id string, name string, content string, after array<string>"
    messages = [
        (1, 0, "system", "message", None, None, "hi", None),
        (1, 1, "assistant", "call", "b", "search", '{"query":"x"}', ["a"]),
        (1, 2, "assistant", "call", "a", "search", '{"limit":3,"query":"y"}', []),
        (1, 3, "tool", "result", "a", None, "ra", None),
        (1, 4, "tool", "result", "a", None, "again", None),
        (1, 5, "assistant", "call", "c", "search", '{"limit":"3"}', ["c", "zz"]),
        (1, 6, "tool", "result", "q", None, "loose", None),
        (None, None, None, "call", None, "other", None, None),
    ]
    got = {r["conv_id"]: r for r in chat_tools.format_chats(spark.createDataFrame(messages, schema), chat_tools.SCHEMAS).collect()}
    one = got[1]
    assert (one["n_calls"], one["n_linked"], one["n_valid"], one["n_loose"]) == (3, 1, 2, 2)
    assert one["chat"].index('"id":"a"') < one["chat"].index('"id":"b"') < one["chat"].index('"id":"c"')
    assert '"arguments":{"limit":3,"query":"y"},"id":"a","name":"search","result":"ra"' in one["chat"]
    assert got[None]["n_valid"] == 0
    assert chat_tools.format_chats(spark.createDataFrame([], schema), {}).collect() == []
    assert chat_tools.topological(["a", "b", "c"], [["b"], ["a"], []]) == [2, 0, 1]


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy this now and save a lot of money</div>
    <article><h1>Head &amp; line</h1><p>First  paragraph<br>goes <b>on</b>.</p><p>Two.</p><div class="comments"><p>Nice article indeed, thanks.</p></div></article>
    <script>var a="<p>no</p>";</script><footer>&copy; all</footer></body></html>"""
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "<p>unended <b"), (4, "v", "<article><p>caf&eacute;</article>")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(table).collect())
    want = "Head & line\nFirst paragraph goes on.\nTwo."
    assert got[0] == (1, want, len(want)) and got[1] == (2, "", 0) and got[2][0] == got[3][0] == 3 and got[4] == (4, "café", 4)


def test_main_text_of_pages(spark):
    tree = html_extract.train()
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert html_extract.main_text(r["html"], tree) == "\n".join(b for b in blocks if b)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    pieces = packing.pack_documents(docs, path, keep_ids=True).collect()
    held, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        part = own[p["start"] : p["start"] + p["length"]]
        assert part == p["ids"] and p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        held[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, own in ids.items():
        at = 0
        for s, n in sorted(held[i]):
            assert s == at
            at += n
        assert at == len(own)
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(empty, path).collect() == []


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 500, 900)
    sums = np.bincount(packing.differencing(sizes, 100), sizes, 100)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 60
    assert np.bincount(packing.pack_sizes(sizes), sizes).max() <= 2048


def brute_repeats(rows):
    texts = sorted((i, (t or "").encode()) for i, t, *_ in rows)
    first = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = bytes(gone).count(b"\0\1") + (gone[:1] == b"\1")
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    return out


def test_repeats(spark, docs, rows, empty, monkeypatch):
    for size in (10**7, 9_000):
        monkeypatch.setattr(rlbwt_dedup, "CHUNK_BYTES", size)
        monkeypatch.setattr(rlbwt_dedup, "BUCKET_BYTES", size)
        got = {r[0]: tuple(r)[1:] for r in rlbwt_dedup.digest(rlbwt_dedup.mark_repeats(docs)).collect()}
        assert got == brute_repeats(rows)
    assert rlbwt_dedup.mark_repeats(empty).collect() == []
    rnd = random.Random(2)
    odd = [(i, "".join(rnd.choice(["ab", "a", "é" * 9, "a" * 70, "xyz" * 25]) for _ in range(rnd.randrange(30)))) for i in range(60)]
    got = {r[0]: tuple(r)[1:] for r in rlbwt_dedup.digest(rlbwt_dedup.mark_repeats(spark.createDataFrame(odd, "doc_id long, text string"))).collect()}
    assert got == brute_repeats(odd)


def test_hashes_of_a_slice_are_made_once():
    """Anchors and passages share one run of sums, and passages that differ in their last byte alone are told apart."""
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog; " * 9 + bytes(range(32, 127)) * 3, np.uint8)
    offsets = np.array([0, 200, len(data)])
    sums = rlbwt_dedup.power_sums(data)
    at, h = rlbwt_dedup.anchors(data, offsets)
    assert len(at) and all((x == y).all() for x, y in zip((at, h), rlbwt_dedup.anchors(data, offsets, sums), strict=True))
    assert all((x == y).all() for x, y in zip(rlbwt_dedup.passages(data, offsets, at), rlbwt_dedup.passages(data, offsets, at, sums), strict=True))
    base = bytes(range(40, 119))
    texts = [base + b"a", base + b"b", base + b"c", base[:55], b"x" + base]
    want = [{i for i in range(len(t) - 49) if any(t[i : i + 50] in u for u in texts[:k])} for k, t in enumerate(texts)]
    assert [{i for i in range(31) if int(m) >> i & 1} for m in rlbwt_dedup.repeated_windows(texts, np.arange(5))] == want


def test_repeated_windows_by_index():
    rnd = random.Random(4)
    texts = list({bytes(rnd.choice(b"ab") for _ in range(3)) * 27 + bytes([rnd.choice(b"abc")]) for _ in range(40)})
    texts = [t[:80] for t in texts]
    masks = rlbwt_dedup.repeated_windows(texts, np.arange(len(texts)))
    for i, t in enumerate(texts):
        want = sum(1 << s for s in range(len(t) - 49) if any(t[s : s + 50] in u for u in texts[:i]))
        assert int(masks[i]) == want


def test_without_repeats(spark):
    cut = rlbwt_dedup.without_repeats(spark.createDataFrame([(1, "éab", [(1, 3)]), (2, None or "", [])], "doc_id long, text string, spans array<struct<start:long,end:long>>"))
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "b", 2: ""}


def test_token_counts(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(3)
    bits = ["a", "Be", "s", " ", "  ", "\n", "\t", "'", "'s", "'re", "é", "12", "-", "...", "<|endoftext|>", "€", "日本", "😀", "\x1c", "\xa0", "İ", "ll", "'LL", "_", "é"]
    more = [(100 + k, "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))) for k in range(800)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(table, path).collect()}
    for i, t, *_ in [*rows, *more]:
        assert got[i] == (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)), t
    assert token_count.count_tokens(empty, path).collect() == []


def test_mix(docs, rows, empty):
    got = {r["doc_id"]: r for r in fair_mix.mix(docs).collect()}
    again = {r["doc_id"]: r["taken"] for r in fair_mix.mix(docs.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    sizes = {i: len(split(t)) for i, t, *_ in rows}
    source = {r[0]: r[3] for r in rows}
    totals = Counter()
    for i, n in sizes.items():
        assert got[i]["size"] == n and got[i]["taken"] in (0, n, 2 * n)
        totals[source[i]] += n
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, capped = 1.5 * sum(totals.values()), set()
    while True:
        level = left / sum(weight[s] for s in order if s not in capped)
        over = [s for s in order if s not in capped and weight[s] * level >= 2 * totals[s]]
        if not over:
            break
        capped |= set(over)
        left = 1.5 * sum(totals.values()) - 2 * sum(totals[s] for s in capped)
    for i, r in got.items():
        s = source[i]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(2 * totals[s] if s in capped else weight[s] * level)
    taken = sum(r["taken"] for r in got.values())
    assert 1.5 * sum(totals.values()) - max(sizes.values()) <= taken <= 1.5 * sum(totals.values())
    assert fair_mix.mix(empty).collect() == []


def test_mix_drops_late_copies_before_the_window(spark, monkeypatch):
    table = spark.createDataFrame([(i, "w " * (1 + i % 7), "aabc"[i % 4]) for i in range(900)], "doc_id long, text string, source string")
    kept = []
    monkeypatch.setattr(fair_mix, "stored", lambda df, f=fair_mix.stored: kept.append(f(df)) or kept[-1])
    total = sum(1 + i % 7 for i in range(900))
    assert 1.5 * total - 7 <= sum(r["taken"] for r in fair_mix.mix(table).collect()) <= 1.5 * total
    copies = next(df for df in kept if "slot" in df.columns)
    last = f"slot = {2 * fair_mix.RANGES}"
    assert copies.where(last).count() > 50
    left = fair_mix.reachable(copies, total)
    assert left.where(last).count() == 0 and left.agg(F.sum("size")).first()[0] >= 1.5 * total - 7


def test_fingerprints(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in merkle.compare_edited(docs).collect()}
    texts = sorted((i, t or "") for i, t, *_ in rows)
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (t == edited)
        assert 0 <= got[i]["near_next"] <= 1
    prints = defaultdict(set)
    for i, t in texts:
        prints[t].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({p for s in prints.values() for p in s}) == len(prints)
    assert merkle.compare_edited(empty).collect() == []
    table = spark.createDataFrame([("one line.\nsecond one.\n\nthird.", "one line.\nsecond two.\n\nthird.")], "a string, b string")
    places = table.select(merkle.edits(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("e")).first()["e"]
    assert [tuple(p) for p in places] == [(0, 1)]


def test_nulls_and_repeated_rows(spark, docs):
    odd = docs.select("doc_id", "text", "lang", "source").limit(5)
    odd = odd.union(odd).union(spark.createDataFrame([(None, "some text of nobody", None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string"))
    n = odd.count()
    assert lang_id.identify(odd).count() == n
    assert jaccard_join.similar(odd).count() == n
    assert rlbwt_dedup.mark_repeats(odd).count() == n
    assert token_count.count_tokens(odd, tokenizer_path("byte_bpe_50k.json")).count() == n
    assert fair_mix.mix(odd).count() == n
    assert merkle.compare_edited(odd).count() == n
    assert packing.pack_documents(odd, tokenizer_path("word_bpe_49k.json")).count() >= n
    assert bm25_search.top_k(odd, odd).count() > 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing", "packing"]
    docs = table
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert out.columns == table.columns
            out.write.parquet(str(tmp_path / str(k)))
            before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
            ids = {r[0] for r in before.select("doc_id").distinct().collect()}
            assert {r[0] for r in docs.select("doc_id").distinct().collect()} <= ids
            if k == 2:
                assert docs.count() == before.count()
                rows = [(r["doc_id"], r["text"]) for r in before.collect()]
                want = {i: v[0] - v[1] for i, v in brute_repeats(rows).items()}
                assert {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()} == pytest.approx(want, abs=6)
    assert out.agg(F.sum("length")).first()[0] > 0
