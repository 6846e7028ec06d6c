"""Hard negatives, centroid clustering and the signature join against brute force, and their edges."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusmem.llm import centroids, hard_negatives, minhash_join
from corpusmem.llm.components import components
from corpusmem.llm.util import Work
from pyspark.sql import functions as F

VECTORS = "vec_id long, label int, embedding array<float>, q string, score double, block int"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 7) for r in rows], VECTORS)  # further columns clash with names used inside


def _clumps(n, dims, labels, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.2, (labels, dims))
    return [(i, i % labels, [float(np.float32(x)) for x in middles[i % labels] + rng.normal(0, 0.02 + 0.1 * (i % 3), dims)]) for i in range(n)]


def _mined(rows, is_anchor, n_positives=5, n_negatives=10, window=(30, 90, 100)):
    """All pairs in plain Python integers."""
    q = {i: [math.floor(256 * x) for x in v] for i, _, v in rows}
    label = {i: y for i, y, _ in rows}
    score = lambda a, b: sum(x * y for x, y in zip(q[a], q[b], strict=False))
    out = []
    for a in sorted(filter(is_anchor, q)):
        order = sorted((-score(a, b), b) for b in q if b != a)
        own = [(-s, b) for s, b in order if label[b] == label[a]][:n_positives]
        for ps, p in own:
            inside = [(-s, b) for s, b in order if label[b] != label[a] and window[0] * ps <= window[2] * -s <= window[1] * ps][:n_negatives]
            out += [(a, p, r, b, ps, s) for r, (s, b) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,slice_", [(512, 8192), (4, 37)])
def test_mined_negatives_equal_brute_force(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SLICE", slice_)
    rows = _clumps(240, 12, 5) + [(1000 + k, k % 5, [0.25] * 12) for k in range(30)]  # thirty equal vectors: ties by id
    got = hard_negatives.mine(_vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == _mined(rows, lambda i: i % 10 == 0)


def test_mining_edges(spark):
    good = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 2, [0.25, 0.25]), (3, 2, [0.2]), (4, 2, [])]
    odd = [(5, None, [0.5, 0.5]), (6, 1, None), (7, 2, [0.5, None]), (8, 2, [float("nan"), 0.1]), (9, 2, [float("inf"), 0.1]), (None, 2, [0.3, 0.3])]
    got = hard_negatives.mine(_vectors(spark, good + odd + good[:3]), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == _mined(good, lambda i: i == 0)
    big = [(0, 1, [3e38, 3e38]), (1, 1, [3e38, 1.0]), (2, 2, [65535.0, 1.0]), (3, 2, [1.0, 2.0])]
    held = [(i, y, [min(v, 65536.0) for v in x]) for i, y, x in big]
    assert sorted(map(tuple, hard_negatives.mine(_vectors(spark, big), F.col("vec_id") == 0).collect())) == _mined(held, lambda i: i == 0)
    twice = [(0, 1, [0.5]), (0, 0, [0.75]), (1, 0, [0.5]), (2, 3, [0.4])]  # of two rows with one id, the least by label counts
    assert sorted(map(tuple, hard_negatives.mine(_vectors(spark, twice), F.col("vec_id") == 0).collect())) == _mined(twice[1:], lambda i: i == 0)
    assert hard_negatives.mine(_vectors(spark, good).limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(_vectors(spark, good), F.lit(False)).count() == 0


def test_bounds_leave_rows_out():
    import pyarrow as pa

    rows = _clumps(400, 8, 4, seed=3)
    ints = [[math.floor(256 * x) for x in v] for _, _, v in rows]
    table = pa.table({"q": pa.array(ints, pa.list_(pa.int32()))})
    anchors = table.slice(0, 40)
    tile, scored, seen = hard_negatives.Tile(anchors, table), 0, []
    x = np.array(ints)

    def wanted(node, lo, hi):
        exact = x @ x[node]
        assert (lo <= exact).all() and (exact <= hi).all()
        return hi >= 12_000

    for node, some, scores in tile.walk(wanted):
        scored += len(some)
        assert scores.tolist() == (x[some] @ x[node]).tolist()
        missing = np.setdiff1d(np.flatnonzero(x @ x[node] >= 12_000), some)
        assert not len(missing)
        seen.append(node)
    assert sorted(seen) == list(range(40)) and scored < 40 * 400 * 0.8
    parents = {n: p for n, p, _ in tile.tree}
    assert sum(p < 0 for p in parents.values()) == 1


def _clustered(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept)
    middles = [v for _, v in start[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda v: min((apart(v, c), j) for j, c in enumerate(middles))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(place(v)[1], []).append(v)
        middles = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(middles)]
    found = [(i, *place(v)) for i, v in kept]
    total = {}
    for _, d, j in found:
        total[j] = total.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted((i, j, d, total[j], sum(total.values()), sha[j]) for i, d, j in found)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 64) + (i % 9) * 0.05]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # many equal vectors
    odd = [(2000, None), (2001, rows[0][1][:63]), (2002, [*rows[0][1], 0.0]), (2003, [None, *rows[0][1][1:]]), (2004, [float("nan"), *rows[0][1][1:]])]
    table = _vectors(spark, [(i, 0, v) for i, v in rows + odd]).withColumnRenamed("score", "distance")
    got = sorted(map(tuple, centroids.cluster(table).collect()))
    assert got == _clustered(rows)


def test_cluster_edges(spark):
    ten = [(i, [float(i), -0.001 * i]) for i in range(3)]
    table = lambda rows: _vectors(spark, [(i, 0, v) for i, v in rows])
    few = centroids.cluster(table(ten), dims=2).collect()
    assert sorted(map(tuple, few)) == _clustered(ten, dims=2) and len({r["cluster"] for r in few}) == 3
    assert centroids.cluster(table(ten), dims=3).count() == 0
    assert centroids.cluster(table(ten).limit(0), dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    repeated = centroids.cluster(table(ten + ten + [(None, [1.0, 1.0])]), dims=2).collect()
    assert len(repeated) == 7 and {r["cluster"] for r in repeated} == {0, 1, 2}
    assert centroids.cluster(table([(1, [3e38, -3e38]), (2, [0.0, 0.0])]), dims=2).count() == 2


def test_nearest_by_sorted_lists():
    rng = np.random.default_rng(2)
    for k, dims, span in ((1, 3, 9), (5, 1, 4), (8, 6, 3), (8, 64, 300), (13, 2, 50)):
        x, c = rng.integers(-span, span, (500, dims)), rng.integers(-span, span, (k, dims))
        number, apart = centroids.nearest(x, c)
        exact = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (number == exact.argmin(1)).all() and (apart == exact.min(1)).all()


def _components(rows, num=85, size=3):
    """Union of all pairs by full sets; (id, size, component)."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                top[max(root(x), root(y))] = min(root(x), root(y))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def _texts(seed=4):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 3000)}"
    shared = [word() for _ in range(60)]
    out = []
    for g in range(12):
        base = [word() for _ in range(int(rng.integers(4, 120)))] + shared[: int(rng.integers(0, 60))]
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = word()
            out.append(" ".join(w))
    crowd = [word() for _ in range(80)]
    for k in range(60):  # a large group of different near copies
        w = list(crowd)
        w[k % 80], w[(7 * k) % 80] = f"x{k}", f"y{k}"
        out.append(" ".join(w))
    out += ["Same Words here", "same words HERE", "one", "ONE", "one two", "", None, " \t\n", "same words here now"]
    return list(enumerate(out))


@pytest.mark.parametrize("slice_,shingles,short", [(1000, 750_000, 6), (7, 400, 2)])
def test_signature_join_equals_brute_force(spark, monkeypatch, slice_, shingles, short):
    for name, value in (("SLICE", slice_), ("SLICE_SHINGLES", shingles), ("SHORT", short)):
        monkeypatch.setattr(minhash_join, name, value)
    rows = _texts()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_join.near_duplicates(table).collect()}
    assert got == _components(rows)


def test_signature_join_edges(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (None, "a b c d"), (5, None), (None, None)]
    table = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(repr, map(tuple, minhash_join.near_duplicates(table).collect())))
    want = [(1, 59_998, 1, True), (2, 59_999, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (None, 2, None, True), (5, 0, 5, True), (None, 0, None, True)]
    assert got == sorted(map(repr, want))
    assert minhash_join.near_duplicates(table.limit(0)).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash_join.near_duplicates(table.where("doc_id is null")).count() == 2


def test_signatures_agree_as_sets_do():
    rng = np.random.default_rng(8)
    a = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    for share in (0.5, 0.85, 0.95):
        same = []
        for k in range(200):
            keep = rng.choice(a, round(len(a) * 2 * share / (1 + share)), replace=False)
            other = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, len(a) - len(keep)).astype(np.uint64)]))
            s = minhash_join.signatures([a, other])
            same.append((s[0] == s[1]).mean())
        assert abs(np.mean(same) - share) < 0.03


def test_chance_agreement_ties_no_documents(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "SHORT", 2)
    monkeypatch.setattr(minhash_join, "LIST", 9, raising=False)
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = []
    for _ in range(25):  # three near copies each; all share a third of their shingles, so they meet in coordinates
        own = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        sets += [np.unique(np.concatenate([common, own, rng.integers(0, 1 << 63, 4).astype(np.uint64)])) for _ in range(3)]
    sig = minhash_join.signatures(sets)
    classes = spark.createDataFrame([(i, len(s), x.tolist()) for i, (s, x) in enumerate(zip(sets, sig, strict=True))], "id long, n long, sig array<long>")
    work = Work(spark)
    found = {tuple(r) for r in minhash_join.candidates(classes, work, minhash_join.THRESHOLD).collect()}
    agree = {(i, j) for i in range(75) for j in range(i + 1, 75) if (sig[i] == sig[j]).sum() >= minhash_join.MATCHES}
    assert found <= agree
    reach = lambda pairs: {tuple(r) for r in components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert reach(found) == reach(agree)
    work.clear()


def test_components_read_edges_once(spark):
    def stars(batches):  # whichever documents span a group, other ones each time
        for batch in batches:
            for g in batch.column(0).to_pylist():
                middle = 10 * g + int(np.random.default_rng().integers(10))
                yield pa.RecordBatch.from_pydict({"a": [middle] * 9, "b": [i for i in range(10 * g, 10 * g + 10) if i != middle]})

    edges = spark.range(8).mapInArrow(stars, "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(i, i - i % 10) for i in range(80)]
