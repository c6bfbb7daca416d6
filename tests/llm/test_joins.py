"""Hard negatives, kd-tree clustering and the Jaccard join against SQL and brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from jadwal.llm import hard_negatives, jaccard_join, kd_clustering, registry

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, cluster int, score string"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", ["op3_near_dedup", "op11_hard_negatives", "op12_clusters", "op13_jaccard_join"])
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def vectors(seed=5, n=260, dims=6):
    r = random.Random(seed)
    rows = [(i, [r.randint(-8, 8) / 4 for _ in range(dims)], r.randint(0, 3), 9, "clash") for i in range(n)]
    rows += [(i, rows[0][1], 1, 9, "clash") for i in range(n, n + 60)]  # ties: many equal vectors
    return rows


ODD = [(1000, None, 1, 0, ""), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 0, ""), (1002, [1.0, math.nan, 0.0, 0.0, 0.0, 0.0], 1, 0, ""), (1003, [math.inf] + [0.0] * 5, 1, 0, "")]


# --- hard negatives


def brute_negatives(rows, label, is_anchor, scale, k):
    kept = {i: (label(i, lab), [math.floor(scale * x) for x in v]) for i, v, lab in rows}
    out = []
    for a, (la, va) in kept.items():
        if not is_anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=False)), i, lab) for i, (lab, v) in kept.items() if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:k]:
            fit = sorted((t, i) for t, i, lab in scored if lab != la and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_hard_negatives(spark, small):
    rows = vectors()
    short = [(500, [1.0, 2.0], 1, 0, ""), (600, [], 2, 0, ""), (700, [1.0] * 6, None, 0, ""), (None, [1.0] * 6, 1, 0, "")]
    df = spark.createDataFrame(rows + rows[:40] + ODD + short, VECTORS).repartition(4)
    limits = {"pivots": 7, "group_anchors": 3, "chunk_rows": 40} if small else {}
    got = hard_negatives.hard_negatives(df, "vec_id", "embedding", F.col("label"), "vec_id % 20 = 0", scale=4, positives=3, negatives=3, **limits)
    want = brute_negatives([r[:3] for r in rows + short[:2]], lambda i, lab: lab, lambda i: i % 20 == 0, 4, 3)
    assert sorted(map(tuple, got.collect())) == want and want


def test_hard_negatives_skip_far_cells(spark):
    """Rows of far cells are not sent to groups that they cannot serve, and nothing is lost."""
    r = np.random.default_rng(3)
    rows = [(c * 100 + i, [float(x) for x in 40.0 * np.eye(8)[c] + r.normal(0, 0.05, 8)], i % 3, 0, "") for c in range(8) for i in range(60)]
    cells = hard_negatives.labelled_cells(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("label"), 16)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("label"), "vec_id % 20 = 0", scale=16, positives=3, negatives=3, pivots=40, group_anchors=2)
    assert sorted(map(tuple, got.collect())) == brute_negatives([x[:3] for x in rows], lambda i, lab: lab, lambda i: i % 20 == 0, 16, 3)
    assert cells.count() == len(rows)
    by = hard_negatives.Pivots([x["cells"] for x in cells.orderBy(F.xxhash64("vec_id")).limit(40).collect()], 8, max(sum(y * y for y in x["cells"]) for x in cells.collect()))
    q, x = np.array([next(v for i, v, *_ in rows if i == 0)]) * 16 // 1, np.array([v for _, v, *_ in rows]) * 16 // 1
    pivot, away = by.placed(x)
    bound = (q @ by.at.T)[0][pivot] + np.sqrt((q * q).sum()) * away
    assert (bound + 1 >= (q @ x.T)[0]).all()  # a bound
    assert (bound < 0.8 * np.sort((q @ x.T)[0])[-20]).mean() > 0.5  # that leaves out most rows of other cells


def test_hard_negatives_of_little(spark):
    op = lambda rows: hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", F.col("label"), "vec_id % 2 = 0").collect()
    assert op([]) == op(ODD) == op([(2, [1.0], 1, 0, "")]) == op([(2, [1.0], 1, 0, ""), (3, [1.0], 1, 0, "")]) == []
    assert len(op([(2, [1.0], 1, 0, ""), (3, [1.0], 1, 0, ""), (5, [0.9], 0, 0, "")])) == 1


def test_products_are_exact():
    big = np.array([[1 << 30, 1], [3, -5]], "i8")
    assert hard_negatives.products(big, big).tolist() == [[(1 << 60) + 1, (3 << 30) - 5], [(3 << 30) - 5, 34]]


# --- clustering


def brute_clusters(rows, scale, k, rounds):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    means = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(means)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                means[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [(i, *reversed(nearest(v))) for i, v in kept]
    name = lambda c: hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()
    return sorted(((i, c, d, sum(x[2] for x in last if x[1] == c), sum(x[2] for x in last), name(c)) for i, c, d in last), key=str)


@pytest.mark.parametrize("trees", [(2048, 32), (50, 4)])
def test_clusters(spark, monkeypatch, trees):
    monkeypatch.setattr(kd_clustering, "TREE_ROWS", trees[0])
    monkeypatch.setattr(kd_clustering, "LEAF_ROWS", trees[1])
    rows = vectors(8) + vectors(8)[:30] + [(None, [1.0] * 6, 1, 0, "")]
    df = spark.createDataFrame(rows + ODD + [(1004, [1.0], 1, 0, ""), (1005, [], 1, 0, "")], VECTORS).repartition(3)
    got = kd_clustering.kd_clusters(df, "vec_id", "embedding", dims=6, scale=4, k=7, rounds=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters([r[:2] for r in rows], 4, 7, 3)


def test_clusters_of_little(spark):
    op = lambda rows: kd_clustering.kd_clusters(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", dims=2)
    assert op([]).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and op([]).count() == 0
    assert [r["distance"] for r in op([(1, [0.5, 1.0], 1, 0, ""), (2, [0.5, 1.0], 1, 0, "")]).collect()] == [0, 0]
    with pytest.raises(Exception, match="64 bits"):
        op([(1, [1e9, 1.0], 1, 0, "")]).count()


def test_kd_tree_prunes():
    """Most nodes of clustered points are given away whole, and every point gets its nearest centroid."""
    r = np.random.default_rng(2)
    points = (r.integers(0, 6, (900, 1)) * 100 + r.integers(0, 9, (900, 4))).astype("i8")
    centroids = np.repeat(np.arange(6)[:, None] * 100 + 4, 4, 1).astype("i8")
    tree = kd_clustering.KdTree.grown(list(range(900)), points)
    found, whole = np.empty(900, "i8"), 0
    for _, first, last, who in tree.assigned(centroids):
        found[first:last] = who
        whole += (last - first) * isinstance(who, int)
    assert (found == ((tree.points[:, None] - centroids) ** 2).sum(2).argmin(1)).all() and whole > 700
    assert (tree.points == points[tree.ids]).all() and (tree.sums[0] == points.sum(0)).all()


# --- Jaccard join


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randint(0, 400)}" for _ in range(n)]


def corpus():
    r, base, common, rows = random.Random(6), words(1, 160), words(2, 45), []
    for i in range(60):  # near copies at many distances
        w = list(base)
        for _ in range(i // 6):
            w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 120):  # a passage that many documents share
        w = words(i, r.randint(4, 60))
        rows.append((i, " ".join(w[: len(w) // 2] + common + w[len(w) // 2 :])))
    rows += [(i, " ".join(words(i % 3, 9))) for i in range(120, 140)]  # exact copies
    rows += [(140, None), (141, ""), (142, " \t\n"), (143, "one two"), (144, "ONE  two"), (145, "one two three four five"), (146, " ".join(words(9, 9000))), (None, "one two"), (60, rows[61][1])]
    return rows + [(147, " ".join(words(9, 9000)[:8800])), (0, rows[0][1])]


def brute_links(rows, width, percent):
    def grams(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = [(i, grams(t)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    links = [(i, j) for i, x in sets for j, y in sets if None not in (i, j) and i < j and x and y and 100 * len(x & y) >= percent * len(x | y)]
    while True:
        new = dict(label)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return sorted(((i, len(s), label.get(i)) for i, s in sets), key=str)
        label = new


@pytest.mark.parametrize("limits", [{}, {"leaf": 4, "block": 8}])
def test_jaccard_join(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(jaccard_join, "LEAD", 1)
        monkeypatch.setattr(jaccard_join, "SAMPLE_COUNT", 2)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n long, label string").repartition(3)
    got = jaccard_join.jaccard_components(df, **limits)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows, 5, 80)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard_join.jaccard_components(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0][1:] == (0, 1)


def test_jaccard_join_broadcasts_little(spark, monkeypatch):
    """No table that grows with the documents is broadcast when it is large, and every link is found."""
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df.count()), broadcast(df))[1])
    n = 17_000
    pair = lambda i: F.concat_ws(" ", *[F.concat(F.lit(x), (F.col("id") % n).cast("string")) for x in "abcdefghi"], i)
    df = spark.range(2 * n).select(F.col("id").alias("doc_id"), pair(F.when(F.col("id") < n, F.lit("one"))).alias("text"))
    got = jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id").toArrow().to_pydict()
    assert sent and max(sent) <= 1 << 15
    assert sorted(zip(*got.values(), strict=True)) == [(i, 6 if i < n else 5, i % n) for i in range(2 * n)]


def test_count_tree():
    """The tree admits all pairs that can be linked, and few others."""
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(-(1 << 62), 1 << 62, 60)) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[: 60 - i % 12], r.integers(-(1 << 62), 1 << 62, i % 12)])) for i, s in enumerate(sets[:100])]
    points, sizes = np.stack([jaccard_join.folded(jaccard_join.counts(s)[None], 32)[0] for s in sets]), np.array([len(s) for s in sets])
    found = {(int(a), int(b)) for q, p, _ in jaccard_join.CountTree(points, sizes).search(points, sizes, 80) for a, b in zip(q, p, strict=True)}
    linked = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if 100 * (n := len(np.intersect1d(x, y))) >= 80 * (len(x) + len(y) - n)}
    assert linked <= found and len(found) < 3 * len(linked)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_prefixes_meet(percent):
    """Linked sets share a shingle within their prefixes, for any common order."""
    r = random.Random(percent)
    for _ in range(300):
        n = r.randint(1, 40)
        x, y = set(range(n)), set(range(r.randint(0, n // 4), n + r.randint(0, 4)))
        if not y or 100 * len(x & y) < percent * len(x | y):
            continue
        order = {v: r.random() for v in x | y}
        head = lambda s: set(sorted(s, key=order.get)[: jaccard_join.prefix_length(len(s), percent)])
        assert head(x) & head(y)
