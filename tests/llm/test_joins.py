"""Near-dedup, exact search, mixing and components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import graph, kd_search, mixing, near_dedup

SCHEMA = "doc_id long, text string, source string, row_id string, class string"


def shingles(text, size):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute_components(rows, size, pct):
    sets = [shingles(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [(r[0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def near_corpus(seed, n=160, dense=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(150)]
    for i in range(n):
        if i < dense:  # one dense group, with a chain away from it
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif i % 4 == 0 and rows:
            words = (rng.choice(rows)[1] or "x").lower().split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))]
        text = " ".join(words)
        rows.append((1000 - i, text.upper() if i % 5 == 0 else text, "s", "r", "c"))
    rows += [(2000, None, "", "", ""), (2001, "", "", "", ""), (2002, "one two", "", "", ""), (2003, "ONE\ttwo", None, None, None),
             (2004, "É x", "", "", ""), (2005, "é x", "", "", ""), (None, "one two", "", "", ""), (None, None, "", "", ""), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("leaf,depth", [(256, 6), (6, 2), (12, 6)])
def test_components(spark, leaf, depth):
    rows = near_corpus(leaf)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4, leaf=leaf, depth=depth).collect()
    want = brute_components(rows, 4, 80)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_dense_group_does_not_multiply(spark, monkeypatch):
    """A group of near copies, many below the threshold: its rows stay few on every level, and no link is lost."""
    rng = random.Random(11)
    vocabulary, rows = [f"w{i}" for i in range(500)], []
    base = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 25)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words), "s", "r", "c"))
    written, before = [], near_dedup.materialise

    def counted(df, purpose):
        table = before(df, purpose)
        if purpose == "rows":
            written.append(table.count())
        return table
    monkeypatch.setattr(near_dedup, "materialise", counted)
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    monkeypatch.setattr(near_dedup, "SHINGLES", 2_000, raising=False)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4, leaf=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 4, 80))
    assert len(written) > 1 and max(written) <= 4 * written[0]


def test_every_tree_has_a_root_choice():
    for threshold, trees in ((0.8, near_dedup.TREES), (0.95, 40)):
        assert {tree for tree, _ in near_dedup._root_choices(threshold, trees)} == set(range(trees))


def test_pairs_stay_together_down_to_the_depth(spark):
    """Signatures of pairs at 0.8 share a node of every level, though none is ever compared."""
    rng = np.random.default_rng(5)
    n = 2000
    first = rng.integers(0, 1 << 30, (n, near_dedup.COORDINATES))
    second = np.where(rng.random(first.shape) < 0.8, first, first + 1)
    pairs = spark.createDataFrame([(i, [int(x) for x in a], [int(x) for x in b]) for i, (a, b) in enumerate(zip(first, second))], "id long, a array<int>, b array<int>")
    roots = near_dedup._roots(0.8, near_dedup.TREES)
    rows = pairs.select("id", F.col("a").alias("tokens"), F.lit("a").alias("side")).unionByName(pairs.select("id", F.col("b").alias("tokens"), F.lit("b").alias("side")))
    rows = rows.select("id", "side", "tokens", F.explode(roots).alias("node")).localCheckpoint()
    for level in range(2, near_dedup.DEPTH + 1):
        met = rows.groupBy("id", "node").agg(F.countDistinct("side").alias("sides")).filter("sides = 2").select("id", "node")
        rows = rows.join(met, ["id", "node"]).select(
            "id", "side", "tokens", F.explode(near_dedup._branch(F.col("node"), F.lit(level), F.lit(1))).alias("node")).distinct().localCheckpoint()
    met = rows.groupBy("id", "node").agg(F.countDistinct("side").alias("sides")).filter("sides = 2").select("id").distinct()
    assert met.count() >= n * 0.999


def test_one_of_each_group_stays(spark):
    rows = near_corpus(5, n=60)
    kept = near_dedup.without_near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4)
    assert kept.columns == ["doc_id", "text", "source", "row_id", "class"]
    want = {c for i, _, c in brute_components(rows, 4, 80) if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert got == want


@pytest.mark.parametrize("k,every", [(5, 7), (400, 50)])
def test_exact_search(spark, k, every):
    rng = np.random.default_rng(k)
    vectors = [(i, [float(x) for x in np.round(rng.normal(0, 1, 6), 2)], 0, "s") for i in range(300)]
    vectors += [(500 + i, vectors[3][1], 0, "s") for i in range(30)]  # ties
    vectors += [(700, None, 0, ""), (701, [1.0, None], 0, ""), (702, [float("nan")] * 6, 0, ""), (703, [float("inf")] * 6, 0, ""),
                (None, vectors[0][1], 0, ""), (14, vectors[5][1], 0, ""), (707, [1.0, 2.0], 0, ""), (708, [1e9] * 6, 0, "")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    got = kd_search.exact_top_k(df, every=every, k=k).collect()
    sound = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _, _ in vectors
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in sound:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in sound if j != i and len(w) == len(v))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    assert Counter((r.query_id, r["rank"], r.vec_id, r["score"]) for r in got) == Counter(want)


def test_search_in_small_shards(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 4), ("SHARD_ROWS", 40), ("SAMPLE_ROWS", 100), ("BOXES_PER_PACK", 3), ("BLOCKS_PER_SALT", 2)):
        monkeypatch.setattr(kd_search, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)], 0, "") for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string").repartition(5)
    got = {(r.query_id, r["rank"]): r.vec_id for r in kd_search.exact_top_k(df, every=10, k=3).collect()}
    whole = np.floor(64 * np.array([r[1] for r in rows]))
    for q in range(0, 400, 10):
        score = whole @ whole[q]
        order = [j for j in np.lexsort((np.arange(400), -score)) if j != q][:3]
        assert [got[q, r] for r in (1, 2, 3)] == order
    assert kd_search.exact_top_k(df.limit(0)).count() == 0


def test_tree_boxes_hold_their_rows():
    matrix = np.random.default_rng(0).integers(-9, 9, (500, 4))
    matrix = matrix[kd_search.build_order(matrix, 16)]
    tree = kd_search.Tree(matrix, 16)
    for (lo, hi), low, high in zip(tree.range, tree.low, tree.high):
        assert (low == matrix[lo:hi].min(axis=0)).all() and (high == matrix[lo:hi].max(axis=0)).all()


def water_filling(sizes, weights, share, most):
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > most * sizes[s] + 1e-9}
        if not over:
            target.update({s: left * weights[s] / total for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def mix_rows(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "b", "B", "é", None, "big", "big", "big"])
        rows.append((i, "w " * int(rng.expovariate(1 / 40)), source, "r", "c"))
    return rows + [(5000, None, "a", "", ""), (5001, "", "empty", "", ""), (None, "x y", "b", "", ""), rows[4], rows[4], (6000, "w " * 3000, "a", "", "")]


def test_mix_reaches_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 7)
    rows = mix_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    want = water_filling(sizes, weights, 1.5, 2.0)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.text, r.copies) for r in again) == Counter((r.doc_id, r.text, r.copies) for r in out)


def test_rates_are_the_least_changed(spark):
    """The rates of a source are exp(tilt * size), capped: the tilt is one number."""
    out = mixing.copies(spark.createDataFrame(mix_rows(2), SCHEMA)).filter("size > 0 and rate < 2").withColumn("tilt", F.log("rate") / F.col("size"))
    for r in out.groupBy("source").agg(F.min("tilt").alias("x"), F.max("tilt").alias("y")).collect():
        assert r.x == pytest.approx(r.y, rel=1e-6, abs=1e-12)


def test_mix_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, "", "a", "", ""), (2, None, None, "", "")], SCHEMA)).collect()
    assert [(r.taken, r.target) for r in out] == [(0, 0.0)] * 2
    one = mixing.mix(spark.createDataFrame([(1, "a b c", "x", "", "")], SCHEMA)).first()
    assert one.target == 4.5 and one.taken in (3, 6)
