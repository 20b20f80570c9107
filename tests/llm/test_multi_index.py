"""Hard negatives by an inverted multi-index against brute force."""

import math
import random
import re

import numpy as np
import pytest

from attesta.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score long"


def brute(rows, every, positives, negatives, scale):
    sound = [(k, [math.floor(scale * float(np.float32(x))) for x in v], y) for k, v, y, *_ in rows
             if k is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, v, y in sound:
        if k % every:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), m, z) for m, w, z in sound if m != k]
        for ps, pid, _ in sorted(s for s in scores if s[2] == y)[:positives]:
            inside = sorted(s for s in scores if s[2] != y and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:negatives]
            out += [(k, pid, n, m, -ps, -s) for n, (s, m, _) in enumerate(inside, 1)]
    return sorted(out)


def vectors(seed, n, dim, clusters, labels):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = rng.randrange(clusters)
        v = [x + rng.gauss(0, 0.4) for x in centres[c]]
        rows.append((i, v, c % labels if rng.random() < 0.7 else rng.randrange(labels), "r", 1))
    return rows


@pytest.mark.parametrize("clusters,labels,dim", [(12, 4, 8), (1, 2, 7), (40, 40, 6)])
def test_hard_negatives(spark, monkeypatch, clusters, labels, dim):
    monkeypatch.setattr(multi_index, "SEED_ROWS", 40)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 10)
    monkeypatch.setattr(multi_index, "PIECE_ROWS", 16)
    rows = vectors(clusters, 700, dim, clusters, labels)
    same = rows[20][1]
    rows += [(1000 + i, same, i % 3, "", 0) for i in range(120)]  # a hot cell, ties
    rows += [(2000, None, 1, "", 0), (2010, same[:2] + [None], 1, "", 0), (2020, [float("nan")] * dim, 1, "", 0), (2030, same, None, "", 0),
             (None, same, 1, "", 0), (2040, [float("inf")] * dim, 1, "", 0), (2050, [0.0] * dim, 1, "", 0), rows[3], rows[40]]
    got = multi_index.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every=20, scale=16)
    assert got.columns == [f.split()[0] for f in multi_index.RESULT.split(", ")]
    want = brute(rows, 20, 5, 5, 16)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300


def test_few_rows_and_other_label_types(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.1], "x"), (2, [0.9, 0.0], "y"), (3, [0.95, 0.0], "z"), (4, [-1.0, 0.0], "y")]
    got = multi_index.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), scale=100)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 3, 10000, 9500), (0, 1, 2, 2, 10000, 9000)]
    alone = spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>, label string")
    assert multi_index.hard_negatives(alone).collect() == []


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1, "", 0)], [(100, [], 1, "", 0), (200, [], 2, "", 0)]):
        assert multi_index.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_visits_are_not_broadcast(spark, monkeypatch):
    """They grow with queries times cells, of which Spark's estimate knows nothing."""
    plans, write = {}, multi_index.materialise
    monkeypatch.setattr(multi_index, "materialise", lambda df, purpose: (
        plans.update({purpose: df._jdf.queryExecution().sparkPlan().toString()}), write(df, purpose))[1])
    got = multi_index.hard_negatives(spark.createDataFrame(vectors(5, 300, 8, 6, 3), SCHEMA), every=20, scale=16)
    plans["result"] = got._jdf.queryExecution().sparkPlan().toString()
    assert [len(re.findall(r"SortMergeJoin \[cell#\d+L?, salt#", plans[x])) for x in ("found", "result")] == [2, 1]
    assert not re.search(r"BroadcastHashJoin \[cell#\d+L?, salt#", plans["found"] + plans["result"])


def test_walk_goes_down_and_its_bounds_hold():
    rng = np.random.default_rng(4)
    rows = np.round(rng.normal(size=(500, 10)) * 50)
    books = multi_index.Codebooks(rows[:100], 6)
    cell, near, far = books.codes(rows)
    for half, code, apart in ((0, cell // 6, near), (1, cell % 6, far)):
        for c in range(6):
            books.radius[half][c] = apart[code == c].max(initial=0)
    for query in np.round(rng.normal(size=(20, 10)) * 50):
        walk = list(books.walk(query))
        assert len({c for _, _, c in walk}) == 36 and all(a[0] >= b[0] for a, b in zip(walk, walk[1:]))
        scores = rows @ query
        for bound, least, c in walk:
            assert np.all(scores[cell == c] <= bound) and np.all(scores[cell == c] >= least)
