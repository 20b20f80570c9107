import math
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import metrics as M
from attesta.operators.scans import exact_quantiles, ranked, running_totals


def pair_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def naive_pr_auc(rows):
    total, points, tp, fp = sum(y for y, _ in rows), [(0.0, 1.0)], 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        tp += sum(1 for y, t in rows if t == s and y)
        fp += sum(1 for y, t in rows if t == s and not y)
        points.append((tp / total, tp / (tp + fp)))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)  # one key holds most rows, scores tie a lot, one key has a single class
    rows = [("hot", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(900)]
    rows += [("cold", rng.randint(0, 1), float(rng.randint(0, 3))) for _ in range(40)] + [("one", 1, 0.5)] * 5 + [(None, 1, 0.2), (None, 0, 0.1)]
    return rows, spark.createDataFrame(rows, "k string, y int, s double").repartition(7)


def test_areas_match_pairwise_counting(scored):
    rows, df = scored
    auc = {r["k"]: r["roc_auc"] for r in M.roc_auc(df, ["k"], "y", "s").collect()}
    area = {r["k"]: r["pr_auc"] for r in M.pr_auc(df, ["k"], "y", "s").collect()}
    for key in ("hot", "cold", None):
        part = [(y, s) for k, y, s in rows if k == key]
        assert auc[key] == pytest.approx(pair_auc(part), abs=1e-12)
        assert area[key] == pytest.approx(naive_pr_auc(part), abs=1e-12)
    assert auc["one"] is None and area["one"] == pytest.approx(1.0)
    whole = [(y, s) for _, y, s in rows]
    assert M.roc_auc(df, [], "y", "s").first()[0] == pytest.approx(pair_auc(whole), abs=1e-12)


def test_no_positives(spark):
    df = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.6)], "y int, p int, s double")
    row = M.imbalanced_metrics(df, [], "y", "p", "s").first()
    assert (row["precision"], row["recall"], row["f1_score"], row["matthews_corrcoef"], row["specificity"]) == (0, 0, 0, 0, 0.5)
    assert row["roc_auc"] is None and row["pr_auc"] == 0.5
    assert M.log_loss(df, [], "y", "s").first()[0] is None


def test_hand_computed(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1), (0, 0, 0.2)], "y int, p int, s double")
    row = M.classification_metrics(df, [], "y", "p").first()
    assert row["accuracy"] == pytest.approx(0.6) and row["precision"] == 0.5 and row["recall"] == 0.5
    assert row["matthews_corrcoef"] == pytest.approx((1 * 2 - 1 * 1) / math.sqrt(2 * 2 * 3 * 3))
    want = -sum(math.log(v) for v in (0.9, 0.4, 0.4, 0.9, 0.8)) / 5
    assert M.log_loss(df, [], "y", "s").first()[0] == pytest.approx(want)
    points = {(r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_points(df, [], "y", "s").collect()}
    assert (math.inf, 0.0, 0.0) in points and (0.1, 1.0, 1.0) in points and len(points) == 6
    ends = [tuple(r) for r in M.pr_points(df, [], "y", "s").filter("threshold IS NULL").collect()]
    assert ends == [(None, 1.0, 0.0)]


def test_regression_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "t double, p double")
    row = M.regression_metrics(df, [], "t", "p").first()
    assert row["mape"] == math.inf and row["max_error"] == 1.0 and row["r2_score"] == pytest.approx(0.5)
    flat = spark.createDataFrame([(3.0, 3.0), (3.0, 4.0)], "t double, p double")
    assert M.regression_metrics(flat, [], "t", "p").first()["r2_score"] == 0.0
    bins = M.residual_histogram(spark.createDataFrame([(0.0,), (49.9,), (50.0,)], "residual double")).collect()
    assert len(bins) == 50 and sum(r["n"] for r in bins) == 3 and [r["n"] for r in bins if r["bin"] == 49] == [2]


def test_matrix_and_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df, "t", "p", ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells["a", "b"] == 1 and cells["c", "c"] == 0
    report = {r["label"]: r for r in M.classification_report(df, "t", "p").collect()}
    assert report["a"]["precision"] == 0.5 and report["c"]["recall"] == 0.0 and report["accuracy"]["f1_score"] == 0.5
    assert report["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 0) / 3) and report["weighted avg"]["recall"] == pytest.approx(0.5)


def test_running_totals_and_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([0, 1, 2, rng.random() * 1000]) for _ in range(500)]
    df = spark.createDataFrame([(float(v), 1, i) for i, v in enumerate(values)], "v double, one int, i int")
    got = {r["i"]: r["upto"] for r in running_totals(df, [], ["v", "i"], {"upto": "one"}).collect()}
    place = {i: n + 1 for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert got == place
    many = running_totals(df, [], ["v", "i"], {"upto": "one"}, ranges=256)
    assert {r["i"]: r["upto"] for r in many.collect()} == place
    few = running_totals(df, [], ["v", "i"], {"upto": "one"}, ranges=2)
    assert {r["i"]: r["upto"] for r in few.collect()} == place
    assert {r["i"]: r["rank"] for r in ranked(df, [], ["v", "i"]).collect()} == place
    ordered = sorted(values)

    def quantile(q):
        at = (len(ordered) - 1) * q
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    assert exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()["q"] == pytest.approx([quantile(q) for q in (0, 0.25, 0.5, 0.9, 1)])
    empty = df.filter("v < -1")
    assert exact_quantiles(empty, "v", [0.5]).first()["q"] == [None]
    assert running_totals(empty, [], ["v"], {"upto": "one"}).count() == 0
    assert running_totals(df, [], ["v", "i"], {"upto": "one"}).agg(F.max("upto")).first()[0] == 500
