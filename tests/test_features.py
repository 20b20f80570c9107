import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import features as X, metrics as M, models as L, neighbours
from attesta.operators.neighbours import nearest_neighbours
from attesta.plans import modelling


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (None, -1, 0, 12, 13, 24, 72, 73)], "t int")
    edges = [0, 12, 24, 48, 72, float("inf")]
    assert [r[0] for r in df.select(X.bins(F.col("t"), edges, True, -1)).collect()] == [-1, -1, 0, 0, 1, 1, 3, 4]
    assert [r[0] for r in df.select(X.bins(F.col("t"), [0, 10, 30])).collect()] == [None, None, None, 1, 1, 1, None, None]


def test_risk_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.3, 0.31, 0.7, 1.0, None)], "p double")
    assert [r[0] for r in df.select(L.risk_level(F.col("p"))).collect()] == [None, "Low", "Medium", "Medium", "High", None]


def test_labels_follow_sorted_order_and_refuse_unseen(spark):
    train = spark.createDataFrame([(v,) for v in ("b", "a", "Z", "é", "b")], "c string")
    labels = X.label_table(train, "c")
    assert {r["value"]: r["index"] for r in labels.collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3}
    with pytest.raises(Exception, match="unseen value in c: q"):
        X.label_encode(spark.createDataFrame([("q",)], "c string"), "c", labels).collect()


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "x double, k int")
    assert [tuple(r) for r in X.standard_scale(df, ["x", "k"]).orderBy("x").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_split_sizes_are_exact_and_repeatable(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    first = X.split_stratified(df, "id", "y")
    sizes = {(r["y"], r["is_test"]): r["count"] for r in first.groupBy("y", "is_test").count().collect()}
    assert sizes == {(0, True): 180, (0, False): 722, (1, True): 20, (1, False): 81}
    again = X.split_stratified(df.repartition(5), "id", "y")
    assert first.filter("is_test").select("id").exceptAll(again.filter("is_test").select("id")).count() == 0
    assert 130 < X.split_random(df, "id").filter("is_test").count() < 270


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert {r["y"]: r["weight"] for r in X.balanced_weights(df, "y").collect()} == {1: 2.0, 0: pytest.approx(2 / 3)}
    assert X.scale_pos_weight(df, "y", focal=True).first()[0] == 6.0


def test_oversampling_reaches_the_ratio_inside_the_hull(spark):
    rows = [(i, float(i % 17), float(i % 5), int(i % 20 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = X.smote_oversample(df, "id", "y", ["a", "b"])
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts == {0: 380, 1: 190}
    made = out.filter("synthetic").agg(F.min("a"), F.max("a"), F.count("id")).first()
    assert made[0] >= 0 and made[1] <= 16 and made[2] == 0
    assert out.filter("NOT synthetic").count() == 400


@pytest.mark.parametrize("cell_points,most_cells", [(20, 4096), (7, 6), (5000, 1)])
def test_neighbours_against_all_pairs(spark, cell_points, most_cells):
    rng = random.Random(cell_points)
    rows = [(i, float(rng.randrange(12)), rng.gauss(0, 1), float(rng.randrange(2))) for i in range(250)]
    rows += [(1000 + i, 3.0, 0.25, 1.0) for i in range(150)]  # one point in a third of the rows
    rows += [(2000, -0.0, 0.0, 0.0), (2001, 0.0, -0.0, 0.0), (2002, 1e6, 1e6, 1e6)]
    odd = [(3000, None, 1.0, 1.0), (3001, float("nan"), 1.0, 1.0), (3002, float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "id long, a double, b double, c double").repartition(3)
    found = nearest_neighbours(df, "id", ["a", "b", "c"], 5, cell_points, most_cells)
    got = {r["_key"]: [(n["distance2"], n["key"]) for n in r["_near"]] for r in found.collect()}
    assert len(got) == len(rows)

    def sq(p, q):
        return (p - q) * (p - q)

    for i, *x in rows:
        assert got[i] == sorted((sq(x[0], y[0]) + sq(x[1], y[1]) + sq(x[2], y[2]), j) for j, *y in rows if j != i)[:5]


def test_points_are_compared_with_few_boxes():
    rng = np.random.default_rng(3)
    points = np.stack([rng.exponential(200, 40_000), rng.integers(0, 24, 40_000), rng.integers(0, 40, 40_000)], axis=1).astype(float)
    home = neighbours._cells(points, points[:640], 160)
    assert (home == neighbours._cells(points, points[:640][::-1], 160)).all()
    cells, counts = np.unique(home, return_counts=True)
    assert len(cells) == 160 and counts.max() < 2_000
    boxes = tuple(np.array([f(points[home == c], axis=0) for c in cells]) for f in (np.min, np.max))
    ids, visited = np.arange(len(points)), 0
    for c in cells[::20]:
        own = ids[home == c]
        row, place = neighbours._visits(points[own], own, boxes, counts, 5)
        visited += len(row) / len(own)
        for i in range(0, len(own), 97):  # no nearer point stands in a cell that is not visited
            apart = ((points - points[own[i]]) ** 2).sum(axis=1)
            nearest = np.lexsort((ids, apart))
            nearest = nearest[nearest != own[i]][:5]
            assert set(home[nearest]) <= set(cells[place[row == i]])
    assert visited / len(cells[::20]) < 12


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 1.0)], "id string, a double")
    got = {r["_key"]: [n["key"] for n in r["_near"]] for r in nearest_neighbours(df, "id", ["a"]).collect()}
    assert got == {"x": ["z", "y"], "y": ["x", "z"], "z": ["x", "y"]}
    assert nearest_neighbours(df.filter("id = 'x'"), "id", ["a"]).select("_near").collect()[0][0] == []
    assert nearest_neighbours(df.limit(0), "id", ["a"]).count() == 0


def test_oversampling_of_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, 1.0, 0), (3, 2.0, 0), (4, None, 1)], "id long, a double, y int")
    for rows in (df, df.filter("y = 0"), df.filter("y = 1"), df.limit(0)):
        assert X.smote_oversample(rows, "id", "y", ["a"], ratio=2.0).filter("NOT synthetic").count() == rows.count()


def test_rows_of_a_fit_are_held_by_several_tasks(spark, monkeypatch):
    df = spark.range(0, 3000, 1, 1).selectExpr("id", "cast(id % 2 AS double) AS a", "cast(id % 3 AS double) AS b", "cast(id % 2 AS int) AS y")
    assert L.dealt_for_fit(df, ["a", "b", "y"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(L, "NUMBERS_PER_TASK", 3000)
    dealt = L.dealt_for_fit(df, ["a", "b", "y"])
    assert dealt.columns == ["a", "b", "y"] and dealt.count() == 3000
    assert dealt.rdd.getNumPartitions() == 11 and max(dealt.rdd.glom().map(len).collect()) <= 300
    model = L.random_forest(df, ["a", "b"], "y", trees=3, depth=2)
    assert model.transform(df).filter("prediction <> y").count() == 0


def test_fit_transform_contract(spark, tmp_path):
    cols = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies", "partner", "dependents"]
    rows = [(i, 20.0 + i, 10.0 * i, ["a", "b"][i % 2], *[i % 2] * 8) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "tenure_months int, monthly_charges double, total_charges double, plan string, " + ", ".join(f"{c} int" for c in cols))
    engineer = L.FeatureEngineer(family="churn", version="v2", categorical=["plan"])
    model = engineer.fit(df)
    out = model.transform(df)
    assert out.columns == model.feature_names() and out.agg(F.avg("monthly_charges")).first()[0] == pytest.approx(0, abs=1e-9)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = L.FeatureEngineerModel.load(str(tmp_path / "m"))
    assert loaded.transform(df).exceptAll(out).count() == 0
    with pytest.raises(ValueError, match="fit before"):
        L.FeatureEngineerModel().transform(df)
    with pytest.raises(ValueError, match="fit before"):
        L.VotingRegressor().transform(df)


def test_missing_numbers_count_as_the_mean(spark):
    rows = [(float(i), float(2 * i), ["a", "b"][i % 2]) for i in range(1, 20)] + [(None, 3.0, "a")]
    df = spark.createDataFrame(rows, "square_feet double, lot_size double, hood string")
    model = L.FeatureEngineer(family="price", version="v1", categorical=["hood"]).fit(df)
    out = model.transform(df).filter("square_feet = 0").collect()
    assert len(out) == 2  # the row of the mean, 10, and the one without a number


def test_summary_reads_the_table_once(spark, tmp_path):
    rng = random.Random(4)
    columns = [f"c{i}" for i in range(6)]
    rows = [tuple(rng.choice([None, rng.gauss(0, 10 ** (i - 2)), float(rng.randrange(4))]) for i in range(5)) + (None,) for _ in range(400)]
    spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def scans(n):
        plan = L.dataset_summary(df, columns[:n])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("parquet")

    assert scans(2) == scans(6)
    got = {r["column"]: r for r in L.dataset_summary(df, columns).collect()}
    for i, c in enumerate(columns):
        values = np.array([r[i] for r in rows if r[i] is not None])
        assert got[c]["count"] == len(values)
        if len(values):
            want = [values.mean(), values.std(ddof=1), values.min(), *np.quantile(values, [0.25, 0.5, 0.75]), values.max()]
            assert [got[c][x] for x in ("mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(want)
        else:
            assert got[c]["mean"] is None and got[c]["max"] is None


def test_models_learn_a_clear_signal(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z")).withColumn(
        "y", (F.col("x") > 9).cast("int"))
    for fit in (lambda: L.logistic_regression(df, ["x", "z"], "y"), lambda: L.random_forest(df, ["x", "z"], "y", trees=3, depth=3),
                lambda: L.boosted_classifier(df, ["x", "z"], "y", rounds=3, depth=2)):
        model = fit()
        right = model.transform(df).filter("prediction = y").count()
        values = L.importances(model)
        assert right >= 390 and values[0] > values[1]


def test_price_grid_boosts_to_its_end(spark, monkeypatch):
    grids, stages = [], []

    def grid_only(df, key, target, family, experiments, categorical):
        grids.append(experiments)
        return spark.createDataFrame([("run-0", "a", "None", {"mae": 1.0})], "run_id string, name string, current_stage string, metrics map<string,double>")

    class Recorded:
        def __init__(self, features, stage):
            stages.append(stage)

        def fit(self, df):
            return df

    monkeypatch.setattr(L, "experiment_grid", grid_only)
    modelling.g29(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(L, "_pipeline", Recorded)
    boosted, = (e for e in grids[0] if e["name"] == "boosted")
    boosted["fit"](spark.createDataFrame([(1.0, 2.0)], "x double, y double"), ["x"], "y")
    stage, = stages
    assert (stage.getMaxIter(), stage.getMaxDepth(), stage.getStepSize(), stage.getMinInstancesPerNode()) == (150, 5, 0.1, 10)
    assert stage.getSubsamplingRate() == 1.0


def test_price_errors_only_with_an_actual(spark):
    df = spark.createDataFrame([(105.9, 100.0), (-3.7, 0.0)], "p double, price double")
    rows = L.price_errors(df, "p", "price").collect()
    assert (rows[0]["predicted_price"], rows[0]["price_difference"], rows[0]["percent_error"]) == (105, 5.0, 5.0)
    assert rows[1]["predicted_price"] == -3 and rows[1]["percent_error"] is None
    assert "percent_error" not in L.price_errors(df, "p").columns


def test_linear_curve_in_one_scan_equals_separate_fits(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), rng.gauss(3, 2), 0.0) for i in range(600)]
    rows = [(i, a, b, 5 + 2 * a - b + rng.gauss(0, 0.5)) for i, a, b, _ in rows] + [(9000, None, 1.0, 1.0), (9001, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")

    def r2(model, part):
        return M.regression_metrics(model.transform(part), [], "y", "prediction").first()["r2_score"]

    whole = L.learning_curve(df.dropna(), "id", ["a", "b"], "y", L.linear_regression, r2, shares=(0.3, 1.0)).collect()
    quick = L.linear_learning_curve(df, "id", ["a", "b"], "y", shares=(1.0, 0.3)).collect()
    for one, other in zip(whole, quick):
        assert (one["share"], one["train_size"]) == (other["share"], other["train_size"])
        assert [other["train_score"], other["validation_score"]] == pytest.approx([one["train_score"], one["validation_score"]], abs=1e-9)
    fitted = L.linear_regression(X.split_random(df.dropna(), "id").filter("NOT is_test"), ["a", "b"], "y").stages[-1]
    assert quick[1]["coefficients"] == pytest.approx(list(fitted.coefficients)) and quick[1]["intercept"] == pytest.approx(fitted.intercept)
    nothing = L.linear_learning_curve(df.limit(0), "id", ["a", "b"], "y", shares=(0.5,)).first()
    assert nothing["train_size"] == 0 and nothing["train_score"] is None
