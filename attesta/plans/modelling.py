"""Family G, models: small fits over the feature views; banding, errors and summaries also as SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from attesta.operators import features as X, metrics as M, models as L
from attesta.plans.catalog import bind, plain, query
from attesta.plans.features import CHURN_SQL, PRICE_SQL, churn, fraud, price
from attesta.plans.metrics import nice

CHURN_CATEGORIES = ["internet_service", "contract_type", "payment_method"]
PRICE_NUMERIC = ["square_feet", "bedrooms", "bathrooms", "lot_size", "age", "quality", "condition", "distance_to_center"]
# As published for the price experiments; ten rows a leaf ask for the twenty rows a split, too.
PRICE_BOOSTING = {"rounds": 150, "depth": 5, "rate": 0.1, "min_leaf": 10}
FRAUD_NUMERIC = ["amount", "hour_of_day", "distance_from_home", "is_foreign", "card_age_days", "transactions_last_week"]


def scaled_price(spark, sf_dir):
    df = price(spark, sf_dir).select("property_id", "price", *PRICE_NUMERIC)
    return X.standard_scale(df, PRICE_NUMERIC)


def embedded(spark, sf_dir):
    """64 coordinates as columns; one of the ten labels against the rest."""
    df = bind(spark, sf_dir, "SELECT vec_id, embedding, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM {embeddings}")
    return df.select("vec_id", "y", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))


@query("g12_fit_transform_contract", f"""WITH c AS ({CHURN_SQL}), s AS (SELECT *, substr(md5(concat('42:', customer_id)), 1, 8)
    < '33333333' AS is_test FROM c),
  k AS (SELECT contract_type AS v, dense_rank() OVER (ORDER BY contract_type) - 1 AS i FROM (SELECT DISTINCT contract_type
    FROM s WHERE NOT is_test))
  SELECT customer_id, round((monthly_charges - (SELECT avg(monthly_charges) FROM s WHERE NOT is_test))
    / (SELECT stddev_pop(monthly_charges) FROM s WHERE NOT is_test), 6) AS monthly_charges, i AS contract_type
  FROM s JOIN k ON k.v = s.contract_type WHERE is_test""")
def g12(spark, sf_dir):
    split = X.split_random(churn(spark, sf_dir), "customer_id")
    drop = ["customer_id", "churned", "is_test"]
    engineer = L.FeatureEngineer(family="churn", version="v3", categorical=CHURN_CATEGORIES)
    model = engineer.fit(split.filter(~F.col("is_test")).drop(*drop))
    out = model.transform(split.filter(F.col("is_test")).withColumnRenamed("churned", "_y"))
    return out.select("customer_id", F.round("monthly_charges", 6).alias("monthly_charges"), "contract_type")


@query("g21_logistic_regression", None)
def g21(spark, sf_dir):
    df = X.standard_scale(fraud(spark, sf_dir).select("transaction_id", "is_fraud", *FRAUD_NUMERIC), FRAUD_NUMERIC)
    model = L.logistic_regression(df, FRAUD_NUMERIC, "is_fraud", max_iter=20)
    return L.importance_table(spark, FRAUD_NUMERIC, L.importances(model))


@query("g22_random_forest", None)
def g22(spark, sf_dir):
    df = fraud(spark, sf_dir).select("transaction_id", "is_fraud", *FRAUD_NUMERIC)
    model = L.random_forest(df, FRAUD_NUMERIC, "is_fraud", trees=5, depth=4)
    return L.importance_table(spark, FRAUD_NUMERIC, L.importances(model))


@query("g23_boosted_classifier", None)
def g23(spark, sf_dir):
    df = fraud(spark, sf_dir).select("transaction_id", "is_fraud", *FRAUD_NUMERIC)
    model = L.boosted_classifier(df, FRAUD_NUMERIC, "is_fraud", rounds=4, depth=3, focal=True)
    return model.transform(df).select("transaction_id", "is_fraud", "prediction", L.probability().alias("probability"))


@query("g24_linear_regression", f"""WITH p AS (SELECT p_partkey % 6 AS x, p_retailprice AS y FROM part)
  SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM p""")
def g24(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT cast(p_partkey % 6 AS double) AS x, p_retailprice AS y FROM {part}")
    fitted = L.linear_regression(df, ["x"], "y").stages[-1]
    return spark.createDataFrame([(round(float(fitted.coefficients[0]), 6), round(float(fitted.intercept), 4))],
                                 "slope double, intercept double")


@query("g24_ridge", """WITH p AS (SELECT p_size AS x, p_retailprice * p_size AS y FROM part)
  SELECT round(covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 10), 4) AS slope FROM p""")
def g24_ridge(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT cast(p_size AS double) AS x, p_retailprice * p_size AS y FROM {part}")
    fitted = L.linear_regression(df, ["x"], "y", alpha=10.0).stages[-1]
    return spark.createDataFrame([(round(float(fitted.coefficients[0]), 4),)], "slope double")


@query("g25_boosted_regressor", None)
def g25(spark, sf_dir):
    df = scaled_price(spark, sf_dir)
    model = L.boosted_regressor(df, PRICE_NUMERIC, "price", rounds=5, depth=3)
    return M.regression_metrics(model.transform(df), [], "price", "prediction")


@query("g26_voting_regressor", None)
def g26(spark, sf_dir):
    df = scaled_price(spark, sf_dir)
    model = L.VotingRegressor(rounds=(4, 4), depths=(3, 2)).fit(df, PRICE_NUMERIC, "price")
    return model.transform(df).select("property_id", "price", "prediction")


SCORES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 10 AS score FROM {lineitem}"""
BANDED_SQL = f"""SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction, CASE WHEN score > 0 AND score <= 0.3
  THEN 'Low' WHEN score > 0.3 AND score <= 0.7 THEN 'Medium' WHEN score > 0.7 AND score <= 1 THEN 'High' END AS risk_level
  FROM ({plain(SCORES)})"""


@query("g27_threshold_predict", f"SELECT l_orderkey, l_linenumber, l_partkey, (score >= 0.35)::INT AS prediction FROM ({plain(SCORES)})")
def g27(spark, sf_dir):
    return bind(spark, sf_dir, SCORES).select("l_orderkey", "l_linenumber", "l_partkey",
                                              L.threshold_predict(F.col("score"), 0.35).alias("prediction"))


@query("g28_importance_table", None)
def g28(spark, sf_dir):
    df = embedded(spark, sf_dir).withColumnRenamed("vector", "features")
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(labelCol="y", maxIter=10).fit(df)
    names = [f"d{i:02d}" for i in range(model.numFeatures)]
    return L.importance_table(spark, names, [abs(float(v)) for v in model.coefficients])


@query("g29_experiment_grid", None)
def g29(spark, sf_dir):
    df = price(spark, sf_dir).select(
        "property_id", "price", "neighborhood", *PRICE_NUMERIC, "has_garage", "has_pool", "has_fireplace", "has_basement",
        "is_renovated", "years_since_renovation", "school_rating")
    grid = [
        {"experiment": "linear", "name": "ols", "feature_version": "v1", "stage": "None", "kind": "regression",
         "fit": L.linear_regression},
        {"experiment": "linear", "name": "ridge", "feature_version": "v2", "stage": "Staging", "kind": "regression",
         "fit": lambda d, f, y: L.linear_regression(d, f, y, alpha=10.0)},
        {"experiment": "trees", "name": "boosted", "feature_version": "v3", "stage": "Production", "kind": "regression",
         "fit": lambda d, f, y: L.boosted_regressor(d, f, y, **PRICE_BOOSTING)},
    ]
    runs = L.experiment_grid(df, "property_id", "price", "price", grid, ["neighborhood"])
    return runs.select("run_id", "name", "current_stage", F.explode("metrics").alias("metric", "value"))


@query("g30_score_and_band", f"SELECT l_orderkey, l_linenumber, l_partkey, prediction, risk_level FROM ({BANDED_SQL})")
def g30(spark, sf_dir):
    out = L.score_and_band(bind(spark, sf_dir, SCORES), F.col("score"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "prediction", "risk_level")


ESTIMATES = "SELECT p_partkey, p_retailprice AS price, 850.7 + p_size * 3.3 AS estimate FROM {part}"
ERRORS_SQL = f"""SELECT *, predicted_price - price AS price_difference,
  round_even((predicted_price - price) / price * 100 * 100, 0) / 100 AS percent_error
  FROM (SELECT *, trunc(estimate)::BIGINT AS predicted_price FROM ({plain(ESTIMATES)}))"""


@query("g31_price_errors", f"""SELECT p_partkey, predicted_price, round(price_difference, 6) AS price_difference, percent_error
  FROM ({ERRORS_SQL})""")
def g31(spark, sf_dir):
    out = L.price_errors(bind(spark, sf_dir, ESTIMATES), "estimate", "price")
    return nice(out.select("p_partkey", "predicted_price", "price_difference", "percent_error"), 6)


@query("g32_prediction_summary", f"""SELECT count(*) AS total, sum(prediction)::BIGINT AS positives, round(avg(prediction), 9)
  AS share, round(avg(score), 9) AS mean_probability, count(*) FILTER (risk_level = 'Low') AS n_low,
  count(*) FILTER (risk_level = 'Medium') AS n_medium, count(*) FILTER (risk_level = 'High') AS n_high FROM ({BANDED_SQL})""")
def g32(spark, sf_dir):
    return nice(L.classification_summary(L.score_and_band(bind(spark, sf_dir, SCORES), F.col("score"))))


@query("g32_price_summary", f"""SELECT round(avg(predicted_price), 6) AS mean_price, min(predicted_price) AS min_price,
  max(predicted_price) AS max_price, round(avg(abs(price_difference)), 6) AS mean_abs_error,
  round(avg(abs(percent_error)), 6) AS mean_percent_error, median(predicted_price) AS median_price FROM ({ERRORS_SQL})""")
def g32_price(spark, sf_dir):
    return nice(L.price_summary(L.price_errors(bind(spark, sf_dir, ESTIMATES), "estimate", "price")), 6)


def _describe_sql(column, source):
    return (f"SELECT '{column}' AS column, count({column}) AS count, round(avg({column}), 6) AS mean, "
            f"round(stddev_samp({column}), 6) AS std, min({column})::DOUBLE AS min, "
            f"round(quantile_cont({column}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({column}::DOUBLE, 0.5), 6) AS p50, "
            f"round(quantile_cont({column}::DOUBLE, 0.75), 6) AS p75, max({column})::DOUBLE AS max FROM {source}")


@query("g33_dataset_summary", _describe_sql("l_quantity", "lineitem") + " UNION ALL "
       + _describe_sql("l_extendedprice", "lineitem"))
def g33(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT l_quantity, l_extendedprice FROM {lineitem}")
    return nice(L.dataset_summary(df, ["l_quantity", "l_extendedprice"]), 6)


@query("g33_value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def g33_counts(spark, sf_dir):
    return L.value_counts(bind(spark, sf_dir, "SELECT l_returnflag FROM {lineitem}"), "l_returnflag")


@query("g53_learning_curve", None)
def g53(spark, sf_dir):
    def r2(model, rows):
        return M.regression_metrics(model.transform(rows), [], "price", "prediction").first()["r2_score"]

    return L.learning_curve(scaled_price(spark, sf_dir), "property_id", PRICE_NUMERIC, "price", L.linear_regression, r2,
                            shares=(0.25, 0.5, 1.0))


# Fits whose result is known in closed form: one binary feature, so that a saturated model is a rate or mean per value.
URGENT = """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0D ELSE 0.0D END AS urgent,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0D ELSE 0.0D END AS high, CASE WHEN o_totalprice > 200000 + CASE WHEN o_orderpriority = '1-URGENT'
    THEN 60000 WHEN o_orderpriority = '2-HIGH' THEN -60000 ELSE 0 END THEN 1 ELSE 0 END AS y FROM {orders}"""
URGENT_SQL = plain(URGENT).replace("1.0D", "1.0").replace("0.0D", "0.0")
LARGE = """SELECT p_partkey, CASE WHEN p_size > 25 THEN 1.0D ELSE 0.0D END AS large, p_retailprice + CASE WHEN p_size > 25 THEN 500 ELSE 0 END AS y
  FROM {part}"""
LARGE_SQL = plain(LARGE).replace("1.0D", "1.0").replace("0.0D", "0.0")
_ODDS = "ln(sum(y) / (count(*) - sum(y)))"


@query("g21_logistic_odds", f"""WITH d AS ({URGENT_SQL}), o AS (SELECT {_ODDS} FILTER (WHERE true) AS every FROM d),
  a AS (SELECT {_ODDS} AS plain FROM d WHERE urgent = 0), b AS (SELECT {_ODDS} AS urgent FROM d WHERE urgent = 1)
  SELECT round(urgent - plain, 2) AS slope, round(plain - every, 2) AS intercept FROM o, a, b""".replace(" FILTER (WHERE true)", ""))
def g21_odds(spark, sf_dir):
    fitted = L.logistic_regression(bind(spark, sf_dir, URGENT), ["urgent"], "y", c=1e9).stages[-1]  # balanced: less the odds of all
    return spark.createDataFrame([(round(float(fitted.coefficients[0]), 2), round(float(fitted.intercept), 2))], "slope double, intercept double")


@query("g22_forest_without_noise", f"""SELECT urgent::DOUBLE AS urgent, high::DOUBLE AS high, count(*) AS n,
  CASE WHEN urgent + high > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS probability FROM ({URGENT_SQL}) GROUP BY urgent, high""")
def g22_noiseless(spark, sf_dir):
    df = bind(spark, sf_dir, URGENT).withColumn("y", (F.col("urgent") + F.col("high") > 0).cast("int"))
    scored = L.random_forest(df, ["urgent", "high"], "y", trees=5, depth=2).transform(df)
    return nice(scored.groupBy("urgent", "high").agg(F.count(F.lit(1)).alias("n"), F.max(L.probability()).alias("probability")), 6)


@query("g23_one_round", f"""SELECT urgent::DOUBLE AS urgent, count(*) AS n, round(1 / (1 + exp(-2 * (2 * avg(y) - 1))), 6) AS probability
  FROM ({URGENT_SQL}) GROUP BY urgent""")
def g23_one_round(spark, sf_dir):
    df = bind(spark, sf_dir, URGENT)
    scored = L.boosted_classifier(df, ["urgent"], "y", rounds=1, depth=1, positive_weight=1.0).transform(df)
    return nice(scored.groupBy("urgent").agg(F.count(F.lit(1)).alias("n"), F.max(L.probability()).alias("probability")), 6)


@query("g25_one_round", f"SELECT large::DOUBLE AS large, round(avg(y), 6) AS prediction FROM ({LARGE_SQL}) GROUP BY large")
def g25_one_round(spark, sf_dir):
    df = bind(spark, sf_dir, LARGE)
    scored = L.boosted_regressor(df, ["large"], "y", rounds=1, depth=1).transform(df)
    return nice(scored.groupBy("large").agg(F.max("prediction").alias("prediction")), 6)


@query("g26_vote_of_equals", f"SELECT large::DOUBLE AS large, round(avg(y), 6) AS prediction FROM ({LARGE_SQL}) GROUP BY large")
def g26_vote(spark, sf_dir):
    df = bind(spark, sf_dir, LARGE)
    scored = L.VotingRegressor(rounds=(1, 1), depths=(1, 1), alpha=0.0).fit(df, ["large"], "y").transform(df)
    return nice(scored.groupBy("large").agg(F.max("prediction").alias("prediction")), 6)


@query("g28_importance_of_odds", f"""WITH d AS ({URGENT_SQL}), p AS (SELECT {_ODDS} AS plain FROM d WHERE urgent = 0 AND high = 0),
  u AS (SELECT {_ODDS} AS urgent FROM d WHERE urgent = 1), h AS (SELECT {_ODDS} AS high FROM d WHERE high = 1)
  SELECT 'urgent' AS feature, round(abs(urgent - plain), 2) AS importance FROM p, u UNION ALL SELECT 'high', round(abs(high - plain), 2) FROM p, h""")
def g28_odds(spark, sf_dir):
    model = L.logistic_regression(bind(spark, sf_dir, URGENT), ["urgent", "high"], "y", c=1e9)
    return nice(L.importance_table(spark, ["urgent", "high"], L.importances(model)), 2)


@query("g29_grid_without_noise", f"""WITH s AS (SELECT md5(concat('42:', property_id)) AS h FROM ({PRICE_SQL}))
  SELECT run_id, name, current_stage, metric, 1.0::DOUBLE AS value, (SELECT count(*) FROM s WHERE substr(h, 1, 8) < '33333333') AS n_test
  FROM (VALUES ('run-0', 'plain', 'None'), ('run-1', 'engineered', 'Staging')) r(run_id, name, current_stage),
    (VALUES ('r2_score'), ('train_r2_score')) m(metric)""")
def g29_noiseless(spark, sf_dir):
    df = price(spark, sf_dir).select("property_id", "neighborhood", *PRICE_NUMERIC, "has_garage", "has_pool", "has_fireplace", "has_basement",
                                     "is_renovated", "years_since_renovation", "school_rating")
    df = df.withColumn("price", F.lit(1000.0) + 3 * F.col("square_feet") - 20 * F.col("bedrooms") + 7 * F.col("lot_size"))
    grid = [{"experiment": "linear", "name": name, "feature_version": version, "stage": stage, "kind": "regression", "fit": L.linear_regression}
            for name, version, stage in (("plain", "v1", "None"), ("engineered", "v3", "Staging"))]
    runs = L.experiment_grid(df, "property_id", "price", "price", grid, ["neighborhood"])
    held = X.split_random(df, "property_id").agg(F.count_if("is_test").alias("n")).scalar()
    shown = runs.select("run_id", "name", "current_stage", F.explode("metrics").alias("metric", "value")).withColumn("n_test", held)
    return nice(shown.filter(F.col("metric").isin("r2_score", "train_r2_score")), 6)


CURVE = "SELECT o_orderkey, cast(o_custkey % 50 AS double) AS x, cast(o_totalprice + o_custkey % 50 * 900 AS double) AS y FROM {orders}"


@query("g53_linear_curve", f"""WITH d AS (SELECT x, y, substr(md5(concat('42:', o_orderkey)), 1, 8) < '33333333' AS is_test,
    substr(md5(concat('43:', o_orderkey)), 1, 8) AS h FROM ({plain(CURVE).replace(' double', ' DOUBLE')})),
  s AS (SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS share, unnest(['40000000', '80000000', 'ffffffff']) AS bound),
  f AS (SELECT share, bound, count(*) AS train_size, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS train_score
        FROM d JOIN s ON NOT is_test AND h <= bound GROUP BY ALL),
  v AS (SELECT share, 1 - sum((y - intercept - slope * x) ** 2) / (var_pop(y) * count(*)) AS validation_score FROM d, f WHERE is_test GROUP BY share)
  SELECT share, train_size, round(train_score, 6) AS train_score, round(validation_score, 6) AS validation_score, round(intercept, 3) AS intercept,
    round(slope, 3) AS slope FROM f JOIN v USING (share)""")
def g53_linear(spark, sf_dir):
    curve = L.linear_learning_curve(bind(spark, sf_dir, CURVE), "o_orderkey", ["x"], "y", (0.25, 0.5, 1.0))
    return curve.select("share", "train_size", F.round("train_score", 6).alias("train_score"), F.round("validation_score", 6).alias("validation_score"),
                        F.round("intercept", 3).alias("intercept"), F.round(F.col("coefficients")[0], 3).alias("slope"))
