"""Spark ML pipelines for the feature sets: fit, score, importance, experiment grids and summaries."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as C, regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.operators import features as X, metrics as M
from attesta.operators.scans import exact_median, running_totals_by_key
from attesta.session import scratch_path


#: Numbers (features, and what a tree keeps of a row) that a task holds of the rows that a fit reads again and again.
NUMBERS_PER_TASK, KEPT_OF_A_ROW = 4_000_000, 8


class _FeatureParams(Params):
    family = Param(Params._dummy(), "family", "feature family", TypeConverters.toString)
    version = Param(Params._dummy(), "version", "feature version", TypeConverters.toString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    state = Param(Params._dummy(), "state", "fitted labels and scaler as JSON", TypeConverters.toString)


class FeatureEngineer(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit sorted labels on the raw frame (a table per column below the shared folder, named in the state) and a population
    scaler on the engineered frame."""

    @keyword_only
    def __init__(self, *, family=None, version="v1", categorical=()):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FeatureEngineerModel:
        categorical = self.getOrDefault(self.categorical)
        labels = {}
        for column in categorical:  # a table each, below the shared folder: there may be any number of categories
            labels[column] = scratch_path(dataset.sparkSession, "labels")
            X.label_table(dataset, column).write.parquet(labels[column])
        made = X.add_features(dataset, self.getOrDefault(self.family), self.getOrDefault(self.version))
        numeric = [c for c, t in made.dtypes if c not in categorical and t != "string"]
        stats = X.scaler_stats(made, numeric).first()["stats"]
        state = {"labels": labels, "columns": made.columns,
                 "scaler": {c: [stats[c]["mean"], stats[c]["std"]] for c in numeric}}
        model = FeatureEngineerModel()
        self._copyValues(model)
        return model._set(state=json.dumps(state))


class FeatureEngineerModel(Model, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Engineered, encoded and scaled columns, in the frame's order. A number that is missing counts as the fitted rows' mean."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.isSet(self.state):
            raise ValueError("fit before transform")
        state = json.loads(self.getOrDefault(self.state))
        made = X.add_features(dataset, self.getOrDefault(self.family), self.getOrDefault(self.version))
        for column, path in state["labels"].items():
            made = X.label_encode(made, column, dataset.sparkSession.read.parquet(path))
        done = {}
        for column, (mean, std) in state["scaler"].items():
            if column in made.columns:
                done[column] = F.coalesce((F.col(column) - F.lit(mean)) / F.lit(std), F.lit(0.0))
        return made.withColumns(done)

    def feature_names(self) -> list[str]:
        return json.loads(self.getOrDefault(self.state))["columns"]


def _pipeline(features: Sequence[str], stage) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), stage])


def dealt_for_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the rows a fit keeps in memory, in tasks of a bounded size: a small file of many rows is one task, and all of
    its rows would be held by it. Few rows stay as they come."""
    rows = df.select(*dict.fromkeys(columns))
    tasks = -(-df.count() * (len(rows.columns) + KEPT_OF_A_ROW) // NUMBERS_PER_TASK)
    return rows if tasks <= 1 else rows.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))


def logistic_regression(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, balanced: bool = True,
                        max_iter: int = 100) -> PipelineModel:
    weighted = X.balanced_weights(df, label) if balanced else df.withColumn("weight", F.lit(1.0))
    stage = C.LogisticRegression(labelCol=label, weightCol="weight", regParam=1 / (c * max(df.count(), 1)),
                                 elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return _pipeline(features, stage).fit(dealt_for_fit(weighted, [*features, label, "weight"]))


def random_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10,
                  min_leaf: int = 1, balanced: bool = True, seed: int = 42) -> PipelineModel:
    weighted = X.balanced_weights(df, label) if balanced else df.withColumn("weight", F.lit(1.0))
    stage = C.RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth,
                                     minInstancesPerNode=min_leaf, seed=seed)
    return _pipeline(features, stage).fit(dealt_for_fit(weighted, [*features, label, "weight"]))


def boosted_classifier(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 6,
                       rate: float = 0.1, subsample: float = 1.0, positive_weight: float | None = None,
                       focal: bool = False, seed: int = 42) -> PipelineModel:
    """Boosted trees; positives weigh ``positive_weight``, by default negatives per positive (doubled if focal)."""
    if positive_weight is None:
        positive_weight = X.scale_pos_weight(df, label, focal).first()[0] or 1.0
    weighted = df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(1.0))
    stage = C.GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate,
                            subsamplingRate=subsample, seed=seed)
    return _pipeline(features, stage).fit(dealt_for_fit(weighted, [*features, label, "weight"]))


def linear_regression(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0) -> PipelineModel:
    """Least squares, or ridge: squared error plus ``alpha`` times the squared coefficients.

    Spark divides the penalty by the label's deviation and averages the error, so both are multiplied back.
    """
    reg = 0.0
    if alpha:
        stats = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
        reg = alpha * (stats["s"] or 1.0) / max(stats["n"], 1)
    stage = R.LinearRegression(labelCol=label, regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal")
    return _pipeline(features, stage).fit(df)


def boosted_regressor(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 5,
                      rate: float = 0.1, min_leaf: int = 1, seed: int = 42) -> PipelineModel:
    stage = R.GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf,
                           seed=seed)
    return _pipeline(features, stage).fit(dealt_for_fit(df, [*features, label]))


class VotingRegressor:
    """Mean of a ridge and two boosted models; importance is the mean of the boosted two."""

    def __init__(self, rounds: tuple[int, int] = (100, 150), depths: tuple[int, int] = (5, 4),
                 rates: tuple[float, float] = (0.1, 0.05), alpha: float = 10.0, seed: int = 42):
        self.rounds, self.depths, self.rates, self.alpha, self.seed = rounds, depths, rates, alpha, seed
        self.models: list[PipelineModel] = []

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> VotingRegressor:
        boosted = [boosted_regressor(df, features, label, n, d, r, seed=self.seed + i)
                   for i, (n, d, r) in enumerate(zip(self.rounds, self.depths, self.rates))]
        self.models = [linear_regression(df, features, label, self.alpha), *boosted]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("fit before transform")
        for i, model in enumerate(self.models):
            df = model.transform(df).drop("features").withColumnRenamed("prediction", f"_p{i}")
        mean = sum((F.col(f"_p{i}") for i in range(1, len(self.models))), F.col("_p0")) / len(self.models)
        return df.withColumn("prediction", mean).drop(*[f"_p{i}" for i in range(len(self.models))])

    def importances(self) -> list[float]:
        a, b = (m.stages[-1].featureImportances.toArray() for m in self.models[1:])
        return [float(x) for x in (a + b) / 2]


def probability(col: str = "probability") -> Column:
    return vector_to_array(col)[1]


def threshold_predict(proba: Column, threshold: float = 0.5) -> Column:
    return F.when(proba >= threshold, 1).otherwise(0)


def importances(model: PipelineModel) -> list[float]:
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        return [float(x) for x in last.featureImportances.toArray()]
    return [abs(float(x)) for x in last.coefficients.toArray()]


def importance_table(spark: SparkSession, features: Sequence[str], values: Sequence[float], top: int = 20) -> DataFrame:
    rows = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(top)


def risk_level(proba: Column) -> Column:
    """Bands (0, 0.3], (0.3, 0.7], (0.7, 1]; anything else, 0 included, has none."""
    return (F.when((proba > 0) & (proba <= 0.3), "Low").when((proba > 0.3) & (proba <= 0.7), "Medium")
            .when((proba > 0.7) & (proba <= 1), "High"))


def score_and_band(df: DataFrame, proba: Column, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("probability", proba).withColumns({
        "prediction": threshold_predict(F.col("probability"), threshold), "risk_level": risk_level(F.col("probability"))})


def price_errors(df: DataFrame, predicted: str, actual: str | None = None) -> DataFrame:
    """Whole predicted prices; with an actual price also difference and percent error."""
    out = df.withColumn("predicted_price", F.col(predicted).cast("bigint"))
    if actual is None or actual not in df.columns:
        return out
    diff = F.col("predicted_price") - F.col(actual)
    percent = F.try_divide(diff.cast("double"), F.col(actual)) * 100
    return out.withColumns({"price_difference": diff, "percent_error": F.rint(percent * 100) / 100})


def classification_summary(df: DataFrame) -> DataFrame:
    """One row: totals, positives, share, mean probability and the band counts in band order."""
    bands = [F.count_if(F.col("risk_level") == b).alias(f"n_{b.lower()}") for b in ("Low", "Medium", "High")]
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum("prediction").alias("positives"),
                  F.avg("prediction").alias("share"), F.avg("probability").alias("mean_probability"), *bands)


def price_summary(df: DataFrame) -> DataFrame:
    median = exact_median(df.select("predicted_price"), "predicted_price").scalar()
    return df.agg(F.avg("predicted_price").alias("mean_price"), F.min("predicted_price").alias("min_price"),
                  F.max("predicted_price").alias("max_price"), F.avg(F.abs("price_difference")).alias("mean_abs_error"),
                  F.avg(F.abs("percent_error")).alias("mean_percent_error")).withColumn("median_price", median)


def dataset_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of every column, one row per column, quartiles exact.

    The table is read once, however many columns: every cell becomes a (column, value) row, equal ones are counted, and the
    ranks of all quartiles of all columns are found together over these counts. Nulls are left out; a column of nothing else
    has count 0.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("c"))
    counts = cells.select("c.*").filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("count"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
                                          F.min("v").alias("min"), F.max("v").alias("max"))
    ranks = running_totals_by_key(counts, ["column"], "v", {"upto": "n"}).join(F.broadcast(totals), "column")  # a row per column

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col("v")))

    quartiles = []
    for share in (0.25, 0.5, 0.75):
        place = (F.col("count") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        quartiles.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"p{int(share * 100)}"))
    apart = F.col("v") - F.col("mean")
    std = F.sqrt(F.try_divide(F.sum(apart * apart * F.col("n")), F.max(F.col("count")) - 1)).alias("std")
    found = ranks.groupBy("column").agg(*quartiles, std, *[F.max(c).alias(c) for c in ("count", "mean", "min", "max")])
    named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    return named.join(found, "column", "left").select("column", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "p25",
                                                      "p50", "p75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def experiment_grid(df: DataFrame, key: str, target: str, family: str, experiments: Sequence[Mapping],
                    categorical: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Fit every configuration on one split; one registry run row each, for the registry operators.

    A configuration holds experiment, name, feature_version, stage, fit(train, features, target) and kind
    ("classification" or "regression").
    """
    spark = df.sparkSession
    classed = experiments[0]["kind"] == "classification"
    split = X.split_stratified(df, key, target, seed=seed) if classed else X.split_random(df, key, seed=seed)
    runs = []
    for number, conf in enumerate(experiments):
        engineer = FeatureEngineer(family=family, version=conf["feature_version"], categorical=list(categorical))
        inputs = split.withColumn("_y", F.col(target).cast("double"))
        raw = [c for c in df.columns if c not in (key, target)]
        fitted = engineer.fit(inputs.filter(~F.col("is_test")).select(*raw))
        names = [c for c in fitted.feature_names()]
        ready = fitted.transform(inputs.withColumnRenamed(target, "_target")).withColumnRenamed("_y", target)
        train, test = ready.filter(~F.col("is_test")), ready.filter(F.col("is_test"))
        model = conf["fit"](train, names, target)
        metrics = {}
        for prefix, part in (("train_", train), ("", test)):
            scored = model.transform(part)
            if classed:
                table = M.imbalanced_metrics(scored.withColumn("_score", probability()), [], target, "prediction", "_score")
                row = table.drop("tp", "fp", "fn", "tn").first().asDict()
            else:
                row = M.regression_metrics(scored, [], target, "prediction").first().asDict()
            metrics |= {prefix + k: float(v) for k, v in row.items() if v is not None}
        runs.append((f"run-{number}", conf["experiment"], conf["name"], str(number + 1), conf["stage"], metrics,
                     {"feature_version": conf["feature_version"]}, {"mlflow.log-model.history": conf["name"]}))
    return spark.createDataFrame(runs, "run_id string, experiment_name string, name string, version string, "
                                 "current_stage string, metrics map<string,double>, params map<string,string>, "
                                 "tags map<string,string>")


def learning_curve(df: DataFrame, key: str, features: Sequence[str], label: str, fit, score,
                   shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), seed: int = 42) -> DataFrame:
    """Train on nested hash fractions of the training rows; score(model, rows) gives one number."""
    split = X.split_random(df, key, seed=seed).withColumn("_h", X.split_hash(F.col(key), seed + 1))
    train, held = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    rows = []
    for share in shares:
        part = train.filter(F.substring("_h", 1, 8) <= f"{min(int(share * 2 ** 32), 2 ** 32 - 1):08x}")
        model = fit(part, features, label)
        rows.append((float(share), part.count(), float(score(model, part)), float(score(model, held))))
    return df.sparkSession.createDataFrame(rows, "share double, train_size long, train_score double, validation_score double")


def linear_learning_curve(df: DataFrame, key: str, features: Sequence[str], label: str,
                          shares: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), alpha: float = 0.0, seed: int = 42) -> DataFrame:
    """The learning curve of least squares (or ridge) in one scan: share, train_size, train_score, validation_score (r2),
    intercept and coefficients.

    Rows meet as sums of products only: a Gram matrix per slice of the hash between two shares, and one of the held-out
    rows. The matrix of a share is the sum of its slices, and fit and scores follow from it. Splits are those of
    :func:`learning_curve`. Rows with a null among features and label are left out.
    """
    shares = sorted(shares)
    split = X.split_random(df, key, seed=seed).withColumn("_h", F.substring(X.split_hash(F.col(key), seed + 1), 1, 8))
    bounds = [f"{min(int(share * 2 ** 32), 2 ** 32 - 1):08x}" for share in shares]
    part = F.when(F.col("is_test"), -1)
    for i, bound in enumerate(bounds):
        part = part.when(F.col("_h") <= bound, i)
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, label)]]
    known = split.withColumn("_part", part).filter(F.col("_part").isNotNull()).dropna(subset=[*features, label])
    sums = known.groupBy("_part").agg(*[F.sum(terms[i] * terms[j]).alias(f"_g{i}_{j}") for i in range(len(terms)) for j in range(i + 1)])
    grams = {}
    for row in sums.collect():  # a row per share, and one
        gram = np.empty((len(terms), len(terms)))
        for i in range(len(terms)):
            for j in range(i + 1):
                gram[i, j] = gram[j, i] = row[f"_g{i}_{j}"]
        grams[row["_part"]] = gram
    empty = np.zeros((len(terms), len(terms)))

    def r2(gram, beta):
        n, total, square = gram[0, 0], gram[0, -1], gram[-1, -1]
        if not n or square - total * total / n <= 0:
            return None
        error = square - 2 * beta @ gram[:-1, -1] + beta @ gram[:-1, :-1] @ beta
        return float(1 - error / (square - total * total / n))

    rows, gram = [], empty
    for i, share in enumerate(shares):
        gram = gram + grams.get(i, empty)
        if not gram[0, 0]:
            rows.append((float(share), 0, None, None, None, None))
            continue
        penalty = alpha * np.diag([0.0] + [1.0] * len(features))
        beta = np.linalg.lstsq(gram[:-1, :-1] + penalty, gram[:-1, -1], rcond=None)[0]
        rows.append((float(share), int(gram[0, 0]), r2(gram, beta), r2(grams.get(-1, empty), beta), float(beta[0]), [float(b) for b in beta[1:]]))
    return df.sparkSession.createDataFrame(rows, "share double, train_size long, train_score double, validation_score double, "
                                           "intercept double, coefficients array<double>")
