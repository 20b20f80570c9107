"""Exact evaluation metrics over a predictions table, grouped by any key columns.

Binary truth and prediction columns hold 0 and 1; scores are any numeric column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attesta.operators.scans import running_totals

EPSILON = 2.220446049250313e-16
_WIDE = "decimal(19,0)"


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _grouped(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def confusion_counts(df: DataFrame, keys: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    return _grouped(df, keys, F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                    F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def classification_metrics(df: DataFrame, keys: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    """accuracy, precision, recall, f1, specificity and matthews from one pass of conditional counts; 0 if undefined."""
    c = confusion_counts(df, keys, y_true, y_pred)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return c.select(*keys, "tp", "fp", "fn", "tn", _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"), _ratio(tn, tn + fp).alias("specificity"),
                    _ratio(tp * tn - fp * fn, spread).alias("matthews_corrcoef"))


def score_counts(df: DataFrame, keys: Sequence[str], y_true: str, score: str) -> DataFrame:
    """Rows collapsed to one per distinct score, so ties cost nothing downstream."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(F.col(y_true) == 1).alias("pos"), F.count_if(F.col(y_true) == 0).alias("neg"))


def roc_auc(df: DataFrame, keys: Sequence[str], y_true: str, score: str) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null where only one class occurs."""
    counts = score_counts(df, keys, y_true, score)
    run = running_totals(counts, keys, ["score"], {"pos_to_here": "pos", "neg_to_here": "neg"},
                         source=df.select(F.col(score).alias("score")))
    # Twice the number of (positive, negative) pairs ordered rightly, in exact integers.
    pairs = F.col("pos").cast(_WIDE) * (2 * F.col("neg_to_here") - F.col("neg")).cast(_WIDE)
    sums = _grouped(run, keys, F.sum(pairs).cast("double").alias("_pairs"),
                    F.max("pos_to_here").cast("double").alias("_p"), F.max("neg_to_here").cast("double").alias("_n"))
    return sums.select(*keys, F.try_divide(F.col("_pairs"), 2 * F.col("_p") * F.col("_n")).alias("roc_auc"))


def _descending(df: DataFrame, keys: Sequence[str], y_true: str, score: str) -> DataFrame:
    """Per distinct score from the highest down: true and false positives, and the totals of the group."""
    counts = score_counts(df, keys, y_true, score).withColumn("_down", -F.col("score"))
    return running_totals(counts, keys, ["_down"], {"tp": "pos", "fp": "neg"},
                          source=df.select((-F.col(score)).alias("_down"))).drop("_down")


def _with_totals(run: DataFrame, df: DataFrame, keys: Sequence[str], y_true: str) -> DataFrame:
    totals = _grouped(df, keys, F.count_if(F.col(y_true) == 1).alias("_p"), F.count_if(F.col(y_true) == 0).alias("_n"))
    if not keys:
        return run.withColumns({c: totals.select(c).scalar() for c in ("_p", "_n")})
    totals = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_p", "_n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return run.join(totals, same).drop(*[f"_k_{k}" for k in keys])


def _precision(tp: Column, fp: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(empty))


def pr_auc(df: DataFrame, keys: Sequence[str], y_true: str, score: str) -> DataFrame:
    """Trapezoid under (recall, precision), starting at (0, 1); without positives recall counts as 1, so 0.5."""
    run = _descending(df, keys, y_true, score)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    height = _precision(tp, fp, 1.0) + _precision(tp - pos, fp - neg, 1.0)
    area = F.sum(pos * height / 2).cast("double")
    sums = _grouped(run, keys, area.alias("_a"), F.sum("pos").cast("double").alias("_p"))
    return sums.select(*keys, F.coalesce(F.try_divide("_a", "_p"), F.lit(0.5)).alias("pr_auc"))


def roc_points(df: DataFrame, keys: Sequence[str], y_true: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and the start point (inf, 0, 0) per group."""
    run = _with_totals(_descending(df, keys, y_true, score), df, keys, y_true)
    points = run.select(*keys, F.col("score").cast("double").alias("threshold"),
                        F.try_divide(F.col("fp").cast("double"), F.col("_n")).alias("fpr"),
                        F.try_divide(F.col("tp").cast("double"), F.col("_p")).alias("tpr"))
    start = (df.select(*keys).distinct() if keys else df.agg(F.count(F.lit(1)).alias("_c"))).select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_points(df: DataFrame, keys: Sequence[str], y_true: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score, and the end point (null, 1, 0) per group."""
    run = _with_totals(_descending(df, keys, y_true, score), df, keys, y_true)
    points = run.select(*keys, F.col("score").cast("double").alias("threshold"),
                        _precision(F.col("tp"), F.col("fp"), 1.0).alias("precision"),
                        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("_p")), F.lit(1.0)).alias("recall"))
    end = (df.select(*keys).distinct() if keys else df.agg(F.count(F.lit(1)).alias("_c"))).select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def log_loss(df: DataFrame, keys: Sequence[str], y_true: str, proba: str) -> DataFrame:
    """Mean negative log of the true class's probability, clipped by the machine epsilon; null for one class."""
    p = F.greatest(F.least(F.col(proba), F.lit(1 - EPSILON)), F.lit(EPSILON))
    loss = -F.log(F.when(F.col(y_true) == 1, p).otherwise(1 - p))
    both = F.min(y_true) != F.max(y_true)
    return _grouped(df, keys, F.when(both, F.avg(loss)).alias("log_loss"))


def imbalanced_metrics(df: DataFrame, keys: Sequence[str], y_true: str, y_pred: str, score: str) -> DataFrame:
    """All classification metrics with ROC and precision-recall areas."""
    out = classification_metrics(df, keys, y_true, y_pred)
    for part in (roc_auc(df, keys, y_true, score), pr_auc(df, keys, y_true, score)):
        names = [c for c in part.columns if c not in keys]
        if not keys:
            out = out.withColumns({c: part.select(c).scalar() for c in names})
            continue
        part = part.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *names)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = out.join(part, same, "left").drop(*[f"_k_{k}" for k in keys])
    return out


def pair_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, labels: Sequence | None = None) -> DataFrame:
    """(true, predicted) label pairs with their counts: those that occur, or, for the ``labels`` asked for, every pair of
    them with zero cells."""
    counts = pair_counts(df, y_true, y_pred)
    if labels is None:
        return counts
    kind = df.schema[y_true].dataType
    every = F.array(*[F.lit(v).cast(kind) for v in labels])
    grid = df.sparkSession.range(1).select(F.explode(every).alias("y_true")).select("y_true", F.explode(every).alias("y_pred"))
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Per class precision, recall, f1 and support, then accuracy, macro and weighted averages."""
    n, t, p = F.col("n"), F.col("y_true"), F.col("y_pred")
    zero = F.lit(0).cast("bigint")
    cells = F.array(F.struct(t.alias("label"), n.alias("support"), zero.alias("predicted"),
                             F.when(t == p, n).otherwise(zero).alias("tp")),
                    F.struct(p.alias("label"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")))
    per = (pair_counts(df, y_true, y_pred).select(F.explode(cells).alias("c")).groupBy("c.label")
           .agg(F.sum("c.support").alias("support"), F.sum("c.predicted").alias("predicted"), F.sum("c.tp").alias("tp")))
    per = per.select(F.col("label").cast("string").alias("label"),
                     _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
                     _ratio(F.col("tp"), F.col("support")).alias("recall"),
                     _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1_score"), "support", "tp")
    scores = ("precision", "recall", "f1_score")
    macro = per.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weighted = per.agg(*[_ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(s) for s in scores],
                       F.sum("support").alias("support"))
    accuracy = per.agg(_ratio(F.sum("tp"), F.sum("support")).alias("f1_score"), F.sum("support").alias("support"))
    none = F.lit(None).cast("double")
    rows = [per.drop("tp"), macro.withColumn("label", F.lit("macro avg")),
            weighted.withColumn("label", F.lit("weighted avg")),
            accuracy.withColumns({"label": F.lit("accuracy"), "precision": none, "recall": none})]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def regression_metrics(df: DataFrame, keys: Sequence[str], y_true: str, y_pred: str) -> DataFrame:
    """rmse, mae, r2_score, mape (in percent; a zero actual gives infinity) and max_error."""
    t, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    diff = t - p
    inf = F.when(diff == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    share = F.when(t == 0, inf).otherwise(F.abs(F.try_divide(diff, t)))
    spread = F.var_pop(t) * F.count(t)
    misses = F.sum(diff * diff)
    r2 = F.when(spread == 0, F.when(misses == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(misses, spread))
    return _grouped(df, keys, F.sqrt(F.avg(diff * diff)).alias("rmse"), F.avg(F.abs(diff)).alias("mae"),
                    r2.alias("r2_score"), (F.avg(share) * 100).alias("mape"), F.max(F.abs(diff)).alias("max_error"))


def residuals(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.withColumn("residual", F.col(y_true).cast("double") - F.col(y_pred).cast("double"))


def residual_histogram(df: DataFrame, column: str = "residual", bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins have count 0."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.struct(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                                F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).alias("e")).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    slot = F.least(F.floor((F.col(column) - ends["lo"]) / width), F.lit(bins - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (ends["lo"] + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def predicted_vs_actual(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """The pairs with the axis limits common to both columns."""
    limits = df.agg(F.struct(F.least(F.min(y_true), F.min(y_pred)).alias("lo"),
                             F.greatest(F.max(y_true), F.max(y_pred)).alias("hi")).alias("e")).scalar()
    return df.withColumns({"axis_min": limits["lo"], "axis_max": limits["hi"]})
