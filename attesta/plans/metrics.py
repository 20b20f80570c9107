"""Family G, metrics: labels joined to documents, and line items as a larger predictions table."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import metrics as M
from attesta.plans.catalog import bind, plain, query

LABELLED = """SELECT lang, toxic AS y_true, quality AS y_pred, n_chars AS score
  FROM {labels} JOIN {documents} USING (doc_id)"""
SCORED = """SELECT l_linestatus AS segment, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y_pred, l_extendedprice AS score,
  l_extendedprice / (l_extendedprice + 40000) AS proba, l_returnflag AS class_true,
  CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS class_pred FROM {lineitem}"""
PRICED = "SELECT p_brand AS segment, p_retailprice AS y_true, 900.0 + p_size * 2 AS y_pred, p_partkey FROM {part}"
WITH = f"WITH s AS ({plain(SCORED)}), l AS ({plain(LABELLED)}), p AS ({plain(PRICED)}) "


def nice(df, digits=9):
    """Doubles rounded, so that the order of a distributed sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _counts_sql(source, key):
    return f"""c AS (SELECT {key}, count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp,
  count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn,
  count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn FROM {source} GROUP BY {key})"""


def _ratio_sql(num, den, name):
    return f"round(CASE WHEN {den} = 0 THEN 0 ELSE ({num}) / ({den}) END, 9) AS {name}"


_AUC_SQL = """auc AS (SELECT {key}, sum(pos * (2 * upto - neg)) / (2.0 * sum(pos) * sum(neg)) AS roc_auc FROM (
  SELECT *, sum(neg) OVER (PARTITION BY {key} ORDER BY score) AS upto FROM (SELECT {key}, score,
    count(*) FILTER (y_true = 1)::DOUBLE AS pos, count(*) FILTER (y_true = 0)::DOUBLE AS neg FROM {src}
    GROUP BY {key}, score)) GROUP BY {key})"""
_PRF = ", ".join([_ratio_sql("tp + tn", "tp + fp + fn + tn", "accuracy"), _ratio_sql("tp", "tp + fp", "precision"),
                  _ratio_sql("tp", "tp + fn", "recall"), _ratio_sql("2 * tp", "2 * tp + fp + fn", "f1_score")])
_AUC_VALUE = "CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN round(roc_auc, 9) END AS roc_auc"


def scored(spark, sf_dir):
    return bind(spark, sf_dir, SCORED)


@query("eval_by_lang", WITH + f", {_counts_sql('l', 'lang')}, {_AUC_SQL.format(key='lang', src='l')} SELECT lang, {_PRF}, "
       f"{_AUC_VALUE} FROM c JOIN auc USING (lang)")
def eval_by_lang(spark, sf_dir):
    df = bind(spark, sf_dir, LABELLED)
    out = M.classification_metrics(df, ["lang"], "y_true", "y_pred")
    out = out.join(M.roc_auc(df, ["lang"], "y_true", "score"), "lang")
    return nice(out.select("lang", "accuracy", "precision", "recall", "f1_score", "roc_auc"))


@query("g40_accuracy_prf", WITH + f", {_counts_sql('s', 'segment')} SELECT segment, {_PRF} FROM c")
def g40(spark, sf_dir):
    out = M.classification_metrics(scored(spark, sf_dir), ["segment"], "y_true", "y_pred")
    return nice(out.select("segment", "accuracy", "precision", "recall", "f1_score"))


@query("g41_roc_auc", WITH + f", {_AUC_SQL.format(key='segment', src='s')} SELECT segment, round(roc_auc, 9) AS roc_auc FROM auc")
def g41(spark, sf_dir):
    return nice(M.roc_auc(scored(spark, sf_dir), ["segment"], "y_true", "score"))


@query("g41_roc_auc_overall", WITH.replace("l_linestatus AS segment", "'all' AS segment") +
       f", {_AUC_SQL.format(key='segment', src='s')} SELECT round(roc_auc, 9) AS roc_auc FROM auc")
def g41_overall(spark, sf_dir):
    return nice(M.roc_auc(scored(spark, sf_dir), [], "y_true", "score"))


@query("g42_log_loss", WITH + """SELECT segment, round(avg(-ln(greatest(least(CASE WHEN y_true = 1 THEN proba ELSE 1 - proba
  END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 9) AS log_loss FROM s GROUP BY segment""")
def g42(spark, sf_dir):
    return nice(M.log_loss(scored(spark, sf_dir), ["segment"], "y_true", "proba"))


@query("g43_matthews", WITH + f", {_counts_sql('s', 'segment')} SELECT segment, " + _ratio_sql(
    "tp * tn - fp * fn", "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)", "matthews_corrcoef") + " FROM c")
def g43(spark, sf_dir):
    return nice(M.classification_metrics(scored(spark, sf_dir), ["segment"], "y_true", "y_pred")
                .select("segment", "matthews_corrcoef"))


_DOWN_SQL = """d AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY segment) AS p,
  sum(neg) OVER (PARTITION BY segment) AS n FROM (SELECT segment, score, count(*) FILTER (y_true = 1)::DOUBLE AS pos,
  count(*) FILTER (y_true = 0)::DOUBLE AS neg FROM s GROUP BY segment, score)
  WINDOW w AS (PARTITION BY segment ORDER BY score DESC))"""


@query("g44_pr_auc", WITH + f""", {_DOWN_SQL}, e AS (SELECT *, tp / (tp + fp) AS prec,
    coalesce(lag(tp / (tp + fp)) OVER (PARTITION BY segment ORDER BY score DESC), 1) AS prev FROM d)
  SELECT segment, round(sum(pos / p * (prec + prev) / 2), 9) AS pr_auc FROM e GROUP BY segment""")
def g44(spark, sf_dir):
    return nice(M.pr_auc(scored(spark, sf_dir), ["segment"], "y_true", "score"))


@query("g45_specificity", WITH + f", {_counts_sql('s', 'segment')} SELECT segment, "
       + _ratio_sql("tn", "tn + fp", "specificity") + " FROM c")
def g45(spark, sf_dir):
    return nice(M.classification_metrics(scored(spark, sf_dir), ["segment"], "y_true", "y_pred")
                .select("segment", "specificity"))


@query("g46_confusion_matrix", WITH + """, k AS (SELECT DISTINCT class_true AS v FROM s UNION SELECT DISTINCT class_pred FROM s)
  SELECT a.v AS y_true, b.v AS y_pred, count(s.class_true) AS n FROM k a JOIN k b ON true
  LEFT JOIN s ON s.class_true = a.v AND s.class_pred = b.v GROUP BY a.v, b.v""")
def g46(spark, sf_dir):
    return M.confusion_matrix(scored(spark, sf_dir), "class_true", "class_pred", ["A", "N", "R"])


@query("g46_confusion_pairs", WITH + "SELECT class_true AS y_true, class_pred AS y_pred, count(*) AS n FROM s GROUP BY ALL")
def g46_pairs(spark, sf_dir):
    return M.confusion_matrix(scored(spark, sf_dir), "class_true", "class_pred")


@query("g47_classification_report", WITH + """, k AS (SELECT v AS label, (SELECT count(*) FROM s WHERE class_true = v) AS support,
    (SELECT count(*) FROM s WHERE class_pred = v) AS predicted,
    (SELECT count(*) FROM s WHERE class_true = v AND class_pred = v) AS tp FROM (VALUES ('A'), ('N'), ('R')) t(v)),
  r AS (SELECT label, tp / predicted AS precision, tp / support AS recall, 2 * tp / (predicted + support) AS f1_score,
    support, tp FROM k)
  SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support FROM r
  UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9),
    sum(support)::BIGINT FROM r
  UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
    round(sum(recall * support) / sum(support), 9), round(sum(f1_score * support) / sum(support), 9), sum(support)::BIGINT FROM r
  UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), sum(support)::BIGINT FROM r""")
def g47(spark, sf_dir):
    return nice(M.classification_report(scored(spark, sf_dir), "class_true", "class_pred"))


@query("g48_regression_metrics", WITH + """SELECT segment, round(sqrt(avg(power(y_true - y_pred, 2))), 6) AS rmse,
  round(avg(abs(y_true - y_pred)), 6) AS mae,
  round(1 - sum(power(y_true - y_pred, 2)) / (var_pop(y_true) * count(*)), 6) AS r2_score,
  round(avg(abs((y_true - y_pred) / y_true)) * 100, 6) AS mape, round(max(abs(y_true - y_pred)), 6) AS max_error
  FROM p GROUP BY segment""")
def g48(spark, sf_dir):
    return nice(M.regression_metrics(bind(spark, sf_dir, PRICED), ["segment"], "y_true", "y_pred"), 6)


@query("g49_roc_points", WITH + f""", {_DOWN_SQL} SELECT segment, score AS threshold, round(fp / n, 9) AS fpr,
  round(tp / p, 9) AS tpr FROM d UNION ALL SELECT DISTINCT segment, 'Infinity'::DOUBLE, 0.0, 0.0 FROM d""")
def g49(spark, sf_dir):
    out = M.roc_points(scored(spark, sf_dir), ["segment"], "y_true", "score")
    return out.select("segment", "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("g50_pr_points", WITH + f""", {_DOWN_SQL} SELECT segment, score AS threshold, round(tp / (tp + fp), 9) AS precision,
  round(tp / p, 9) AS recall FROM d UNION ALL SELECT DISTINCT segment, NULL::DOUBLE, 1.0, 0.0 FROM d""")
def g50(spark, sf_dir):
    return nice(M.pr_points(scored(spark, sf_dir), ["segment"], "y_true", "score"))


@query("g51_residuals", WITH + """, r AS (SELECT y_true - y_pred AS residual FROM p),
  e AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 50 AS w FROM r),
  c AS (SELECT least(floor((residual - lo) / w), 49)::INT AS bin, count(*) AS n FROM r, e GROUP BY 1)
  SELECT b::INT AS bin, round(lo + b * w, 6) AS left_edge, coalesce(n, 0) AS n
  FROM range(50) t(b) CROSS JOIN e LEFT JOIN c ON c.bin = b""")
def g51(spark, sf_dir):
    return nice(M.residual_histogram(M.residuals(bind(spark, sf_dir, PRICED), "y_true", "y_pred")), 6)


@query("g52_predicted_vs_actual", WITH + """SELECT p_partkey, y_true, y_pred,
  (SELECT least(min(y_true), min(y_pred)) FROM p) AS axis_min, (SELECT greatest(max(y_true), max(y_pred)) FROM p) AS axis_max
  FROM p""")
def g52(spark, sf_dir):
    return M.predicted_vs_actual(bind(spark, sf_dir, PRICED), "y_true", "y_pred").drop("segment").withColumns(
        {c: F.col(c).cast("double") for c in ("y_pred", "axis_min", "axis_max")})
