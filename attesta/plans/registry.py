"""Family D: nations are experiments, customers models, orders versions with their runs, line items artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import registry as G
from attesta.operators.grams import match_pattern_table
from attesta.plans.catalog import bind, partitions, plain, query

EXPERIMENTS = """SELECT cast(n_nationkey AS string) AS experiment_id, n_name AS name,
  CASE WHEN n_nationkey % 7 = 3 THEN 'deleted' ELSE 'active' END AS lifecycle_stage,
  concat('store/', cast(n_nationkey AS string)) AS artifact_location, r_name AS project
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""
VERSIONS = """SELECT c_name AS name, cast(o_orderkey AS string) AS version,
  CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging' ELSE 'None' END AS current_stage,
  concat('run', cast(o_orderkey AS string)) AS run_id, o_orderdate AS written, o_orderkey AS seq
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
RUNS = """SELECT concat('run', cast(o_orderkey AS string)) AS run_id,
  CASE WHEN c_nationkey = 5 THEN cast(NULL AS string) ELSE cast(c_nationkey AS string) END AS experiment_id,
  concat('run ', o_orderpriority) AS run_name,
  CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '1-URGENT' THEN cast(NULL AS string) ELSE o_orderpriority END AS logged,
  CASE WHEN o_orderstatus <> 'P' THEN max_price END AS max_price, min_qty / 64 AS train_qty, max_tax AS train_tax,
  CASE WHEN o_orderstatus = 'F' THEN min_discount END AS accuracy, o_orderpriority AS priority, c_mktsegment AS segment
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS max_price, min(l_quantity) AS min_qty, max(l_tax) AS max_tax,
             min(l_discount) AS min_discount FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""
ARTIFACTS = """SELECT concat('run', cast(l_orderkey AS string)) AS run_id,
  concat(CASE l_returnflag WHEN 'A' THEN 'plots/roc_curve_' WHEN 'N' THEN 'data/feature_importance_' ELSE 'notes/n-' END,
    cast(l_linenumber AS string), '_', cast(l_partkey AS string), '_', cast(l_suppkey AS string),
    CASE l_returnflag WHEN 'A' THEN '.png' WHEN 'N' THEN '.csv' ELSE '.txt' END) AS path,
  l_linestatus = 'O' AND l_linenumber = 1 AS is_dir, l_linenumber AS seq FROM {lineitem}"""
CTES = (f"WITH experiments AS ({plain(EXPERIMENTS)}), versions AS ({plain(VERSIONS)}), runs AS ({plain(RUNS)}), "
        f"artifacts AS ({plain(ARTIFACTS)}) ")
METRICS = ("max_price", "train_qty", "train_tax", "accuracy")


def experiments(spark, sf_dir):
    return bind(spark, sf_dir, EXPERIMENTS).withColumn("tags", F.create_map(F.lit("project_id"), F.col("project")))


def versions(spark, sf_dir):
    return bind(spark, sf_dir, VERSIONS)


def runs(spark, sf_dir):
    metrics = F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])
    return bind(spark, sf_dir, RUNS).select(
        "run_id", "experiment_id", "run_name", F.map_filter(metrics, lambda _, v: v.isNotNull()).alias("metrics"),
        F.create_map(F.lit("priority"), F.col("priority"), F.lit("segment"), F.col("segment")).alias("params"),
        F.create_map(F.lit("mlflow.log-model.history"), F.col("logged"), F.lit("owner"), F.lit("x")).alias("tags"))


def artifacts(spark, sf_dir):
    return bind(spark, sf_dir, ARTIFACTS)


NAME_RULE = "(name GLOB 'NATION_1*' OR name GLOB 'NATION_?' OR name = 'NATION_22')"
NAMES = ["NATION_1*", "NATION_?", "NATION_22"]


@query("d01_target_experiments", CTES + f"""SELECT experiment_id, name FROM experiments
  WHERE lifecycle_stage <> 'deleted' AND {NAME_RULE}""")
def d01(spark, sf_dir):
    return G.target_experiments(experiments(spark, sf_dir), names=NAMES).select("experiment_id", "name")


@query("d01_project_experiments", CTES + """SELECT experiment_id, name FROM experiments
  WHERE lifecycle_stage <> 'deleted' AND project = 'ASIA'""")
def d01_project(spark, sf_dir):
    return G.target_experiments(experiments(spark, sf_dir), project_id="ASIA").select("experiment_id", "name")


@query("d02_wildcard_match", """SELECT c_custkey, c_name FROM customer WHERE c_name GLOB 'Customer#0000000[0-4]?'
  OR c_name GLOB 'Customer#*[!0-6]' OR c_name = 'Customer#000000012'""")
def d02(spark, sf_dir):
    customers = bind(spark, sf_dir, "SELECT c_custkey, c_name FROM {customer}")
    return G.wildcard_match(customers, "c_name", ["Customer#0000000[0-4]?", "Customer#*[!0-6]", "Customer#000000012"])


# Two shell patterns per part: thousands of them, from a table.
PATTERNS = """SELECT concat('*', lpad(cast(p_partkey * 7 AS string), 5, '0'), CASE WHEN p_partkey % 3 = 0 THEN '?' WHEN p_partkey % 3 = 1 THEN '[0-4]*' ELSE '' END) AS pattern
  FROM {part} UNION ALL SELECT concat('Customer#', CASE WHEN p_partkey % 2 = 0 THEN '0000?' ELSE '00000' END, lpad(cast(p_partkey * 3 AS string), 4, '0'))
  FROM {part}"""


@query("d02_pattern_table", f"""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM ({plain(PATTERNS).replace(' string', ' VARCHAR')}) p
  WHERE CASE WHEN contains(pattern, '*') OR contains(pattern, '?') THEN c_name GLOB pattern ELSE c_name = pattern END)""")
def d02_table(spark, sf_dir):
    customers = bind(spark, sf_dir, "SELECT c_custkey, c_name FROM {customer}")
    return match_pattern_table(customers, "c_name", bind(spark, sf_dir, PATTERNS))


_MODELS = f"""targets AS (SELECT * FROM experiments WHERE lifecycle_stage <> 'deleted' AND {NAME_RULE}),
  logged_models AS (SELECT DISTINCT v.name FROM versions v JOIN runs r USING (run_id)
    WHERE r.logged <> '' AND r.experiment_id IN (SELECT experiment_id FROM targets))"""


@query("d03_experiment_models", CTES + f", {_MODELS} SELECT name FROM logged_models")
def d03(spark, sf_dir):
    targets = G.target_experiments(experiments(spark, sf_dir), names=NAMES)
    return G.experiment_models(runs(spark, sf_dir), versions(spark, sf_dir), targets)


_REGISTERED = """registered AS (SELECT v.name, v.version, v.current_stage, v.run_id, v.seq, r.experiment_id,
    e.name AS experiment_name, r.* EXCLUDE (run_id, experiment_id) FROM versions v JOIN runs r USING (run_id)
    JOIN experiments e ON e.experiment_id = r.experiment_id
    WHERE e.lifecycle_stage <> 'deleted' AND e.name IN (SELECT name FROM targets))"""
_D_COLUMNS = ["name", "version", "current_stage", "run_id", "experiment_id", "experiment_name"]


def registered(spark, sf_dir):
    ex = experiments(spark, sf_dir)
    return G.registered_versions(versions(spark, sf_dir), runs(spark, sf_dir), ex, G.target_experiments(ex, names=NAMES))


@query("d04_registered_versions", CTES + f", {_MODELS}, {_REGISTERED} SELECT {', '.join(_D_COLUMNS)} FROM registered")
def d04(spark, sf_dir):
    return registered(spark, sf_dir).select(*_D_COLUMNS)


@query("d05_prefilter_rule", CTES + f""", {_MODELS}, {_REGISTERED} SELECT {', '.join(_D_COLUMNS)} FROM registered
  WHERE name IN (SELECT name FROM logged_models) AND name GLOB 'Customer#*[13]'""")
def d05(spark, sf_dir):
    ex = experiments(spark, sf_dir)
    return G.matching_versions(versions(spark, sf_dir), runs(spark, sf_dir), ex, G.target_experiments(ex, names=NAMES),
                               ["Customer#*[13]"]).select(*_D_COLUMNS)


@query("d06_latest_only", CTES + f""", {_MODELS}, {_REGISTERED} SELECT name, version, run_id FROM (SELECT *,
  row_number() OVER (PARTITION BY name ORDER BY TRY_CAST(version AS BIGINT) DESC) AS rn FROM registered) WHERE rn = 1""")
def d06(spark, sf_dir):
    return G.latest_only(registered(spark, sf_dir)).select("name", "version", "run_id")


@query("d07_key_inventory", CTES + " " + " UNION ALL ".join(
    [f"SELECT run_id, coalesce(experiment_id, '') AS experiment_id, 'metric' AS kind, '{m}' AS key FROM runs "
     f"WHERE {m} IS NOT NULL" for m in METRICS]
    + [f"SELECT run_id, coalesce(experiment_id, ''), '{k}', '{n}' FROM runs" for k, n in (
        ("param", "priority"), ("param", "segment"), ("tag", "mlflow.log-model.history"), ("tag", "owner"))]
    + ["SELECT r.run_id, coalesce(r.experiment_id, ''), 'artifact', a.path FROM runs r JOIN artifacts a USING (run_id) "
       "WHERE NOT a.is_dir"]))
def d07(spark, sf_dir):
    models = runs(spark, sf_dir)
    return G.key_inventory(models).unionByName(G.artifact_inventory(models, artifacts(spark, sf_dir)))


@query("d08_registry_summary", CTES + f""", {_MODELS}, {_REGISTERED} SELECT true AS registry_available,
  count(*) AS models_found, false AS project_filtering, true AS experiment_filtering, false AS model_filtering,
  false AS latest_only FROM registered""")
def d08(spark, sf_dir):
    return G.registry_summary(registered(spark, sf_dir), project_filter=False, experiment_filter=True,
                              model_filter=False, latest=False)


@query("d09_experiment_metadata", CTES + """SELECT name, lifecycle_stage = 'deleted' AS skipped,
  CASE WHEN lifecycle_stage = 'deleted' THEN concat('Experiment ''', name, ''' is deleted') END AS skip_reason,
  CASE WHEN lifecycle_stage <> 'deleted' THEN experiment_id END AS experiment_id,
  CASE WHEN lifecycle_stage <> 'deleted' THEN artifact_location END AS artifact_location,
  CASE WHEN lifecycle_stage <> 'deleted' THEN lifecycle_stage END AS lifecycle_stage,
  CASE WHEN lifecycle_stage <> 'deleted' THEN experiment_id IN (SELECT experiment_id FROM runs
    WHERE experiment_id IS NOT NULL) END AS has_runs FROM experiments""")
def d09(spark, sf_dir):
    return G.experiment_metadata(experiments(spark, sf_dir), runs(spark, sf_dir))


PROJECT_MODELS = """SELECT o_custkey AS project, o_orderkey AS seq, concat('run', cast(o_orderkey AS string)) AS run_id,
  o_orderpriority AS name FROM {orders}"""
REQUESTS = """SELECT o_orderkey AS request_id, o_custkey + o_orderkey % 2 AS project,
  CASE o_orderkey % 3 WHEN 0 THEN concat('run', cast(o_orderkey AS string)) WHEN 1 THEN 'run-none' END AS model_run_id,
  CASE WHEN o_orderkey % 4 < 2 THEN '1-URGENT' END AS model_name FROM {orders}"""


@query("d10_resolve_model", f"""WITH models AS ({plain(PROJECT_MODELS)}), requests AS ({plain(REQUESTS)}),
  named AS (SELECT project, name, min_by(run_id, seq) AS run_id FROM models GROUP BY project, name),
  only_one AS (SELECT project, min(run_id) AS run_id FROM models GROUP BY project HAVING count(*) = 1)
  SELECT q.request_id, coalesce(m.run_id, n.run_id, o.run_id) AS run_id FROM requests q
  LEFT JOIN models m ON m.project = q.project AND m.run_id = q.model_run_id
  LEFT JOIN named n ON n.project = q.project AND n.name = q.model_name
  LEFT JOIN only_one o ON o.project = q.project""")
def d10(spark, sf_dir):
    return G.resolve_model(bind(spark, sf_dir, REQUESTS), bind(spark, sf_dir, PROJECT_MODELS)).select("request_id", "run_id")


@query("d11_test_metrics", CTES + ", m AS (" + " UNION ALL ".join(
    f"SELECT run_id, '{m}' AS key, printf('%.4f', {m}) AS shown, max_price IS NULL AND accuracy IS NULL AS only_train "
    f"FROM runs WHERE {m} IS NOT NULL" for m in METRICS)
    + ") SELECT run_id, key, shown FROM m WHERE only_train OR NOT starts_with(key, 'train_')")
def d11(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", F.explode(G.test_metrics(F.col("metrics"))).alias("key", "shown"))


@query("d12_compare_models", CTES + "SELECT v.name, run_id, accuracy, max_price FROM versions v JOIN runs USING (run_id)")
def d12(spark, sf_dir):
    return G.compare_models(versions(spark, sf_dir).join(runs(spark, sf_dir), "run_id"), ["accuracy", "max_price"])


@query("d12_compare_models_long", CTES + """SELECT v.name, run_id, metric, value FROM versions v JOIN (
  SELECT run_id, 'accuracy' AS metric, accuracy::DOUBLE AS value FROM runs WHERE accuracy IS NOT NULL
  UNION ALL SELECT run_id, 'max_price', max_price::DOUBLE FROM runs WHERE max_price IS NOT NULL) USING (run_id)""")
def d12_long(spark, sf_dir):
    return G.compare_models(versions(spark, sf_dir).join(runs(spark, sf_dir), "run_id"))


RECORDS = """SELECT concat('s', cast(l_suppkey AS string)) AS run_id,
  CASE l_returnflag WHEN 'A' THEN 'out/Feature_weights.csv' WHEN 'N' THEN 'out/importance.csv' ELSE 'out/scores.csv' END
    AS path, l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity AS importance FROM {lineitem}"""


@query("d13_top_importance", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, path
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rank FROM ({plain(RECORDS)}))
  SELECT run_id, path, rank, l_partkey AS feature, importance FROM r
  WHERE rank <= CASE WHEN path = 'out/scores.csv' THEN 10 ELSE 15 END""")
def d13(spark, sf_dir):
    out = G.top_importance(bind(spark, sf_dir, RECORDS), ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return out.select("run_id", "path", "rank", F.col("l_partkey").alias("feature"), "importance")


@query("d14_metric_preview", CTES + """, files AS (SELECT run_id, string_agg(path, ', ' ORDER BY seq, path) AS artifacts
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq, path) AS rn FROM artifacts WHERE NOT is_dir)
    WHERE rn <= 10 GROUP BY run_id)
  SELECT r.run_id, concat_ws(', ', 'accuracy: ' || printf('%.4f', accuracy), 'max_price: ' || printf('%.4f', max_price),
    'train_qty: ' || printf('%.4f', train_qty), 'train_tax: ' || printf('%.4f', train_tax)) AS metric_values,
  concat_ws(', ', CASE WHEN accuracy IS NOT NULL THEN 'accuracy' END, CASE WHEN max_price IS NOT NULL THEN 'max_price' END,
    CASE WHEN train_qty IS NOT NULL THEN 'train_qty' END, CASE WHEN train_tax IS NOT NULL THEN 'train_tax' END)
    AS metric_keys, 'priority, segment' AS param_keys, 'mlflow.log-model.history, owner' AS tag_keys, artifacts
  FROM runs r LEFT JOIN files USING (run_id)""")
def d14(spark, sf_dir):
    return G.metric_preview(runs(spark, sf_dir)).join(G.artifact_preview(artifacts(spark, sf_dir)), "run_id", "left")


IMAGES = """SELECT CASE WHEN l_returnflag = 'A' THEN concat('s', cast(l_suppkey AS string))
    ELSE concat('p', cast(l_suppkey % 100 AS string)) END AS scope, l_orderkey AS seq,
  concat('plots/', CASE l_linenumber WHEN 1 THEN 'roc_curve_' WHEN 2 THEN 'Feature_importance_' WHEN 3 THEN
    'confusion_matrix_' WHEN 4 THEN 'Residual_Error_' WHEN 5 THEN 'histogram_' ELSE 'other_' END,
    cast(l_partkey AS string), '.png') AS path FROM {lineitem}"""
IMAGE_BLOCKS = """SELECT p_partkey AS block_id, CASE WHEN p_partkey % 2 = 0 THEN concat('s', cast(p_partkey % 130 AS string))
    ELSE concat('p', cast(p_partkey % 100 AS string)) END AS scope,
  concat(p_name, CASE p_size % 7 WHEN 0 THEN ' ROC Performance' WHEN 1 THEN ' feature overview' WHEN 2 THEN ' Residuals'
    WHEN 3 THEN ' value distribution' WHEN 4 THEN ' learning progress' WHEN 5 THEN ' confusion' ELSE ' plain' END) AS purpose,
  CASE WHEN p_size % 5 = 0 THEN concat('OTHER_', cast(p_partkey AS string)) WHEN p_size % 5 = 1 THEN
    concat('_', cast(p_partkey % 100 AS string), '.') END AS image_name FROM {part}"""


def _purpose_sql():
    from attesta import rules
    return " OR ".join(f"(contains(lower(purpose), '{w}') AND (" + " OR ".join(
        f"contains(lower(path), '{p}')" for p in ps) + "))" for w, ps in rules.IMAGE_PURPOSES.items())


@query("d15_match_image", f"""WITH b AS ({plain(IMAGE_BLOCKS)}), i AS ({plain(IMAGES)}), c AS (SELECT block_id, seq, path,
    coalesce(contains(lower(path), lower(image_name)), false) OR {_purpose_sql()} AS hit FROM b LEFT JOIN i USING (scope)),
  r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY hit DESC, seq, path) AS rn FROM c)
  SELECT block_id, path, coalesce(hit, false) AS matched FROM r WHERE rn = 1""")
def d15(spark, sf_dir):
    return G.match_image(bind(spark, sf_dir, IMAGE_BLOCKS), bind(spark, sf_dir, IMAGES), partitions(spark)).select("block_id", "path", "matched")


@query("d16_image_title", CTES + r"""SELECT run_id, path, CASE WHEN seq = 2 THEN 'Given title' ELSE array_to_string(
  list_transform(regexp_extract_all(translate(regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', ''), '_-', '  '),
    '\p{L}+|[^\p{L}]+'), lambda r: concat(upper(r[1]), lower(r[2:]))), '') END AS title FROM artifacts""")
def d16(spark, sf_dir):
    given = F.when(F.col("seq") == 2, F.lit("Given title")).otherwise(F.lit(""))
    return artifacts(spark, sf_dir).select("run_id", "path", G.image_title(F.col("path"), given).alias("title"))


@query("d17_split_artifact_kinds", CTES + """SELECT run_id, count(*) FILTER (path LIKE '%.png') AS images,
  count(*) FILTER (path NOT LIKE '%.png') AS data_files FROM artifacts GROUP BY run_id""")
def d17(spark, sf_dir):
    split = G.split_artifact_kinds(artifacts(spark, sf_dir))
    return split.groupBy("run_id").agg(F.count_if(F.col("artifact_kind") == "image").alias("images"),
                                       F.count_if(F.col("artifact_kind") == "data").alias("data_files"))


_ALIASES = """aliases AS (SELECT name, lower(current_stage) AS alias, max_by(version, row(written, seq)) AS version
  FROM versions WHERE current_stage <> 'None' GROUP BY ALL)"""


@query("d18_assign_alias", CTES + f", {_ALIASES} SELECT name, alias, version FROM aliases")
def d18(spark, sf_dir):
    return G.assign_aliases(versions(spark, sf_dir), ["written", "seq"])


@query("d19_stage_lookup", CTES + f""", {_ALIASES} SELECT c_name AS name, 'Production' AS stage, version
  FROM customer LEFT JOIN aliases ON aliases.name = c_name AND alias = 'production'""")
def d19(spark, sf_dir):
    asked = bind(spark, sf_dir, "SELECT c_name AS name, 'Production' AS stage FROM {customer}")
    return G.stage_lookup(asked, G.assign_aliases(versions(spark, sf_dir), ["written", "seq"]))
