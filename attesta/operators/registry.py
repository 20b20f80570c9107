"""Model-registry analytics over tracking tables.

experiments(experiment_id, name, lifecycle_stage, artifact_location, tags map)
runs(run_id, experiment_id, run_name, metrics map, params map, tags map)
versions(name, version, current_stage, run_id), artifacts(run_id, path, is_dir, seq)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta import rules
from attesta.functions.numbers import fixed
from attesta.functions.text import basename, contains_any, matches_patterns
from attesta.operators.grams import GRAM, explode_grams
from attesta.session import materialise

LOG_MODEL_TAG = "mlflow.log-model"
PROJECT_TAG = "project_id"


def target_experiments(experiments: DataFrame, project_id: str | None = None, names: Sequence[str] = (),
                       project_tag: str = PROJECT_TAG) -> DataFrame:
    """Live experiments of a project whose names match any pattern."""
    keep = F.coalesce(F.col("lifecycle_stage") != "deleted", F.lit(True))
    if project_id is not None:
        keep = keep & (F.try_element_at("tags", F.lit(project_tag)) == project_id)
    if names:
        keep = keep & matches_patterns(F.col("name"), names)
    return experiments.filter(keep)


def wildcard_match(df: DataFrame, column: str, patterns: Sequence[str]) -> DataFrame:
    return df.filter(matches_patterns(F.col(column), patterns))


def experiment_models(runs: DataFrame, versions: DataFrame, targets: DataFrame) -> DataFrame:
    """Names of models with a version whose run, in a target experiment, carries a non-empty log-model tag."""
    logged = F.exists(F.map_entries("tags"), lambda e: F.contains(e["key"], F.lit(LOG_MODEL_TAG))
                      & (F.coalesce(e["value"], F.lit("")) != ""))
    live_runs = (runs.filter(logged).select("run_id", "experiment_id")
                 .join(targets.select("experiment_id"), "experiment_id", "left_semi"))
    return versions.join(live_runs.select("run_id"), "run_id", "left_semi").select("name").distinct()


def registered_versions(versions: DataFrame, runs: DataFrame, experiments: DataFrame, targets: DataFrame) -> DataFrame:
    """Version, its run and its experiment; deleted and non-target experiments dropped."""
    live = (experiments.filter(F.col("lifecycle_stage") != "deleted")
            .join(targets.select("name"), "name", "left_semi")
            .select("experiment_id", F.col("name").alias("experiment_name")))
    return versions.join(runs, "run_id").join(live, "experiment_id")


def matching_versions(versions: DataFrame, runs: DataFrame, experiments: DataFrame, targets: DataFrame,
                      model_names: Sequence[str] = ()) -> DataFrame:
    """Versions of the models to document. With model patterns, only models logged in a target experiment count."""
    if model_names:
        names = wildcard_match(experiment_models(runs, versions, targets), "name", model_names)
        versions = versions.join(names, "name", "left_semi")
    return registered_versions(versions, runs, experiments, targets)


def latest_only(models: DataFrame) -> DataFrame:
    """Per model the row with the highest integer version; versions that are no integers come last."""
    order = Window.partitionBy("name").orderBy(F.col("version").try_cast("bigint").desc_nulls_last(), "version", "run_id")
    return models.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 1).drop("_rn")


def key_inventory(models: DataFrame) -> DataFrame:
    """Long table (run_id, experiment_id, kind, key) of metric, param and tag keys, in one pass."""
    def keys(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.map_keys(column), F.array().cast("array<string>")),
                           lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    cells = F.concat(keys("metrics", "metric"), keys("params", "param"), keys("tags", "tag"))
    return (models.select("run_id", F.coalesce("experiment_id", F.lit("")).alias("experiment_id"),
                          F.explode(cells).alias("c"))
            .select("run_id", "experiment_id", "c.kind", "c.key"))


def artifact_inventory(models: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifact rows of the inventory: one row per file of each model's run."""
    files = artifacts.filter(~F.col("is_dir")).select("run_id", "path")
    return (models.select("run_id", F.coalesce("experiment_id", F.lit("")).alias("experiment_id"))
            .join(files, "run_id").select("run_id", "experiment_id", F.lit("artifact").alias("kind"),
                                          F.col("path").alias("key")))


def registry_summary(models: DataFrame, *, project_filter: bool, experiment_filter: bool, model_filter: bool,
                     latest: bool) -> DataFrame:
    return models.agg(F.count(F.lit(1)).alias("models_found")).select(
        F.lit(True).alias("registry_available"), "models_found", F.lit(project_filter).alias("project_filtering"),
        F.lit(experiment_filter).alias("experiment_filtering"), F.lit(model_filter).alias("model_filtering"),
        F.lit(latest).alias("latest_only"))


def experiment_metadata(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Per experiment: identity and whether it has runs; deleted ones only say why they are skipped."""
    with_runs = runs.select("experiment_id").distinct().withColumn("_has", F.lit(True))
    gone = F.col("lifecycle_stage") == "deleted"

    def unless_gone(col: Column) -> Column:
        return F.when(~gone, col)

    reason = F.concat(F.lit("Experiment '"), F.col("name"), F.lit("' is deleted"))
    return experiments.join(with_runs, "experiment_id", "left").select(
        F.col("name"), gone.alias("skipped"), F.when(gone, reason).alias("skip_reason"),
        unless_gone(F.col("experiment_id")).alias("experiment_id"),
        unless_gone(F.col("artifact_location")).alias("artifact_location"),
        unless_gone(F.col("lifecycle_stage")).alias("lifecycle_stage"),
        unless_gone(F.coalesce("_has", F.lit(False))).alias("has_runs"))


def resolve_model(requests: DataFrame, models: DataFrame) -> DataFrame:
    """requests(project, model_run_id, model_name) + ``run_id`` of: the run asked for, else the first model of that
    name, else the project's only model, else null. models(project, seq, run_id, name)."""
    by_run = models.groupBy("project", F.col("run_id").alias("model_run_id")).agg(F.first("run_id").alias("_r1"))
    by_name = models.groupBy("project", F.col("name").alias("model_name")).agg(F.min_by("run_id", "seq").alias("_r2"))
    only = (models.groupBy("project").agg(F.count(F.lit(1)).alias("_n"), F.min("run_id").alias("_r3"))
            .filter(F.col("_n") == 1).drop("_n"))
    joined = (requests.join(by_run, ["project", "model_run_id"], "left")
              .join(by_name, ["project", "model_name"], "left").join(only, "project", "left"))
    return joined.withColumn("run_id", F.coalesce("_r1", "_r2", "_r3")).drop("_r1", "_r2", "_r3")


def test_metrics(metrics: Column) -> Column:
    """Metrics that are not training metrics, or all when nothing else is there; values as 4-decimal text."""
    kept = F.map_filter(metrics, lambda k, _: ~F.startswith(k, F.lit("train_")))
    chosen = F.when(F.size(kept) > 0, kept).otherwise(metrics)
    return F.transform_values(chosen, lambda _, v: fixed(v, 4))


def compare_models(models: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Test metrics side by side, without a shuffle: one row per model run and metric (name, run_id, metric, value), or,
    for the ``names`` asked for, one row per model run with a column each."""
    if names is None:
        long = models.select("name", "run_id", F.explode("metrics").alias("metric", "value"))
        return long.filter(~F.startswith("metric", F.lit("train_")))
    return models.select("name", "run_id", *[F.try_element_at("metrics", F.lit(n)).alias(n) for n in names])


def top_importance(records: DataFrame, order: Sequence[str], top: int = 15, other: int = 10) -> DataFrame:
    """First records of each CSV artifact: ``top`` for feature importance, ``other`` for the rest."""
    window = Window.partitionBy("run_id", "path").orderBy(*order)
    is_importance = contains_any(F.lower("path"), ["feature", "importance"])
    ranked = records.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= max(top, other))
    return ranked.filter(F.col("rank") <= F.when(is_importance, top).otherwise(other))


def metric_preview(models: DataFrame, n_values: int = 5, n_keys: int = 10) -> DataFrame:
    """Short texts per model, keys in name order: the first values and the first metric, param and tag keys."""
    def first_keys(column: str) -> Column:
        return F.array_join(F.slice(F.array_sort(F.map_keys(column)), 1, n_keys), ", ")

    values = F.transform(F.slice(F.array_sort(F.map_keys("metrics")), 1, n_values),
                         lambda k: F.concat(k, F.lit(": "), fixed(F.element_at("metrics", k), 4)))
    return models.select("run_id", F.array_join(values, ", ").alias("metric_values"),
                         first_keys("metrics").alias("metric_keys"), first_keys("params").alias("param_keys"),
                         first_keys("tags").alias("tag_keys"))


def artifact_preview(artifacts: DataFrame, n: int = 10) -> DataFrame:
    """Per run its first artifact paths as one text."""
    window = Window.partitionBy("run_id").orderBy("seq", "path")
    first = (artifacts.filter(~F.col("is_dir")).withColumn("_rn", F.row_number().over(window))
             .filter(F.col("_rn") <= n))
    ordered = F.array_sort(F.collect_list(F.struct("_rn", "path")))
    return first.groupBy("run_id").agg(F.array_join(F.transform(ordered, lambda s: s["path"]), ", ").alias("artifacts"))


def _purpose_patterns() -> list[str]:
    return sorted({p for patterns in rules.IMAGE_PURPOSES.values() for p in patterns})


def _path_grams(names: DataFrame, images: DataFrame) -> DataFrame:
    """The grams of every path, of the sizes that names are looked up by."""
    in_use = names.agg(F.collect_set(F.least(F.length("_name"), F.lit(GRAM))).alias("sizes")).scalar()  # 1 to GRAM
    return explode_grams(images.select("scope", "seq", "path", F.lower("path").alias("_low"), in_use.alias("_sizes")), "_low", F.col("_sizes"))


def rarest_grams(names: DataFrame, images: DataFrame) -> DataFrame:
    """names(scope, _name) -> (scope, _name, gram, n): of the grams of each name that which fewest places of its scope's paths
    hold; names with a gram that no path holds are left out. images(scope, seq, path).

    Names of GRAM letters or more have grams of that size, shorter ones are their own gram; paths are cut into the sizes in use
    only. What is counted are a scope's different grams, few next to its paths.
    """
    size = F.least(F.length("_name"), F.lit(GRAM))
    of_names = explode_grams(names, "_name", F.array(size)).select("scope", "_name", "gram").distinct()
    counts = _path_grams(names, images).groupBy("scope", "gram").agg(F.count("seq").alias("n"))  # most are added up before any exchange
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")
    return (of_names.join(counts, ["scope", "gram"], "left").groupBy("scope", "_name").agg(best)
            .filter("best.n > 0").select("scope", "_name", "best.gram", "best.n"))


def _first_named(names: DataFrame, images: DataFrame) -> DataFrame:
    """(scope, _name, _named): the first image of the scope whose path holds the name. Each path is looked up by its grams
    among the rarest grams of the names, and then compared. Scopes with names, and the grams chosen, are small tables of their own:
    paths and grams that are not among them go before anything is exchanged, if Spark broadcasts these by their bytes."""
    scopes = materialise(names.select("scope").distinct(), "image-scopes")
    images = images.join(scopes, "scope", "left_semi")
    chosen = materialise(rarest_grams(names, images), "image-names")
    looked_up = materialise(chosen.select("scope", "gram").distinct(), "image-grams")
    found = (_path_grams(names, images).join(looked_up, ["scope", "gram"], "left_semi")
             .join(chosen.select("scope", "_name", "gram"), ["scope", "gram"]).filter(F.contains("_low", F.col("_name"))))
    return found.groupBy("scope", "_name").agg(F.min(F.struct("seq", "path")).alias("_named"))


def match_image(blocks: DataFrame, images: DataFrame, partitions: int | None = None) -> DataFrame:
    """blocks(scope, purpose, image_name) + ``path`` of the scope's first image that fits, else its first image.

    images(scope, seq, path); a scope is one model, or a project for blocks without a model. Blocks never meet single
    images: every scope is folded to its first image per path word, and requested names meet the paths that hold the
    rarest of their grams of three letters. An image has a ``seq``. ``partitions`` deals the paths over so many tasks before they are
    cut into grams, for tables that come in fewer files than there are cores.
    """
    patterns = _purpose_patterns()
    images = images.select("scope", "seq", "path")
    dealt = images.repartition(partitions) if partitions else images
    images = images.withColumn("_low", F.lower("path"))
    entry = F.struct("seq", "path")
    # Pattern 0 fits every image. First the lowest seq per scope and pattern (hash aggregation over numbers), then the
    # paths at those few places.
    fits = [F.lit(True), *[F.contains("_low", F.lit(p)) for p in patterns]]
    lowest = images.groupBy("scope").agg(*[F.min(F.when(f, F.col("seq"))).alias(f"_s{i}") for i, f in enumerate(fits)])
    places = lowest.select("scope", F.posexplode(F.array(*[F.col(f"_s{i}") for i in range(len(fits))])).alias("_p", "seq"))
    at_place = (images.join(places.filter(F.col("seq").isNotNull()), ["scope", "seq"])
                .filter(F.array(*fits)[F.col("_p")]).groupBy("scope", "_p").agg(F.min(entry).alias("e")))
    firsts = at_place.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("_p", "e"))).alias("_firsts"))

    names = (blocks.filter(F.coalesce("image_name", F.lit("")) != "")
             .select("scope", F.lower("image_name").alias("_name")).distinct())
    named = _first_named(names, dealt)

    purpose = F.lower("purpose")
    hits = [F.col("_named")]
    for i, p in enumerate(patterns):
        words = [w for w, path_words in rules.IMAGE_PURPOSES.items() if p in path_words]
        hits.append(F.when(contains_any(purpose, words), F.try_element_at("_firsts", F.lit(i + 1))))
    matched = F.array_min(F.array_compact(F.array(*hits)))
    joined = (blocks.withColumn("_name", F.lower("image_name")).join(named, ["scope", "_name"], "left")
              .join(firsts, "scope", "left"))
    return joined.select(*blocks.columns, F.coalesce(matched, F.try_element_at("_firsts", F.lit(0)))["path"].alias("path"),
                         matched.isNotNull().alias("matched"))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters; digits and apostrophes end a run."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                            F.lower(F.substring(r, 2, 1 << 30)))), "")


def image_title(path: Column, title: Column) -> Column:
    """The given title, else the file's stem with separators as spaces, in title case."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(title, F.lit("")), title_case(F.translate(stem, "_-", "  ")))


def split_artifact_kinds(artifacts: DataFrame) -> DataFrame:
    """Label each parsed artifact as image or data; the long form keeps a run of any size out of one row."""
    image = F.lower("path").rlike(r"\.(png|jpg|jpeg)$")
    return artifacts.withColumn("artifact_kind", F.when(image, "image").otherwise("data"))


def assign_aliases(versions: DataFrame, written_at: Sequence[str]) -> DataFrame:
    """(name, alias, version): the version last written to each alias; stage "None" sets no alias."""
    staged = versions.filter(F.coalesce("current_stage", F.lit("")).isin("", "None") == F.lit(False))
    return (staged.groupBy("name", F.lower("current_stage").alias("alias"))
            .agg(F.max_by("version", F.struct(*written_at)).alias("version")))


def stage_lookup(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """requests(name, stage) with the version their stage points to."""
    keyed = requests.withColumn("alias", F.lower("stage"))
    return keyed.join(aliases, ["name", "alias"], "left").drop("alias")
