"""Versioned feature sets (churn, price, fraud), encoders, scalers, splits and weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta import rules
from attesta.functions.numbers import round_scaled
from attesta.operators.neighbours import nearest_neighbours
from attesta.operators.scans import exact_median, ranked
from attesta.session import materialise


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def bins(value: Column, edges: Sequence[float], include_lowest: bool = False, missing: int | None = None) -> Column:
    """Number of the right-closed bin of ``value``; the left edge is open unless ``include_lowest``."""
    out = F.lit(missing).cast("int")
    for i in reversed(range(len(edges) - 1)):
        low = value >= edges[i] if include_lowest and i == 0 else value > edges[i]
        inside = low if edges[i + 1] == float("inf") else low & (value <= edges[i + 1])
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def _lookup(value: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for key, score in table.items():
        out = F.when(value == key, F.lit(score)).otherwise(out)
    return out


def churn_v2(df: DataFrame, median: Column | None = None) -> DataFrame:
    """Tenure bins, charge per month, service count, high-value flag. Without ``median`` the frame's own is used."""
    if median is None:
        median = exact_median(df.select("monthly_charges"), "monthly_charges").scalar()
    services = ["online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
                "streaming_movies"]
    count = sum((F.coalesce(F.col(s), F.lit(0)) for s in services[1:]), F.coalesce(F.col(services[0]), F.lit(0)))
    return df.withColumns({
        "tenure_category": bins(F.col("tenure_months"), [0, 12, 24, 48, 72, float("inf")], True, -1),
        "charge_per_month_tenure": F.try_divide(F.col("total_charges").cast("double"), F.col("tenure_months") + 1),
        "service_count": count,
        "high_value_customer": flag(F.col("monthly_charges") > median)})


def churn_v3(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "contract_stability": _lookup(F.col("contract_type"), rules.CONTRACT_STABILITY),
        "payment_risk": _lookup(F.col("payment_method"), rules.PAYMENT_RISK),
        "engagement_score": F.col("service_count") + F.col("tenure_months") / 12 + F.col("partner") + F.col("dependents"),
        "monthly_charge_category": bins(F.col("monthly_charges"), [0, 35, 70, 150, float("inf")], True, -1),
        "has_internet": F.coalesce(F.col("internet_service") != "No", F.lit(True)).cast("int"),
        "has_streaming": flag((F.col("streaming_tv") == 1) | (F.col("streaming_movies") == 1)),
        "has_security_services": flag((F.col("online_security") == 1) | (F.col("device_protection") == 1))})


def price_v2(df: DataFrame) -> DataFrame:
    """Ages outside (0, 200] have no category: null."""
    return df.withColumns({
        "price_per_sqft_est": F.col("square_feet") / 100,
        "bed_bath_ratio": F.try_divide(F.col("bedrooms").cast("double"), F.col("bathrooms") + 0.1),
        "total_rooms": F.col("bedrooms") + F.col("bathrooms"),
        "age_category": bins(F.col("age"), [0, 10, 30, 60, 200]),
        "quality_condition_score": F.col("quality") * F.col("condition")})


def price_v3(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "sqft_quality_interaction": F.col("square_feet") * F.col("quality") / 1000,
        "lot_to_sqft_ratio": F.try_divide(F.col("lot_size").cast("double"), F.col("square_feet") + 1),
        "amenity_score": F.col("has_pool") + F.col("has_fireplace") + F.col("has_basement") + F.col("has_garage"),
        "effective_age": F.col("age") - F.col("is_renovated") * F.col("years_since_renovation"),
        "school_distance_score": F.try_divide(F.col("school_rating").cast("double"), F.col("distance_to_center") + 1)})


def price_v4(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "luxury_score": flag(F.col("quality") >= 4) * flag(F.col("square_feet") > 3000),
        "size_category": bins(F.col("square_feet"), [0, 1500, 2500, 4000, 10000]),
        "premium_location": flag(F.col("neighborhood").isin("Waterfront", "Downtown"))})


def fraud_v2(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "is_late_night": flag((F.col("hour_of_day") >= 23) | (F.col("hour_of_day") <= 5)),
        "is_weekend": flag(F.col("day_of_week") >= 5),
        "is_high_amount": flag(F.col("amount") > 1000),
        "amount_deviation": F.abs(F.col("amount") - F.col("avg_transaction_amount")),
        "high_velocity": flag(F.col("transactions_last_24h") > 5),
        "location_risk": flag(F.col("distance_from_home") > 100).bitwiseOR(F.col("is_foreign").cast("int")),
        "new_card": flag(F.col("card_age_days") < 30),
        "has_fraud_history": flag(F.col("previous_fraud_count") > 0)})


def fraud_v3(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "online_no_card_present": flag((F.col("is_online") == 1) & (F.col("card_present") == 0)),
        "foreign_high_amount": flag((F.col("is_foreign") == 1) & (F.col("amount") > 500))})
    parts = ["is_high_amount", "location_risk", "high_velocity", "new_card", "has_fraud_history", "is_late_night",
             "online_no_card_present"]
    gap = F.col("time_since_last_txn")
    return df.withColumns({
        "composite_risk_score": sum((F.col(p) for p in parts[1:]), F.col(parts[0])),
        "trust_score": F.col("merchant_trust") + F.col("pin_used") * 2 + F.col("card_present") * 2,
        "unusual_time_pattern": flag((gap < 0.5) | (gap > 168)),
        "account_maturity": F.log1p("account_age_months")})


FEATURE_SETS: dict[str, dict[str, list[Callable[[DataFrame], DataFrame]]]] = {
    "churn": {"v1": [], "v2": [churn_v2], "v3": [churn_v2, churn_v3]},
    "price": {"v1": [], "v2": [price_v2], "v3": [price_v2, price_v3], "v4": [price_v2, price_v3, price_v4]},
    "fraud": {"v1": [], "v2": [fraud_v2], "v3": [fraud_v2, fraud_v3]},
}


def add_features(df: DataFrame, family: str, version: str) -> DataFrame:
    """The cumulative feature set of a version; an unknown version adds nothing."""
    for step in FEATURE_SETS[family].get(version, []):
        df = df.transform(step)
    return df


def raw_ratio_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "amount_to_avg_ratio": round_scaled(F.col("amount") / (F.col("avg_transaction_amount") + 1), 3),
        "daily_transaction_velocity": F.col("transactions_last_24h") / 1,
        "weekly_transaction_velocity": round_scaled(F.col("transactions_last_week") / 7, 3)})


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(value, index): indexes follow the sorted order of the distinct values, however many there are."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    # Values are range-partitioned and written once, so that the partition numbers stay what they are.
    cut = materialise(values.repartitionByRange("value").withColumn("_part", F.spark_partition_id()), "labels")
    return ranked(cut, [], ["value"], "index", bucket=F.col("_part")).select("value", (F.col("index") - 1).alias("index"))


def label_encode(df: DataFrame, column: str, labels: DataFrame, out: str | None = None) -> DataFrame:
    """Replace a category by its index; a value the labels do not know is an error."""
    keyed = labels.select(F.col("value").alias("_value"), F.col("index").alias("_index"))
    unseen = F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.coalesce(column, F.lit("null"))))
    joined = df.join(keyed, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(out or column, F.when(F.col("_index").isNull(), unseen.cast("bigint"))
                             .otherwise(F.col("_index"))).drop("_value", "_index")


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a struct (mean, std) per column; population deviation, 1 where it is zero."""
    return df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("std")).alias(c)
        for c in columns]).alias("stats"))


def standard_scale(df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std per column, from ``stats`` or the frame itself."""
    fitted = (stats if stats is not None else scaler_stats(df, columns)).scalar()
    out = df.withColumn("_stats", fitted)
    return out.withColumns({c: (F.col(c) - F.col("_stats")[c]["mean"]) / F.col("_stats")[c]["std"]
                            for c in columns}).drop("_stats")


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 1, enabled: bool = False) -> DataFrame:
    """Polynomial terms as a vector column. Off by default: a degree alone changes nothing."""
    if not enabled or degree <= 1:
        return df
    from pyspark.ml.feature import PolynomialExpansion, VectorAssembler

    vector = VectorAssembler(inputCols=list(columns), outputCol="_base").transform(df)
    return PolynomialExpansion(degree=degree, inputCol="_base", outputCol="polynomial").transform(vector).drop("_base")


def target_log(col: Column, enabled: bool = True) -> Column:
    return F.log1p(col) if enabled else col


def target_unlog(col: Column, enabled: bool = True) -> Column:
    return F.expm1(col) if enabled else col


def split_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_range(hashed: Column, spark: SparkSession) -> Column:
    """One of 4096 equal ranges or more, in the order of the hash text; their number keeps pace with the session's
    shuffle partitions."""
    digits = max(3, len(f"{int(spark.conf.get('spark.sql.shuffle.partitions')) - 1:x}"))
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def split_stratified(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly round(share x count) rows of every label, chosen by a seeded hash of a unique key."""
    hashed = df.withColumn("_hash", split_hash(F.col(key), seed))
    bucket = hash_range(F.col("_hash"), df.sparkSession)
    numbered = ranked(hashed, [label], ["_hash", key], "_rank", bucket=bucket)
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.round(F.count(F.lit(1)) * share).alias("_size"))
    return (numbered.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
            .withColumn("is_test", F.col("_rank") <= F.col("_size")).drop("_hash", "_rank", "_label", "_size"))


def split_random(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test`` from the seeded hash alone: no shuffle, sizes within sampling error."""
    threshold = f"{min(int(share * 2 ** 32), 2 ** 32 - 1):08x}"
    return df.withColumn("is_test", F.substring(split_hash(F.col(key), seed), 1, 8) < threshold)


def features_and_target(df: DataFrame, target: str, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return df.drop(target, *ids), df.select(target)


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = n / (k x rows of the label)."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg((F.sum("_n") / F.count(F.lit(1))).alias("t")).scalar()
    weights = counts.select("_label", (totals / F.col("_n")).alias("weight"))
    return df.join(weights, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def scale_pos_weight(df: DataFrame, label: str, focal: bool = False) -> DataFrame:
    """One row: negatives per positive, doubled for the focal variant."""
    ratio = F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double"))
    return df.agg((ratio * (2 if focal else 1)).alias("scale_pos_weight"))


def smote_oversample(df: DataFrame, key: str, label: str, features: Sequence[str], ratio: float = 0.5,
                     neighbours: int = 5, seed: int = 42) -> DataFrame:
    """Add synthetic minority rows (label 1) until minority / majority = ``ratio``; original rows all stay.

    A synthetic row lies between a minority row and one of its exact nearest neighbours (:func:`nearest_neighbours`); the
    copies wanted are dealt evenly, by seeded hash of the key. Minority rows with a null or non-finite feature count, but no
    row is made from them. Adds ``synthetic``. Nothing runs while the query is built.
    """
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("m"), F.count_if(F.col(label) == 0).alias("n"))
    wanted = F.greatest(F.floor(F.lit(ratio) * F.col("n")) - F.col("m"), F.lit(0))
    near = nearest_neighbours(df.filter(F.col(label) == 1), key, features, neighbours).filter(F.size("_near") > 0)
    near = near.persist()  # on first use: counted, ranked and copied below
    bases = near.agg(F.count(F.lit(1)).alias("bases")).scalar()
    hashed = near.withColumn("_hash", split_hash(F.col("_key"), seed))
    numbered = ranked(hashed, [], ["_hash", "_key"], "_rank", bucket=hash_range(F.col("_hash"), df.sparkSession))
    numbered = numbered.withColumns({"_wanted": sizes.select(wanted.alias("w")).scalar(), "_bases": bases})
    each, extra = F.floor(F.col("_wanted") / F.col("_bases")).cast("int"), F.col("_wanted") % F.col("_bases")
    copies = numbered.withColumn("_copies", each + (F.col("_rank") <= extra).cast("int")).filter("_copies > 0")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    dice = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string"), F.lit(":"), F.col("_copy").cast("string")))
    pick, part = (F.conv(F.substring(dice, at, 12), 16, 10).cast("bigint") for at in (1, 13))
    chosen = F.col("_near")[(pick % F.size("_near")).cast("int")]["key"]
    points = df.filter(F.col(label) == 1).select(F.col(key).alias("_other"), F.array(*[F.col(f).cast("double") for f in features]).alias("_o"))
    made = copies.withColumns({"_other": chosen, "_f": part % 1_000_003 / 1_000_003}).join(points, "_other").select(*[
        (F.col(f"_x{i}") + F.col("_f") * (F.col("_o")[i] - F.col(f"_x{i}"))).alias(f) for i, f in enumerate(features)],
        F.lit(1).alias(label), F.lit(True).alias("synthetic"))
    return df.withColumn("synthetic", F.lit(False)).unionByName(made, allowMissingColumns=True)
