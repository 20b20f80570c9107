"""Family G, features: orders as churn accounts, parts as properties, events as card transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import features as X
from attesta.operators.neighbours import nearest_neighbours
from attesta.plans.catalog import bind, plain, query
from attesta.plans.metrics import nice

CHURN = """SELECT concat('C', cast(o_orderkey AS string)) AS customer_id,
  CASE WHEN o_orderkey % 37 = 0 THEN cast(NULL AS int) ELSE cast(o_custkey % 90 AS int) END AS tenure_months,
  cast(o_orderkey % 2 AS int) AS partner, cast(o_custkey % 2 AS int) AS dependents,
  cast(o_orderkey % 3 % 2 AS int) AS online_security, cast(o_orderkey % 5 % 2 AS int) AS online_backup,
  cast(o_orderkey % 7 % 2 AS int) AS device_protection, cast(o_custkey % 3 % 2 AS int) AS tech_support,
  cast(o_custkey % 5 % 2 AS int) AS streaming_tv, cast(o_custkey % 7 % 2 AS int) AS streaming_movies,
  CASE o_orderstatus WHEN 'F' THEN 'DSL' WHEN 'O' THEN 'Fiber optic' ELSE 'No' END AS internet_service,
  CASE o_custkey % 3 WHEN 0 THEN 'Month-to-month' WHEN 1 THEN 'One year' ELSE 'Two year' END AS contract_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Electronic check' WHEN '2-HIGH' THEN 'Mailed check'
    WHEN '3-MEDIUM' THEN 'Bank transfer' WHEN '5-LOW' THEN 'Credit card' ELSE 'Voucher' END AS payment_method,
  o_totalprice / 2500 - 1 AS monthly_charges, o_totalprice / 10 AS total_charges,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 200000 THEN 1 ELSE 0 END AS churned FROM {orders}"""
PRICE = """SELECT p_partkey AS property_id, CASE p_type WHEN 'ECONOMY' THEN 'Downtown' WHEN 'SMALL' THEN 'Suburbs'
    WHEN 'PROMO' THEN 'Urban' WHEN 'LARGE' THEN 'Waterfront' ELSE 'Rural' END AS neighborhood,
  cast(p_size * 90 AS int) AS square_feet, cast(p_partkey % 6 AS int) AS bedrooms, 1 + p_partkey % 4 / 2 AS bathrooms,
  cast(p_size * 300 AS int) AS lot_size, cast(p_partkey % 230 AS int) AS age, cast(1 + p_partkey % 5 AS int) AS quality,
  cast(1 + p_size % 5 AS int) AS condition, cast(p_size % 2 AS int) AS has_garage, cast(p_partkey % 3 % 2 AS int) AS has_pool,
  cast(p_partkey % 5 % 2 AS int) AS has_fireplace, cast(p_size % 3 % 2 AS int) AS has_basement,
  cast(p_partkey % 2 AS int) AS is_renovated, cast(p_size % 20 AS int) AS years_since_renovation,
  cast(1 + p_size % 10 AS int) AS school_rating, p_retailprice / 50 AS distance_to_center,
  p_retailprice * p_size AS price FROM {part}"""
FRAUD = """SELECT event_id AS transaction_id, value * 20 AS amount, hour(ts) AS hour_of_day, {weekday} AS day_of_week,
  cast(event_id % 2 AS int) AS is_online, cast(event_id % 3 % 2 AS int) AS card_present, cast(event_id % 5 % 2 AS int) AS pin_used,
  value * 3 AS distance_from_home, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS is_foreign,
  cast(user_id % 6 AS int) AS merchant_trust, user_id AS card_age_days, user_id % 60 AS account_age_months,
  800 + user_id / 2 AS avg_transaction_amount, cast(event_id % 9 AS int) AS transactions_last_24h,
  cast(event_id % 40 AS int) AS transactions_last_week, value * 2 AS time_since_last_txn,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS previous_fraud_count, event_type AS merchant_category,
  CASE WHEN event_type = 'error' AND value > 60 THEN 1 ELSE 0 END AS is_fraud FROM {events}"""
FRAUD_SPARK = FRAUD.replace("{weekday}", "weekday(ts)")
FRAUD_SQL = plain(FRAUD.replace("{weekday}", "isodow(ts) - 1"))
CHURN_SQL, PRICE_SQL = plain(CHURN), plain(PRICE)


def churn(spark, sf_dir):
    return bind(spark, sf_dir, CHURN)


def price(spark, sf_dir):
    return bind(spark, sf_dir, PRICE)


def fraud(spark, sf_dir):
    return bind(spark, sf_dir, FRAUD_SPARK)


CHURN_V2_SQL = f"""SELECT *, CASE WHEN tenure_months BETWEEN 0 AND 12 THEN 0 WHEN tenure_months <= 24 THEN 1
    WHEN tenure_months <= 48 THEN 2 WHEN tenure_months <= 72 THEN 3 WHEN tenure_months > 72 THEN 4 ELSE -1 END
    AS tenure_category, total_charges / (tenure_months + 1) AS charge_per_month_tenure,
  online_security + online_backup + device_protection + tech_support + streaming_tv + streaming_movies AS service_count,
  (monthly_charges > (SELECT median(monthly_charges) FROM ({CHURN_SQL})))::INT AS high_value_customer FROM ({CHURN_SQL})"""
CHURN_V3_SQL = f"""SELECT *, CASE contract_type WHEN 'Month-to-month' THEN 0 WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 END
    AS contract_stability, CASE payment_method WHEN 'Electronic check' THEN 3 WHEN 'Mailed check' THEN 2
    WHEN 'Bank transfer' THEN 1 WHEN 'Credit card' THEN 1 END AS payment_risk,
  service_count + tenure_months / 12 + partner + dependents AS engagement_score,
  CASE WHEN monthly_charges BETWEEN 0 AND 35 THEN 0 WHEN monthly_charges > 35 AND monthly_charges <= 70 THEN 1
    WHEN monthly_charges > 70 AND monthly_charges <= 150 THEN 2 WHEN monthly_charges > 150 THEN 3 ELSE -1 END
    AS monthly_charge_category, (internet_service <> 'No')::INT AS has_internet,
  (streaming_tv = 1 OR streaming_movies = 1)::INT AS has_streaming,
  (online_security = 1 OR device_protection = 1)::INT AS has_security_services FROM ({CHURN_V2_SQL})"""
V2 = ["tenure_category", "charge_per_month_tenure", "service_count", "high_value_customer"]
V3 = ["contract_stability", "payment_risk", "engagement_score", "monthly_charge_category", "has_internet",
      "has_streaming", "has_security_services"]


def _rounded(columns, doubles):
    return ", ".join(f"round({c}, 9) AS {c}" if c in doubles else c for c in columns)


@query("g01_churn_v2", f"SELECT customer_id, {_rounded(V2, V2[1:2])} FROM ({CHURN_V2_SQL})")
def g01(spark, sf_dir):
    return nice(X.churn_v2(churn(spark, sf_dir)).select("customer_id", *V2))


@query("g02_churn_v3", f"SELECT customer_id, {_rounded(V3, ['engagement_score'])} FROM ({CHURN_V3_SQL})")
def g02(spark, sf_dir):
    return nice(X.add_features(churn(spark, sf_dir), "churn", "v3").select("customer_id", *V3))


PRICE_V2_SQL = f"""SELECT *, square_feet / 100 AS price_per_sqft_est, bedrooms / (bathrooms + 0.1) AS bed_bath_ratio,
  bedrooms + bathrooms AS total_rooms, CASE WHEN age > 0 AND age <= 10 THEN 0 WHEN age > 10 AND age <= 30 THEN 1
    WHEN age > 30 AND age <= 60 THEN 2 WHEN age > 60 AND age <= 200 THEN 3 END AS age_category,
  quality * condition AS quality_condition_score FROM ({PRICE_SQL})"""
PRICE_V3_SQL = f"""SELECT *, square_feet * quality / 1000 AS sqft_quality_interaction,
  lot_size / (square_feet + 1) AS lot_to_sqft_ratio, has_pool + has_fireplace + has_basement + has_garage AS amenity_score,
  age - is_renovated * years_since_renovation AS effective_age,
  school_rating / (distance_to_center + 1) AS school_distance_score FROM ({PRICE_V2_SQL})"""
PRICE_V4_SQL = f"""SELECT *, CASE WHEN quality >= 4 AND square_feet > 3000 THEN 1 ELSE 0 END AS luxury_score,
  CASE WHEN square_feet > 0 AND square_feet <= 1500 THEN 0 WHEN square_feet > 1500 AND square_feet <= 2500 THEN 1
    WHEN square_feet > 2500 AND square_feet <= 4000 THEN 2 WHEN square_feet > 4000 AND square_feet <= 10000 THEN 3 END
    AS size_category, (neighborhood IN ('Waterfront', 'Downtown'))::INT AS premium_location FROM ({PRICE_V3_SQL})"""
P2 = ["price_per_sqft_est", "bed_bath_ratio", "total_rooms", "age_category", "quality_condition_score"]
P3 = ["sqft_quality_interaction", "lot_to_sqft_ratio", "amenity_score", "effective_age", "school_distance_score"]
P4 = ["luxury_score", "size_category", "premium_location"]


@query("g03_price_v2", f"SELECT property_id, {_rounded(P2, P2[:3])} FROM ({PRICE_V2_SQL})")
def g03(spark, sf_dir):
    return nice(X.price_v2(price(spark, sf_dir)).select("property_id", *P2))


@query("g04_price_v3", f"SELECT property_id, {_rounded(P3, [P3[0], P3[1], P3[4]])} FROM ({PRICE_V3_SQL})")
def g04(spark, sf_dir):
    return nice(X.add_features(price(spark, sf_dir), "price", "v3").select("property_id", *P3))


@query("g05_price_v4", f"SELECT property_id, {', '.join(P4)} FROM ({PRICE_V4_SQL})")
def g05(spark, sf_dir):
    return X.add_features(price(spark, sf_dir), "price", "v4").select("property_id", *P4)


FRAUD_V2_SQL = f"""SELECT *, (hour_of_day >= 23 OR hour_of_day <= 5)::INT AS is_late_night, (day_of_week >= 5)::INT AS is_weekend,
  (amount > 1000)::INT AS is_high_amount, abs(amount - avg_transaction_amount) AS amount_deviation,
  (transactions_last_24h > 5)::INT AS high_velocity, (distance_from_home > 100 OR is_foreign = 1)::INT AS location_risk,
  (card_age_days < 30)::INT AS new_card, (previous_fraud_count > 0)::INT AS has_fraud_history FROM ({FRAUD_SQL})"""
FRAUD_V3_SQL = f"""SELECT *, is_high_amount + location_risk + high_velocity + new_card + has_fraud_history + is_late_night
    + online_no_card_present AS composite_risk_score, merchant_trust + pin_used * 2 + card_present * 2 AS trust_score,
  (time_since_last_txn < 0.5 OR time_since_last_txn > 168)::INT AS unusual_time_pattern,
  ln(1 + account_age_months) AS account_maturity FROM (
  SELECT *, (is_online = 1 AND card_present = 0)::INT AS online_no_card_present,
    (is_foreign = 1 AND amount > 500)::INT AS foreign_high_amount FROM ({FRAUD_V2_SQL}))"""
R2 = ["is_late_night", "is_weekend", "is_high_amount", "amount_deviation", "high_velocity", "location_risk", "new_card",
      "has_fraud_history"]
R3 = ["online_no_card_present", "foreign_high_amount", "composite_risk_score", "trust_score", "unusual_time_pattern",
      "account_maturity"]


@query("g06_fraud_v2", f"SELECT transaction_id, {_rounded(R2, ['amount_deviation'])} FROM ({FRAUD_V2_SQL})")
def g06(spark, sf_dir):
    return nice(X.fraud_v2(fraud(spark, sf_dir)).select("transaction_id", *R2))


@query("g07_fraud_v3", f"SELECT transaction_id, {_rounded(R3, ['account_maturity'])} FROM ({FRAUD_V3_SQL})")
def g07(spark, sf_dir):
    return nice(X.add_features(fraud(spark, sf_dir), "fraud", "v3").select("transaction_id", *R3))


@query("g08_feature_versioning", f"""SELECT 'v1' AS version, count(*) AS n, NULL::BIGINT AS v2_sum, NULL::BIGINT AS v3_sum,
    NULL::BIGINT AS v4_sum FROM ({PRICE_V4_SQL})
  UNION ALL SELECT 'v2', count(*), sum(quality_condition_score)::BIGINT, NULL, NULL FROM ({PRICE_V4_SQL})
  UNION ALL SELECT 'v3', count(*), sum(quality_condition_score)::BIGINT, sum(amenity_score)::BIGINT, NULL FROM ({PRICE_V4_SQL})
  UNION ALL SELECT 'v4', count(*), sum(quality_condition_score)::BIGINT, sum(amenity_score)::BIGINT, sum(luxury_score)::BIGINT
    FROM ({PRICE_V4_SQL}) UNION ALL SELECT 'v9', count(*), NULL, NULL, NULL FROM ({PRICE_V4_SQL})""")
def g08(spark, sf_dir):
    out = None
    for version in ("v1", "v2", "v3", "v4", "v9"):
        df = X.add_features(price(spark, sf_dir), "price", version)
        sums = [(F.sum(c) if c in df.columns else F.lit(None).cast("bigint")).alias(n) for c, n in (
            ("quality_condition_score", "v2_sum"), ("amenity_score", "v3_sum"), ("luxury_score", "v4_sum"))]
        row = df.agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("version", F.lit(version))
        out = row if out is None else out.unionByName(row)
    return out


@query("g09_raw_ratio_features", f"""SELECT transaction_id, round_even(amount / (avg_transaction_amount + 1) * 1000, 0) / 1000 AS amount_to_avg_ratio,
  transactions_last_24h / 1 AS daily_transaction_velocity, round_even(transactions_last_week / 7 * 1000, 0) / 1000 AS weekly_transaction_velocity
  FROM ({FRAUD_SQL})""")
def g09(spark, sf_dir):
    return X.raw_ratio_features(fraud(spark, sf_dir)).select(
        "transaction_id", "amount_to_avg_ratio", "daily_transaction_velocity", "weekly_transaction_velocity")


@query("g10_label_encode", """SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment,
  dense_rank() OVER (ORDER BY c_name) - 1 AS name FROM customer""")
def g10(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT c_custkey, c_mktsegment AS segment, c_name AS name FROM {customer}")
    for column in ("segment", "name"):
        df = X.label_encode(df, column, X.label_table(df, column))
    return df


@query("g11_standard_scale", """SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part))
    / (SELECT stddev_pop(p_size) FROM part), 9) AS p_size,
  round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 9)
    AS p_retailprice, 0.0::DOUBLE AS fixed_value FROM part""")
def g11(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT p_partkey, p_size, p_retailprice, 7 AS fixed_value FROM {part}")
    return nice(X.standard_scale(df, ["p_size", "p_retailprice", "fixed_value"]))


@query("g13_polynomial", "SELECT p_partkey, p_size, p_retailprice FROM part")
def g13(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT p_partkey, p_size, p_retailprice FROM {part}")
    return X.polynomial(df, ["p_size", "p_retailprice"], degree=2)


@query("g13_polynomial_enabled", """SELECT p_partkey, round(p_size + p_size * p_size + p_retailprice + p_size * p_retailprice
  + p_retailprice * p_retailprice, 6) AS term_sum FROM part""")
def g13_on(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    df = bind(spark, sf_dir, "SELECT p_partkey, cast(p_size AS double) AS a, p_retailprice AS b FROM {part}")
    out = X.polynomial(df, ["a", "b"], degree=2, enabled=True)
    total = F.aggregate(vector_to_array("polynomial"), F.lit(0.0), lambda s, v: s + v)
    return out.select("p_partkey", F.round(total, 6).alias("term_sum"))


@query("g14_target_log", """SELECT p_partkey, round(ln(1 + p_retailprice), 9) AS logged, round(p_retailprice, 6) AS restored,
  p_retailprice AS untouched FROM part""")
def g14(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT p_partkey, p_retailprice FROM {part}")
    logged = X.target_log(F.col("p_retailprice"))
    return df.select("p_partkey", F.round(logged, 9).alias("logged"), F.round(X.target_unlog(logged), 6).alias("restored"),
                     X.target_log(F.col("p_retailprice"), enabled=False).alias("untouched"))


@query("g15_split_stratified", """SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY md5(concat('42:', o_orderkey::VARCHAR)), o_orderkey) <= round(0.2 * count(*) OVER (PARTITION BY o_orderstatus))
    AS is_test FROM orders""")
def g15(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT o_orderkey, o_orderstatus FROM {orders}")
    return X.split_stratified(df, "o_orderkey", "o_orderstatus")


@query("g16_split_random", """SELECT o_orderkey, substr(md5(concat('42:', o_orderkey::VARCHAR)), 1, 8) < '33333333' AS is_test
  FROM orders""")
def g16(spark, sf_dir):
    return X.split_random(bind(spark, sf_dir, "SELECT o_orderkey FROM {orders}"), "o_orderkey")


@query("g17_features_target", "SELECT p_brand, p_size, p_retailprice FROM part")
def g17(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT p_partkey, p_name, p_type, p_brand, p_size, p_retailprice FROM {part}")
    return X.features_and_target(df, "p_type", ["p_partkey", "p_name"])[0]


@query("g18_balanced_weights", """SELECT l_returnflag, round(min(w), 9) AS weight, count(*) AS n FROM (SELECT l_returnflag,
    count(*) OVER () / (3.0 * count(*) OVER (PARTITION BY l_returnflag)) AS w FROM lineitem) GROUP BY l_returnflag""")
def g18(spark, sf_dir):
    df = X.balanced_weights(bind(spark, sf_dir, "SELECT l_returnflag FROM {lineitem}"), "l_returnflag")
    return nice(df.groupBy("l_returnflag").agg(F.min("weight").alias("weight"), F.count(F.lit(1)).alias("n")))


@query("g19_scale_pos_weight", f"""SELECT round(sum(1 - is_fraud) / sum(is_fraud), 9) AS plain_weight,
  round(2 * sum(1 - is_fraud) / sum(is_fraud), 9) AS focal_weight FROM ({FRAUD_SQL})""")
def g19(spark, sf_dir):
    df = fraud(spark, sf_dir)
    weights = X.scale_pos_weight(df, "is_fraud").withColumnRenamed("scale_pos_weight", "plain_weight")
    focal = X.scale_pos_weight(df, "is_fraud", focal=True).scalar()
    return nice(weights.withColumn("focal_weight", focal))


_SMOTE = ["amount", "hour_of_day", "distance_from_home", "transactions_last_week"]
_NEAR_SQL = f"""f AS (SELECT transaction_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in _SMOTE)}, is_fraud FROM ({FRAUD_SQL})),
  m AS (SELECT * FROM f WHERE is_fraud = 1),
  near AS (SELECT a.transaction_id, row_number() OVER (PARTITION BY a.transaction_id ORDER BY {' + '.join(
    f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in _SMOTE)}, b.transaction_id) AS nth, b.transaction_id AS neighbour
    FROM m a JOIN m b ON a.transaction_id <> b.transaction_id QUALIFY nth <= 5)"""


@query("g20_neighbours", f"WITH {_NEAR_SQL} SELECT transaction_id, nth, neighbour FROM near")
def g20_neighbours(spark, sf_dir):
    found = nearest_neighbours(fraud(spark, sf_dir).filter("is_fraud = 1"), "transaction_id", _SMOTE)
    return (found.select(F.col("_key").alias("transaction_id"), F.posexplode("_near").alias("nth", "n"))
            .select("transaction_id", (F.col("nth") + 1).alias("nth"), F.col("n.key").alias("neighbour")))


@query("g20_smote_oversample", f"""WITH {_NEAR_SQL},
  s AS (SELECT floor(0.5 * count(*) FILTER (is_fraud = 0))::BIGINT - count(*) FILTER (is_fraud = 1) AS wanted FROM f),
  l AS (SELECT transaction_id, list(neighbour ORDER BY nth) AS others, row_number() OVER (
    ORDER BY md5(concat('42:', transaction_id)), transaction_id) AS rank, count(*) OVER () AS bases FROM near GROUP BY transaction_id),
  c AS (SELECT transaction_id, others, unnest(range(1, (wanted // bases + CASE WHEN rank <= wanted % bases THEN 1 ELSE 0 END)::BIGINT + 1)) AS copy
    FROM l, s WHERE wanted > 0),
  d AS (SELECT *, md5(concat('42:', transaction_id, ':', copy)) AS dice FROM c),
  e AS (SELECT transaction_id, others[('0x' || substr(dice, 1, 12))::BIGINT % len(others) + 1] AS other,
    ('0x' || substr(dice, 13, 12))::BIGINT % 1000003 / 1000003 AS part FROM d)
  SELECT *, false AS synthetic FROM f UNION ALL BY NAME
  SELECT NULL AS transaction_id, {', '.join(f'a.{c} + part * (b.{c} - a.{c}) AS {c}' for c in _SMOTE)}, 1 AS is_fraud, true AS synthetic
  FROM e JOIN m a USING (transaction_id) JOIN m b ON b.transaction_id = e.other""")
def g20(spark, sf_dir):
    return X.smote_oversample(fraud(spark, sf_dir).select("transaction_id", *_SMOTE, "is_fraud"), "transaction_id", "is_fraud", _SMOTE)
