"""Explicit schemas of the inputs; nothing is inferred."""

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
STRINGS, TEXTS = T.ArrayType(S), T.MapType(S, S)

CHURN = _struct(
    customer_id=S, senior_citizen=I, partner=I, dependents=I, tenure_months=I, phone_service=I, multiple_lines=I,
    internet_service=S, online_security=I, online_backup=I, device_protection=I, tech_support=I, streaming_tv=I,
    streaming_movies=I, contract_type=S, paperless_billing=I, payment_method=S, monthly_charges=D, total_charges=D, churned=I)
PRICE = _struct(
    property_id=S, neighborhood=S, square_feet=I, bedrooms=I, bathrooms=D, lot_size=I, year_built=I, age=I, property_type=S,
    condition=I, quality=I, has_garage=I, garage_spaces=I, has_pool=I, has_fireplace=I, has_basement=I, is_renovated=I,
    years_since_renovation=I, school_rating=I, distance_to_center=D, price=I)
FRAUD = _struct(
    transaction_id=S, amount=D, merchant_category=S, hour_of_day=I, day_of_week=I, is_online=I, device_type=S, card_present=I,
    pin_used=I, distance_from_home=D, is_foreign=I, merchant_trust=I, card_age_days=I, account_age_months=I,
    avg_transaction_amount=D, transactions_last_24h=I, transactions_last_week=I, amount_to_avg_ratio=D,
    daily_transaction_velocity=D, weekly_transaction_velocity=D, time_since_last_txn=D, previous_fraud_count=I, is_fraud=I)

EXPERIMENTS = _struct(experiment_id=S, name=S, lifecycle_stage=S, artifact_location=S, tags=TEXTS)
RUNS = _struct(run_id=S, experiment_id=S, run_name=S, metrics=T.MapType(S, D), params=TEXTS, tags=TEXTS)
MODELS = _struct(name=S)
VERSIONS = _struct(name=S, version=S, current_stage=S, run_id=S)
ARTIFACTS = _struct(run_id=S, path=S, is_dir=B, seq=L)
REGISTRY = {"experiments": EXPERIMENTS, "runs": RUNS, "models": MODELS, "versions": VERSIONS, "artifacts": ARTIFACTS}

JOBS = _struct(
    id=S, username=S, run_ref=S, branch=S, tier=S, status=S, remote_status=S, job_url=S, spec_path=S, command=S,
    submitted_at=T.TimestampType(), completed_at=T.TimestampType(), project_id=S, seq=L)
STATUS_EVENTS = _struct(run_ref=S, raw_status=S, ts=T.TimestampType())

SPEC = _struct(title=S, authors=S, sections=T.ArrayType(_struct(name=S, per_model=B, hint=S)), hints=TEXTS,
               citation_style=S, formatting=TEXTS)
PLAN = _struct(number=S, name=S, title=S, model_name=S, content_blocks=T.ArrayType(
    _struct(type=S, purpose=S, data_needed=S, specifics=TEXTS, priority=S)))
CONTENT = _struct(block_type=S, content=T.VariantType(), content_encoding=S, metadata=TEXTS)
CACHE = _struct(spec=SPEC, results=T.ArrayType(_struct(plan=PLAN, contents=T.ArrayType(CONTENT), errors=STRINGS)))

NOTEBOOK = _struct(cells=T.ArrayType(_struct(cell_type=S, source=T.VariantType())))

_LISTED = dict(datasetId=S, id=S, datasetName=S, name=S, description=S, readWriteSnapshotId=S, snapshotIds=STRINGS)
_ITEM = T.StructType([T.StructField("dataset", _struct(**_LISTED)), *_struct(**_LISTED).fields])
LISTING_PAGE = _struct(datasets=T.ArrayType(_ITEM), items=T.ArrayType(_ITEM))
