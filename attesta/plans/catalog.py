"""The registration decorator and the table reader the plan modules share."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL twin."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int | None:
    """Over how many tasks work per row is dealt, by the setting ``spark.attesta.partitions``: for tables that come in fewer files
    than there are cores. Not set, tasks follow the files."""
    wanted = spark.conf.get("spark.attesta.partitions", None)
    return int(wanted) if wanted else None


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over that many tasks, where the setting is there."""
    wanted = partitions(df.sparkSession)
    return df.repartition(wanted) if wanted else df


def bind(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """Run a binding written with ``{table}`` names over the driver's parquet tables; ``dealt``: over tables that are spread."""
    names = {name for _, name, _, _ in Formatter().parse(sql) if name}
    tables = {name: table(spark, sf_dir, name) for name in names}
    return spark.sql(sql, **({name: spread(df) for name, df in tables.items()} if dealt else tables))


def plain(sql: str) -> str:
    """The same binding for an engine that knows the tables by name."""
    names = {name for _, name, _, _ in Formatter().parse(sql) if name}
    return sql.format(**{name: name for name in names})
