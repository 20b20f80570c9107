"""Exact running totals and row numbers that never put one group into one task.

A group is cut into ranges of its order value; a window runs inside each (group, range), and the totals of the ranges
before it are added. Only the short list of range totals is ever ordered per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_RANGES, MAX_RANGES = 64, 8192


def range_count(df: DataFrame) -> int:
    """A power of two that keeps pace with the session's shuffle partitions."""
    wanted, ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MIN_RANGES
    while ranges < min(wanted, MAX_RANGES):
        ranges *= 2
    return ranges


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over as many tasks as shuffles have, however few bytes it is now."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _steps_below(steps: Column, value: Column, lo: int, hi: int) -> Column:
    """How many of the sorted ``steps`` are below ``value``: a binary search spelled as nested conditions, so that it
    compiles with the rest of the projection."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(value > steps[mid], _steps_below(steps, value, mid + 1, hi)).otherwise(_steps_below(steps, value, lo, mid))


def _steps_below_many(steps: Column, value: Column, ranges: int) -> Column:
    """The same for many steps, as a fold over the halving jump widths; ``ranges`` is a power of two."""
    widths, width = [], ranges // 2
    while width:
        widths.append(F.lit(width))
        width //= 2
    return F.aggregate(F.array(*widths), F.lit(0), lambda at, w: F.when(
        F.try_element_at(steps, at + w) < value, at + w).otherwise(at))


def cut_into_ranges(df: DataFrame, order: str, ranges: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add ``_range``, a monotone step function of ``order`` with about equally many rows per step.

    Steps come from approximate quantiles; results stay exact because any monotone cut gives the same totals. The
    quantiles read ``source`` if given: a plain scan that has ``order``, cheaper than computing ``df`` twice.
    ``ranges`` must be a power of two.
    """
    source, ranges = (df if source is None else source), ranges or range_count(df)
    quantiles = F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges)
    out = df.withColumn("_steps", source.agg(quantiles.alias("steps")).scalar())
    steps, value = F.col("_steps"), F.col(order)
    number = (_steps_below(steps, value, 0, ranges - 1) if ranges <= MIN_RANGES
              else _steps_below_many(steps, value, ranges))
    return out.withColumn("_range", number).drop("_steps")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str],
                   ranges: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add inclusive running sums ``{new column: value column}`` per ``keys`` in ``order``.

    ``order[0]`` must be numeric and not null; the other order columns only break ties.
    """
    return _totals_by_range(cut_into_ranges(df, order[0], ranges, source), keys, order, values).drop("_range")


def running_totals_by_key(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, str],
                          ranges: int | None = None) -> DataFrame:
    """As :func:`running_totals`, with ranges of each key's own values: for few keys, whose values differ in size."""
    ranges = ranges or range_count(df)
    steps = df.groupBy(*keys).agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_steps"))
    cut = df.join(steps, list(keys)).withColumn("_range", _steps_below_many(F.col("_steps"), F.col(order), ranges))
    return _totals_by_range(cut.select(*df.columns, "_range"), keys, [order], values).drop("_range")


def _totals_by_range(cut: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    before = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
                            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in values])
    local = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({n: F.sum(v).over(local) for n, v in values.items()})
    same = F.col("_range") == F.col("_k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = summed.join(offsets, same)
    return joined.select(*cut.columns, *[(F.col(n) + F.col(f"_off_{n}")).alias(n) for n in values])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank",
           bucket: Column | None = None) -> DataFrame:
    """Add the 1-based row number per ``keys`` in ``order``.

    ``bucket`` may give a range number that is monotone in ``order`` (a hash prefix, say); without it the ranges come
    from quantiles of ``order[0]``.
    """
    cut = df.withColumn("_one", F.lit(1).cast("bigint"))
    cut = cut.withColumn("_range", bucket) if bucket is not None else cut_into_ranges(cut, order[0])
    return _totals_by_range(cut, keys, order, {name: "_one"}).drop("_one", "_range")


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row ``q``: the linearly interpolated quantiles as an array, found by rank over the distinct values."""
    counts = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v"))
              .agg(F.count(F.lit(1)).alias("n")))
    run = running_totals(counts, [], ["v"], {"upto": "n"}, source=df.select(F.col(column).cast("double").alias("v")))
    run = run.withColumn("_total", counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar())

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("v")))

    out = []
    for share in shares:
        place = (F.col("_total") - 1) * F.lit(float(share))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append(low + (high - low) * F.max(place - F.floor(place)))
    return run.agg(F.array(*out).alias("q"))


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row ``median``."""
    return exact_quantiles(df, column, [0.5]).select(F.col("q")[0].alias("median"))
