"""Mixing sources to target weights by entropy balancing.

Rates stay as close to one as the token constraints allow (least relative entropy): a document of size x has the rate
min(2, exp(tilt * x)) with one tilt per source. The tilts solve a convex dual, one constraint per source, by Newton steps
on (source, size) counts, kept in a bracket. Rates are then rounded to whole copies along the sizes, so that a source
misses its target by one document's size at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attesta.llm.scratch import fresh, materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
STEPS, CLOSE = 60, 1e-9
#: Equal documents are numbered in pieces of about this many rows, so that no source and size meets in one task.
PIECE_ROWS = 50_000


def source_targets(counts: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from (source, size, n): sources in code-point order (null last) take the weights in
    turn and share ``share`` of all words; no target is above ``most`` times its source, and what is over is shared again
    by weight. Targets are min(most * size, level * weight); the level is the greatest of the levels that hold when the
    sources with the least room per weight are full. One row per source is all that meets in a task here."""
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    room = (F.lit(most) * F.col("source_size")).alias("room")
    by_room = W.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, W.unboundedFollowing)
    leveled = weighed.withColumn("room", room).withColumn(
        "level", (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward))
    target = F.least(F.col("room"), F.max("level").over(W.partitionBy()) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, size: Column, most: float) -> Column:
    return F.when(tilt * size >= math.log(most), F.lit(most)).otherwise(F.exp(tilt * size))


def _exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of its rows, so that reruns agree."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def tilts(counts: DataFrame, targets: DataFrame, most: float = MOST, steps: int = STEPS, close: float = CLOSE) -> DataFrame:
    """(source, tilt) with sum of n * size * rate = target in every source. Each Newton step is one distributed pass over
    the counts; a step that leaves the bracket halves it. A full source (target ``most`` times its size) has all rates
    there; a source without words has nothing to balance."""
    counts = counts.filter("size > 0")
    extent = counts.groupBy("source").agg(F.min("size").alias("least"))
    want = targets.join(extent, targets["source"].eqNullSafe(extent["source"])).select(
        targets["source"], "target", "source_size", "least")
    ratio = F.col("target") / F.col("source_size")
    full = ratio >= most * (1 - 1e-12)
    edge = F.when(ratio < 1, F.log(ratio)).otherwise(F.lit(math.log(most))) / F.col("least")
    now = materialise(want.select(
        "source", "target", F.when(full, edge).otherwise(F.lit(0.0)).alias("tilt"), F.least(edge, F.lit(0.0)).alias("low"),
        F.greatest(edge, F.lit(0.0)).alias("high"), full.alias("done")), "tilts")
    for _ in range(steps):
        at = now.filter("not done").withColumnRenamed("source", "s")
        mass = F.col("n") * F.col("size") * _rate(F.col("tilt"), F.col("size"), most)
        open_ = F.col("tilt") * F.col("size") < math.log(most)
        moments = (counts.join(at, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.first("target").alias("target"), F.first("tilt").alias("tilt"), F.first("low").alias("low"),
            F.first("high").alias("high"), (_exact_sum(mass) - F.first("target")).alias("gap"),
            _exact_sum(F.when(open_, mass * F.col("size")).otherwise(0.0)).alias("slope")))
        low = F.when(F.col("gap") <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gap") >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - F.col("gap") / F.col("slope"))
        done = (F.abs("gap") <= close * F.col("target")) | (high - low <= 1e-15 * F.greatest(F.abs(low), F.abs(high)))
        step = F.when(done, F.col("tilt")).when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        moved = moments.select(F.col("s").alias("source"), "target", step.alias("tilt"), low.alias("low"), high.alias("high"),
                               done.alias("done"))
        now = materialise(now.filter("done").unionByName(moved), "tilts")
        if now.filter("not done").isEmpty():
            break
    return now.select("source", "tilt")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
           weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: ``id, source, size`` (words of the text, null: 0), ``source_size, target, rate, copies``
    (whole, at most ``most`` rounded up), ``taken`` (copies * size) and ``pick`` (a hash of id and text). Rows without
    words have one copy. Repeated rows count as documents of their own. A rerun over the same rows takes the same copies."""
    sized = docs.select(F.col(key).alias("id"), F.col(source).alias("kin"), F.xxhash64(F.col(key), F.col(text)).alias("pick"),
                        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    slim = materialise(sized.select(F.col("kin").alias("source"), "size", "pick", "id"), "sizes")
    counts = materialise(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    targets = materialise(source_targets(counts, weights, share, most), "targets")
    tilt = tilts(counts, targets, most)

    # rates along (source, size): copies before a group of equal rates are the rounded rates before it
    named = targets.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rated = counts.join(named.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")\
        .withColumn("rate", _rate(F.coalesce("tilt", F.lit(0.0)), F.col("size"), most))
    along = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("rate") * F.col("n")).otherwise(0.0)).over(along), F.lit(0.0)))

    # the place of each document in its group: pieces by hash, their counts, the place within the piece
    pieces = F.ceil(F.col("n") / PIECE_ROWS)
    keyed = rated.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", "before", pieces.alias("pieces"))
    rows = slim.join(keyed, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")\
        .withColumn("piece", F.pmod("pick", "pieces"))
    held = rows.groupBy("source", "size", "piece").agg(F.count("*").alias("m"))
    ahead = W.partitionBy("source", "size").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("piece").alias("p"),
                       F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(held, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("piece") == F.col("p")))
    place = F.col("ahead") + F.row_number().over(W.partitionBy("source", "size", "piece").orderBy("pick", "id")) - 1
    done = F.col("before") + F.col("rate") * place
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(
        F.least(F.floor(done + F.col("rate") + 0.5) - F.floor(done + 0.5), F.lit(math.ceil(most)))).cast("long")
    return rows.select("id", "source", "size", "source_size", "target", "rate", whole.alias("copies"),
                       (whole * F.col("size")).alias("taken"), "pick")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies`` and ``taken`` of each row (columns of these names are
    replaced); see ``copies``."""
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new))
    pick, same, nth = fresh(docs, "pick_", "same_", "nth_")
    taken = copies(docs, key, text, source, **options).select(
        F.col("pick").alias(pick), F.col("id").alias(same), *new,
        F.row_number().over(W.partitionBy("pick", "id").orderBy("copies")).alias(nth))
    other = fresh(taken, "pick__", "nth__")
    named = docs.withColumn(other[0], F.xxhash64(F.col(key), F.col(text)))
    named = named.withColumn(other[1], F.row_number().over(W.partitionBy(other[0], key).orderBy(other[0])))
    return named.join(taken, (F.col(other[0]) == F.col(pick)) & (F.col(other[1]) == F.col(nth)) & F.col(key).eqNullSafe(F.col(same)))\
        .select(*docs.columns, *new)
