"""Exact nearest neighbours of every row among all rows: a self-join over cells of space.

Equal points are one point. A bounded number of points by hash parts space into cells, which are halved at the median of the widest
feature; a cell's box is that of its points. Inside its cell each point finds k neighbours, whose k-th distance bounds the true one; with
that bound it visits just the cells whose box can hold a nearer point. Boxes are passed over for a whole cell first, so a point
is compared with few of them. Cells meet their visitors by an equality join, and nothing runs while the query is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Points of a cell, and cells at most.
CELL_POINTS, MOST_CELLS = 256, 4096
#: Points that a cell's bounds are taken from; tasks' shares of the points that are given a cell; runs of cells that one task looks round.
KNOWN, SHARES, RUNS, RUN_CELLS = 4, 64, 128, 8
BLOCK = 512


def _cells(points: np.ndarray, known: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each point, by halving ``known`` points at the median of their widest feature; cells side by side have numbers
    side by side, and the order of ``known`` says nothing."""
    out = np.zeros(len(points), dtype=np.int32)
    todo = [(np.arange(len(points)), known, 0, cells)]
    while todo:
        rows, known, first, n = todo.pop()
        out[rows] = first
        if n == 1 or not len(rows) or not len(known):
            continue
        spread = known.max(axis=0) - known.min(axis=0)
        widest = int(np.argmax(spread))
        if not spread[widest] > 0:
            continue
        values = np.sort(known[:, widest])
        at = values[(len(values) - 1) // 2]
        if at == values[-1]:  # both halves hold some
            at = values[np.searchsorted(values, at) - 1]
        low, under = points[rows, widest] <= at, known[:, widest] <= at
        below = min(max(round(n * float(under.mean())), 1), n - 1)
        todo += [(rows[low], known[under], first, below), (rows[~low], known[~under], first + below, n - below)]
    return out


def _gaps(low: np.ndarray, high: np.ndarray, boxes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The distance of each box (low, high) to each of ``boxes``."""
    out = np.zeros((len(low), len(boxes[0])))
    for i in range(low.shape[1]):
        out += np.maximum(np.maximum(boxes[0][:, i] - high[:, i][:, None], low[:, i][:, None] - boxes[1][:, i]), 0.0) ** 2
    return np.sqrt(out)


def _reaching(points: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each point has k others for sure: the far corners of boxes that hold so many."""
    out = np.full(len(points), np.inf)
    for at in range(0, len(points), BLOCK):
        part = points[at:at + BLOCK]
        far = np.zeros((len(part), len(counts)))
        for i in range(points.shape[1]):
            x = part[:, i][:, None]
            far += np.maximum(np.abs(x - boxes[0][:, i]), np.abs(x - boxes[1][:, i])) ** 2
        order = np.argsort(far, axis=1)
        enough = np.cumsum(counts[order], axis=1) > k
        first = np.argmax(enough, axis=1)
        reached = np.sqrt(far[np.arange(len(part)), order[np.arange(len(part)), first]])
        out[at:at + BLOCK] = np.where(enough.any(axis=1), reached, np.inf)
    return out


def _visits(points: np.ndarray, ids: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, box): the boxes that can hold one of the k nearest of each point of a cell."""
    row, _, apart = _nearest(points, points, ids, ids, k)
    found = np.bincount(row, minlength=len(points))
    bound = np.zeros(len(points))
    np.maximum.at(bound, row, apart)
    bound = np.sqrt(bound)
    few = found < k
    bound[few] = _reaching(points[few], boxes, counts, k)
    reach = bound * (1 + 1e-9) + 1e-12
    near = np.flatnonzero(_gaps(points.min(axis=0)[None], points.max(axis=0)[None], boxes)[0] * (1 - 1e-9) <= reach.max())
    rows, places = [], []
    for at in range(0, len(points), BLOCK):
        part = points[at:at + BLOCK]
        row, place = np.nonzero(_gaps(part, part, (boxes[0][near], boxes[1][near])) * (1 - 1e-9) <= reach[at:at + BLOCK][:, None])
        rows.append(row + at)
        places.append(near[place])
    return np.concatenate(rows), np.concatenate(places)


def _nearest(asked: np.ndarray, points: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row asked, place, squared distance) of the k points nearest to each, itself left out; ties to the smaller id."""
    rows, places, distances = [], [], []
    for at in range(0, len(asked), BLOCK):
        part = asked[at:at + BLOCK]
        apart = np.zeros((len(part), len(points)))
        for i in range(points.shape[1]):  # feature by feature, as the other sums are made
            apart += (part[:, i][:, None] - points[:, i]) ** 2
        apart[own[at:at + BLOCK][:, None] == ids] = np.inf
        if len(points) > k:  # all up to the k-th distance, ties with it included
            limit = np.partition(apart, k - 1, axis=1)[:, k - 1:k]
            row, place = np.nonzero((apart <= limit) & np.isfinite(apart))
        else:
            row, place = np.nonzero(np.isfinite(apart))
        value = apart[row, place]
        order = np.lexsort((ids[place], value, row))
        row, place, value = row[order], place[order], value[order]
        start = np.searchsorted(row, row)
        best = np.arange(len(row)) - start < k
        rows.append(row[best] + at)
        places.append(place[best])
        distances.append(value[best])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(distances)


def nearest_neighbours(df: DataFrame, key: str, features: Sequence[str], k: int = 5, cell_points: int = CELL_POINTS,
                       most_cells: int = MOST_CELLS) -> DataFrame:
    """(``_key``, ``_near``): for each row its k nearest other rows (all, if fewer) as an array of (distance2, key), nearest
    first, ties by smaller key. ``key`` is unique, an integer or text. Rows with a null, NaN or infinite feature take no part."""
    xs = [f"_x{i}" for i in range(len(features))]
    sound = F.lit(True)
    for x in xs:
        sound = sound & F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(key).alias("_key"), *[(F.col(f).cast("double") + F.lit(0.0)).alias(x) for f, x in zip(features, xs)]).filter(sound)
    among_equal = Window.partitionBy(*xs).orderBy("_key")
    points = (rows.withColumn("_nth", F.row_number().over(among_equal)).filter(F.col("_nth") <= k + 1)
              .groupBy(*xs).agg(F.min("_key").alias("id"), F.sort_array(F.collect_list("_key")).alias("keys"))  # k + 1 at most
              .persist())  # on first use: many steps read the points
    total = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    cells = F.greatest(F.lit(1), F.least(F.lit(most_cells), F.ceil(total / cell_points))).cast("int")
    first = points.select(F.xxhash64(*xs).alias("h"), *xs).orderBy("h", *xs).limit(KNOWN * most_cells).agg(
        F.array_sort(F.collect_list(F.struct("h", *xs))).alias("p"))
    known = (first.select(cells.alias("cells"), F.slice("p", F.lit(1), KNOWN * cells).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
             .select("share", "cells", F.explode("p").alias("p")).select("share", "cells", *[F.col(f"p.{x}").alias(x) for x in xs]))
    kind = df.schema[key].dataType.simpleString()
    point = f"id {kind}, " + ", ".join(f"{x} double" for x in xs) + ", cell int"

    def settle(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n = int(known["cells"].iloc[0]) if len(part) else 1
        return part[["id", *xs]].assign(cell=_cells(part[xs].to_numpy(dtype=float), known[xs].to_numpy(dtype=float), n))

    shared = points.select("id", *xs, F.pmod(F.hash(*xs), F.lit(SHARES)).alias("share"))
    home = shared.groupBy("share").cogroup(known.groupBy("share")).applyInPandas(settle, point).persist()  # read by three steps
    run_cells = F.greatest(F.lit(RUN_CELLS), F.ceil(cells / RUNS)).cast("int")
    boxes = home.groupBy(F.col("cell").alias("box")).agg(F.count(F.lit(1)).alias("n"), *[F.min(x).alias(f"_low{x}") for x in xs], *[F.max(x).alias(f"_high{x}") for x in xs])
    boxes = boxes.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((cells - 1) / run_cells).cast("int"))))

    def look_round(part: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = [part[["id", *xs, "cell"]].head(0)]
        sides = tuple(boxes[[f"_{side}{x}" for x in xs]].to_numpy(dtype=float) for side in ("low", "high"))
        counts, numbers = boxes["n"].to_numpy(), boxes["box"].to_numpy()
        for _, members in part.groupby("cell"):
            row, place = _visits(members[xs].to_numpy(dtype=float), members["id"].to_numpy(), sides, counts, k)
            out.append(members[["id", *xs]].iloc[row].assign(cell=numbers[place]))
        return pd.concat(out)

    visits = (home.withColumn("run", F.floor(F.col("cell") / run_cells).cast("int")).groupBy("run")
              .cogroup(boxes.groupBy("run")).applyInPandas(look_round, point))

    def meet(visitors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or members.empty:
            return pd.DataFrame({"id": [], "other": [], "d2": []})
        asked, ids = visitors["id"].to_numpy(), members["id"].to_numpy()
        row, place, apart = _nearest(visitors[xs].to_numpy(dtype=float), members[xs].to_numpy(dtype=float), asked, ids, k)
        return pd.DataFrame({"id": asked[row], "other": ids[place], "d2": apart})

    met = visits.groupBy("cell").cogroup(home.groupBy("cell")).applyInPandas(meet, f"id {kind}, other {kind}, d2 double")
    best = Window.partitionBy("id").orderBy("d2", "other")
    found = met.withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= k)
    keys = points.select(F.col("id").alias("other"), "keys")
    others = found.join(keys, "other").select("id", "d2", F.explode("keys").alias("key"))
    equals = points.select("id", F.lit(0.0).alias("d2"), F.explode("keys").alias("key"))
    lists = others.unionByName(equals).groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.col("d2").alias("distance2"), "key"))), 1, k + 1).alias("_list"))
    named = points.select("id", *xs).join(lists, "id").select(*xs, "_list")
    alone = F.slice(F.filter("_list", lambda n: n["key"] != F.col("_key")), 1, k)
    return rows.join(named, xs).select("_key", *xs, alone.alias("_near"))
