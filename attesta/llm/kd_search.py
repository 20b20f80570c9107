"""Exact top-k search by inner product: KD-trees, a top one over a sample that cuts shards, and one per shard.

The top tree (median splits of a bounded sample) gives every row a cell; rows of neighbouring cells are packed into shards, each
ordered as a balanced KD-tree (median splits on the widest side), so that a node is a range of rows with a tight bounding box.
Queries are packed into blocks by the same cells. The shards' boxes, a small table, meet the blocks first: a shard is sent to a
block's queries only where the bound max over its box of the inner product reaches a query's k-th score. In a shard each query
opens its best node first, and the k-th score found so far ends its search. A first round against one shard each gives every query
the k-th score it goes on with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from attesta.llm.scratch import materialise

SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 1 << 14, 512, 1 << 10
#: The top tree is cut from this many rows at most (those of least hash); every row is indexed.
SAMPLE_ROWS = 1 << 14
BOXES_PER_PACK, BLOCKS_PER_SALT = 256, 8
CODED = "dim int, cell long, key long, width int, vector binary"
PACKED = "dim int, cell long, width int, ids binary, matrix binary, low binary, high binary"
VISIT = "shard long, block long, numbers binary, q_ids binary, q_matrix binary, kth binary"
HITS = "query_no long, query_id long, vec_id long, score long"
_LEAST = -(1 << 62)


def build_order(matrix: np.ndarray, leaf: int = LEAF_ROWS) -> np.ndarray:
    """Rows in tree order: each node's rows are halved at the median of its widest side."""
    order = np.arange(len(matrix))
    todo = [(0, len(matrix))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            continue
        rows = order[lo:hi]
        part = matrix[rows]
        side = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if part.shape[1] else 0
        half = (hi - lo) // 2
        if part.shape[1]:
            order[lo:hi] = rows[np.argpartition(part[:, side], half)]
        todo += [(lo, lo + half), (lo + half, hi)]
    return order


class Tree:
    """Nodes of a matrix in tree order: row ranges, children and bounding boxes."""

    def __init__(self, matrix: np.ndarray, leaf: int = LEAF_ROWS):
        self.matrix = matrix
        self.range, self.children = [(0, len(matrix))], []
        for node in range(2 * len(matrix)):
            if node >= len(self.range):
                break
            lo, hi = self.range[node]
            if hi - lo <= leaf:
                self.children.append(-1)
                continue
            self.children.append(len(self.range))
            half = (hi - lo) // 2
            self.range += [(lo, lo + half), (lo + half, hi)]
        self.low = np.empty((len(self.range), matrix.shape[1]), dtype=matrix.dtype)
        self.high = np.empty_like(self.low)
        for node in range(len(self.range) - 1, -1, -1):  # children come after their parents
            child = self.children[node]
            if child < 0:
                lo, hi = self.range[node]
                self.low[node], self.high[node] = matrix[lo:hi].min(axis=0), matrix[lo:hi].max(axis=0)
            else:
                self.low[node] = np.minimum(self.low[child], self.low[child + 1])
                self.high[node] = np.maximum(self.high[child], self.high[child + 1])

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, kth: np.ndarray):
        """(query, row, score) of each query's k best rows that score its ``kth`` or more; ties to the smaller id. Every
        query opens the node of greatest bound among those it has not opened, until none reaches its k-th score."""
        bound = (np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T).astype(np.float64)
        bound += np.abs(bound) * 1e-9  # sums of large numbers are rounded
        child, nodes = np.array(self.children), len(self.range)
        waiting = np.full((len(queries), nodes), -np.inf)
        waiting[:, 0] = bound[:, 0]
        kth, top, found = kth.copy(), np.full((len(queries), k), _LEAST, dtype=queries.dtype), []
        going = np.arange(len(queries))
        while len(going):
            best = waiting[going].argmax(axis=1)
            value = waiting[going, best]
            on = (value >= kth[going]) & (value > -np.inf)
            going, best = going[on], best[on]
            waiting[going, best] = -np.inf
            inner = child[best] >= 0
            for step in (0, 1):
                waiting[going[inner], child[best[inner]] + step] = bound[going[inner], child[best[inner]] + step]
            asked, leaf = going[~inner], best[~inner]
            order = np.argsort(leaf, kind="stable")
            asked, leaf = asked[order], leaf[order]
            cuts = np.append(np.flatnonzero(np.append([True], leaf[1:] != leaf[:-1])), len(leaf)) if len(leaf) else np.zeros(1, dtype=np.int64)
            for a, b in zip(cuts[:-1], cuts[1:]):
                lo, hi = self.range[leaf[a]]
                who = asked[a:b]
                scores = queries[who] @ self.matrix[lo:hi].T
                other = own[who][:, None] != ids[lo:hi]
                scores[~other] = _LEAST
                q, r = np.nonzero(other & (scores >= kth[who][:, None]))
                if not len(q):
                    continue
                found.append((who[q], r + lo, scores[q, r]))
                hit = np.unique(q)
                both = np.concatenate([top[who[hit]], scores[hit]], axis=1)
                top[who[hit]] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k:]
                kth[who[hit]] = np.maximum(kth[who[hit]], top[who[hit]].min(axis=1))
        if not found:
            return [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=queries.dtype)]
        q, r, score = (np.concatenate(x) for x in zip(*found))
        reach = score >= kth[q]
        q, r, score = q[reach], r[reach], score[reach]
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return [x[rank < k] for x in (q, r, score)]


class TopTree:
    """Median splits of a sample: a cell number, in tree order, for any row."""

    def __init__(self, sample: np.ndarray, least: int):
        self.side, self.cut, self.child = [], [], []
        self._grow(sample, max(least, 1))
        cells = iter(range(len(self.side)))
        self.cell = [next(cells) if c is None else -1 for c in self.child]

    def _grow(self, rows: np.ndarray, least: int) -> int:
        here = len(self.side)
        self.side.append(0)
        self.cut.append(0)
        self.child.append(None)
        if len(rows) >= 2 * least and rows.shape[1]:
            side = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            cut = int(np.partition(rows[:, side], len(rows) // 2)[len(rows) // 2])
            right = rows[:, side] >= cut
            if 0 < right.sum() < len(rows):
                self.side[here], self.cut[here] = side, cut
                self.child[here] = (self._grow(rows[~right], least), self._grow(rows[right], least))
        return here

    def cells(self, rows: np.ndarray) -> np.ndarray:
        side, cut, cell = np.array(self.side), np.array(self.cut), np.array(self.cell)
        left = np.array([c[0] if c else -1 for c in self.child])
        right = np.array([c[1] if c else -1 for c in self.child])
        node = np.zeros(len(rows), dtype=np.int64)
        while (inner := np.flatnonzero(left[node] >= 0)).size:
            at = node[inner]
            node[inner] = np.where(rows[inner, side[at]] >= cut[at], right[at], left[at])
        return cell[node]


def _narrow(matrix: np.ndarray) -> np.ndarray:
    reach = int(np.abs(matrix).max(initial=0))
    return matrix.astype(np.int16 if reach < 1 << 15 else np.int32 if reach < 1 << 31 else np.int64)


def _by_length(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of the lists of each length."""
    flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    length = np.diff(offsets)
    for dim in np.unique(length):
        where = np.flatnonzero(length == dim)
        yield int(dim), where, flat[offsets[where][:, None] + np.arange(dim)].reshape(len(where), dim)


def _encode(trees: dict[int, TopTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for dim, where, rows in _by_length(batch.column(1)):
                cell = trees[dim].cells(rows) if dim in trees else np.zeros(len(rows), dtype=np.int64)
                rows = _narrow(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(where), dim), pa.int32()), pa.array(cell, pa.int64()), pa.array(keys[where]),
                    pa.array(np.full(len(where), rows.itemsize), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["dim", "cell", "key", "width", "vector"])
    return run


def _pack(most: int):
    """Packed rows of at most ``most`` vectors of one length, in tree order, with their box. Rows come sorted by cell."""
    names = [f.split()[0] for f in PACKED.split(", ")]

    def packed(dim: int, cell: int, parts: list) -> tuple:
        ids = np.concatenate([x for x, _ in parts])
        matrix = np.concatenate([x for _, x in parts])  # as wide as the widest
        order = build_order(matrix)
        ids, matrix = ids[order], matrix[order]
        box = [x.astype(np.int64).tobytes() for x in (matrix.min(axis=0), matrix.max(axis=0))]
        return (dim, cell, matrix.itemsize, ids.tobytes(), matrix.tobytes(), *box)

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, cell, key, width = (np.asarray(batch.column(i)) for i in range(4))
            vectors = batch.column(4)
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (cell[1:] != cell[:-1]) | (width[1:] != width[:-1])) + 1
            for a, b in zip(np.append([0], cuts).tolist(), np.append(cuts, len(cell)).tolist()):
                rows = np.frombuffer(b"".join(vectors[a:b].to_pylist()), dtype=f"<i{width[a]}").reshape(b - a, dim[a])
                for at in range(a, b, most):
                    to = min(at + most, b)
                    if parts and (held[0] != dim[a] or size + to - at > most or (held[1] != cell[a] and 2 * size >= most)):
                        yield batch_of([packed(*held, parts)])
                        parts, size = [], 0
                    held = (int(dim[a]), int(cell[a]))
                    parts.append((key[at:to], rows[at - a:to - a]))
                    size += to - at
        if parts:
            yield batch_of([packed(*held, parts)])
    return run


def _matrix(data: bytes, width: int, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{width}").reshape(rows, dim)


def _route(home: bool):
    """Which queries of a block go to which shards: those whose bound over the shard's box reaches their k-th score; at
    ``home`` each to the shard of its greatest bound."""
    names = [f.split()[0] for f in VISIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                matrix = _matrix(row["matrix"], row["width"], row["dim"], len(ids))
                queries = matrix.astype(np.float64)
                low, high = (np.stack([np.frombuffer(b[side], np.int64) for b in row["boxes"]]).astype(np.float64) for side in ("low", "high"))
                bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
                kth = np.full(len(ids), _LEAST, dtype=np.int64) if row["kth"] is None else np.array(row["kth"], dtype=np.int64)
                if home:
                    goes = np.arange(bound.shape[1]) == bound.argmax(axis=1)[:, None]
                else:
                    goes = bound + np.abs(bound) * 1e-9 + 1 >= kth[:, None]
                out = []
                for column in np.flatnonzero(goes.any(axis=0)):
                    who = np.flatnonzero(goes[:, column])
                    asked = [who, ids[who], matrix[who], kth[who]]
                    out.append((row["boxes"][column]["shard"], row["block"], *[x.astype(np.int64).tobytes() for x in asked]))
                kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)
    return run


def _search(k: int, apart: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tree, ids, reach = None, None, None, 0.0
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                dim = columns["dim"][i].as_py()
                numbers, own, kth = (np.frombuffer(columns[n][i].as_py(), np.int64) for n in ("numbers", "q_ids", "kth"))
                queries = np.frombuffer(columns["q_matrix"][i].as_py(), np.int64).reshape(len(own), dim)
                if known != columns["shard"][i].as_py():  # visits of a shard come one after another
                    known, ids = columns["shard"][i].as_py(), np.frombuffer(columns["ids"][i].as_py(), np.int64)
                    whole = _matrix(columns["matrix"][i].as_py(), columns["width"][i].as_py(), dim, len(ids)).astype(np.int64)
                    reach = float(np.abs(whole).max(initial=0)) * max(dim, 1)
                    trees = {np.dtype(np.int64): None, np.dtype(np.float64): None}
                kind = np.dtype(np.float64 if reach * float(np.abs(queries).max(initial=0)) < 2.0**52 else np.int64)
                tree = trees[kind] = trees[kind] or Tree(whole.astype(kind))  # doubles are exact there, and faster
                q, r, score = tree.search(queries.astype(kind), own, ids, k, kth.astype(kind))
                if len(q):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(columns["block"][i].as_py() * apart + numbers[q]), pa.array(own[q]), pa.array(ids[r]),
                        pa.array(score.astype(np.int64))], names=["query_no", "query_id", "vec_id", "score"])
    return run


def exact_top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20,
                scale: int = 64) -> DataFrame:
    """For each row whose id is divisible by ``every``: ``query_id, rank, vec_id, score`` of its k best rows by the inner
    product of floor(scale * x), ties to the smaller id. Vectors that are null or hold null or non-finite components take
    no part, nor do rows without an id; vectors of different lengths do not meet. Rows with a query's own id are its own;
    other repeated rows are candidates each, and a repeated query row is a query each."""
    spark = vectors.sparkSession
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.coalesce(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(sound).select(F.col(key).cast("long").alias("key"), whole.alias("vector"))
    count = rows.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("key", "vector"), "key").limit(SAMPLE_ROWS).select("vector").toArrow().column(0).combine_chunks()
    least = max(2, SHARD_ROWS * min(count, SAMPLE_ROWS) // (2 * count))  # cells of about half a shard
    coded = materialise(rows.mapInArrow(_encode({dim: TopTree(part, least) for dim, _, part in _by_length(sample)}), CODED), "coded")

    def packed(part: DataFrame, most: int) -> DataFrame:
        return (part.withColumn("spread", F.xxhash64("key", "vector")).repartitionByRange("dim", "cell", "spread")
                .sortWithinPartitions("dim", "cell", "width").select("dim", "cell", "key", "width", "vector").mapInArrow(_pack(most), PACKED))

    shards = materialise(packed(coded, SHARD_ROWS).withColumn("shard", F.monotonically_increasing_id()), "shards")
    queries = materialise(packed(coded.filter(F.col("key") % every == 0), BLOCK_ROWS).drop("low", "high")
                          .withColumn("block", F.monotonically_increasing_id()), "queries")
    packs = max(1, -(-shards.count() // BOXES_PER_PACK))
    boxes = shards.withColumn("pack", F.pmod(F.xxhash64("shard"), F.lit(packs)).cast("int")).groupBy("dim", "pack").agg(
        F.collect_list(F.struct("shard", "low", "high")).alias("boxes"))  # BOXES_PER_PACK or so
    salt = (F.floor(F.col("block") / (1 << 33)) * 31 + F.col("block") % (1 << 33)).cast("long")
    salts = max(1, -(-queries.count() // BLOCKS_PER_SALT))

    def met(asked: DataFrame, home: bool) -> DataFrame:
        visits = asked.join(boxes, ["dim", "pack"]).select("block", "dim", "width", "ids", "matrix", "kth", "boxes").mapInArrow(_route(home), VISIT)
        visits = visits.withColumn("salt", F.pmod(salt, F.lit(salts)))
        placed = shards.select("shard", "dim", "width", "ids", "matrix").join(visits.select("shard", "salt").distinct(), "shard")
        return visits.join(placed, ["shard", "salt"]).drop("salt").sortWithinPartitions("shard").mapInArrow(_search(k, 2 * BLOCK_ROWS), HITS)

    none = F.lit(None).cast("array<long>")
    best = W.partitionBy("query_no").orderBy(F.col("score").desc(), "vec_id")
    one = queries.withColumns({"kth": none, "pack": F.pmod(salt, F.lit(packs)).cast("int")})
    first = materialise(met(one, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_no", "score"), "first")
    block, number = F.floor(F.col("query_no") / (2 * BLOCK_ROWS)), F.pmod("query_no", F.lit(2 * BLOCK_ROWS)).cast("int")
    known = first.groupBy(block.alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(number, "score"))).alias("known"))
    places = F.sequence(F.lit(0), (F.length("ids") / 8).cast("int") - 1)
    reached = F.transform(places, lambda i: F.coalesce(F.try_element_at("known", i), F.lit(_LEAST)))
    every_pack = F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))
    asked = queries.join(known, "block", "left").withColumn("kth", F.when(F.col("known").isNotNull(), reached)).drop("known")
    hits = met(asked.withColumn("pack", every_pack), False)
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)\
        .select("query_id", "rank", "vec_id", "score")
