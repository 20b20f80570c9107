"""Hard negatives by an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own; a row's two codes name its cell. A half scores at most
q . centre + |q| * radius with a query, where the radius is that of the rows with this code, so the sum of two half bounds caps
every row of a cell. Each query walks the cells from the greatest sum down by a multi-sequence heap over its two sorted
lists of half bounds, and stops where the next sum can't change its answer any more.

The walk is done in rounds, each a join of visited cells with the pieces of the index: (1) a few cells give every
query a score that its positives reach; (2) all cells up to that score give its exact positives, and with them the windows that
negatives must lie in; (3) all cells up to the least score that a window still needs give the negatives. Cells with many rows
are cut into pieces, which are spread over tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from attesta.llm.scratch import materialise

#: The codebooks are fitted on this many rows at most (those of least hash); every row is indexed.
SAMPLE_ROWS = 8192
#: Codes of a half: as many as give cells of about CELL_ROWS rows.
CELL_ROWS, MOST_CODES, FIT_ROUNDS = 256, 256, 8
PIECE_ROWS, PIECES_PER_TASK, CHUNK_QUERIES = 2048, 4, 256
#: Rows of the cells that a query visits first.
SEED_ROWS = 1024

CODED = "key long, label long, cell long, near double, far double, width int, vector binary"
PIECE = "cell long, rows int, width int, ids binary, labels binary, matrix binary"
VISIT = "cell long, salt int, asked binary, ids binary, labels binary, floors binary, ceilings binary, targets binary, width int, matrix binary"
HIT = "query_no long, kind int, target long, key long, score long"
_LEAST = -(1 << 62)
_SEED, _POSITIVES, _NEGATIVES = range(3)


class Codebooks:
    """Centres of both halves, by Lloyd's rounds over the sample."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        self.centres = [self._fit(sample[:, :self.half], codes), self._fit(sample[:, self.half:], codes)]
        self.radius = [np.zeros(len(c)) for c in self.centres]

    @staticmethod
    def _fit(rows: np.ndarray, codes: int) -> np.ndarray:
        distinct = np.unique(rows, axis=0)
        centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(np.int64)].astype(np.float64)
        for _ in range(FIT_ROUNDS):
            code, _ = _nearest(rows, centres)
            size = np.bincount(code, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, code, rows)
            centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        return centres

    def codes(self, rows: np.ndarray):
        """(cell, distance in the first half, in the second)."""
        first, near = _nearest(rows[:, :self.half], self.centres[0])
        second, far = _nearest(rows[:, self.half:], self.centres[1])
        return first * len(self.centres[1]) + second, near, far

    def bounds(self, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: the most and the least that a row of each code scores with the query, a little widened."""
        out = []
        for part, centres, radius in zip((query[:self.half], query[self.half:]), self.centres, self.radius):
            length = math.sqrt(float(part @ part))
            middle, reach = centres @ part, length * radius
            slack = 1e-6 + 1e-9 * (np.abs(middle) + reach + length * np.sqrt((centres * centres).sum(axis=1)))
            out.append((middle + reach + slack, middle - reach - slack))
        return out

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(bound, least score, cell) of every cell, from the greatest bound down: the multi-sequence heap."""
        (most1, least1), (most2, least2) = self.bounds(query)
        order1, order2 = np.argsort(-most1), np.argsort(-most2)
        u, v, width = most1[order1].tolist(), most2[order2].tolist(), len(order2)
        low1, low2 = least1[order1].tolist(), least2[order2].tolist()
        row, column = (order1 * width).tolist(), order2.tolist()
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, low1[i] + low2[j], row[i] + column[j]
            if j + 1 < width:
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.astype(np.float64)
    apart = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)
    code = apart.argmin(axis=1) if len(centres) else np.zeros(len(rows), dtype=np.int64)
    return code, np.sqrt(((rows - centres[code]) ** 2).sum(axis=1))


def _narrow(matrix: np.ndarray) -> np.ndarray:
    reach = int(np.abs(matrix).max(initial=0))
    return matrix.astype(np.int16 if reach < 1 << 15 else np.int32 if reach < 1 << 31 else np.int64)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` numbers, shorter lists filled up with zeros."""
    flat, offsets = np.asarray(lists.values), np.asarray(lists.offsets)
    length = np.diff(offsets)
    out = np.zeros((len(length), dim), dtype=np.int64)
    out[np.arange(dim) < length[:, None]] = flat[offsets[0]:offsets[-1]]
    return out


def _encode(books: Codebooks, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(2), dim)
            cell, near, far = books.codes(rows)
            rows = _narrow(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array(near), pa.array(far),
                 pa.array(np.full(len(rows), rows.itemsize), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                names=["key", "label", "cell", "near", "far", "width", "vector"])
    return run


def _unpack(width: int, data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{width}").reshape(-1, dim)


def _pack():
    """Pieces of at most PIECE_ROWS rows of one cell; rows come sorted by cell."""
    def piece(cell, parts):
        ids, labels, matrix = (np.concatenate(x) for x in zip(*parts))
        return (cell, len(ids), matrix.itemsize, ids.tobytes(), labels.tobytes(), matrix.tobytes())

    def batch_of(rows):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)],
                                          names=["cell", "rows", "width", "ids", "labels", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, label, cell, width = (np.asarray(batch.column(i)) for i in range(4))
            vectors, out = batch.column(4), []
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (width[1:] != width[:-1])) + 1
            for a, b in zip(np.append([0], cuts).tolist(), np.append(cuts, len(cell)).tolist()):
                matrix = np.stack([np.frombuffer(x, dtype=f"<i{width[a]}") for x in vectors[a:b].to_pylist()])
                for at in range(a, b, PIECE_ROWS):
                    to = min(at + PIECE_ROWS, b)
                    if parts and (held != cell[a] or size + to - at > PIECE_ROWS):
                        out.append(piece(held, parts))
                        parts, size = [], 0
                    held = int(cell[a])
                    parts.append((key[at:to], label[at:to], matrix[at - a:to - a]))
                    size += to - at
            if out:
                yield batch_of(out)
        if parts:
            yield batch_of([piece(held, parts)])
    return run


def _route(books: Codebooks, dim: int, rows: dict[int, int], salts: dict[int, int], seed: int | None):
    """Which queries visit which cells: those whose bound reaches the query's floor and whose least score does not pass its
    ceiling; with ``seed`` the first ones that hold so many rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_QUERIES):
                part = batch.slice(at, CHUNK_QUERIES)
                numbers, ids, labels = (np.asarray(part.column(i)) for i in range(3))
                floors, ceilings = (np.array([_LEAST if x is None else x for x in part.column(i).to_pylist()], dtype=np.int64) for i in (3, 4))
                ceilings[ceilings == _LEAST] = -_LEAST
                targets = part.column(5).to_pylist()
                most = max((len(t or []) for t in targets), default=0)
                wanted = np.full((len(ids), most), _LEAST, dtype=np.int64)
                for i, t in enumerate(targets):
                    wanted[i, :len(t or [])] = t or []
                vectors = np.stack([np.frombuffer(x, dtype=f"<i{w}").astype(np.int64) for w, x in
                                    zip(part.column(6).to_pylist(), part.column(7).to_pylist())]).reshape(len(ids), dim)
                visited: dict[int, list[int]] = {}
                for i, query in enumerate(vectors.astype(np.float64)):
                    left = seed
                    for bound, least, cell in books.walk(query):
                        if bound < floors[i] or (left is not None and left <= 0):
                            break
                        if cell not in rows or least > ceilings[i]:
                            continue
                        visited.setdefault(cell, []).append(i)
                        if left is not None:
                            left -= rows[cell]
                out, held = [], 0
                for cell, who in visited.items():
                    asked = _narrow(vectors[who])
                    row = [numbers[who], ids[who], labels[who], floors[who], ceilings[who], wanted[who]]
                    packed = [*(x.astype(np.int64).tobytes() for x in row), asked.itemsize, asked.tobytes()]
                    for salt in range(salts[cell]):
                        out.append((cell, salt, *packed))
                        held += sum(map(len, packed[:-2])) + len(packed[-1])
                        if held >= 1 << 23:
                            yield _visits(out)
                            out, held = [], 0
                if out:
                    yield _visits(out)
    return run


def _visits(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 6 + [pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)],
                                      names=[f.split()[0] for f in VISIT.split(", ")])


def _best(query: np.ndarray, key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: highest score, then least key."""
    order = np.lexsort((key, -score, query))
    first = np.append([True], query[order][1:] != query[order][:-1]) if len(order) else np.zeros(0, dtype=bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def _score(dim: int, stage: int, k: int, low_pct: int):
    def hits(numbers, kind, target, key, score):
        return [numbers, np.full(len(key), kind, dtype=np.int32), target, key, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ids, labels, asked, own, own_label, floors, ceilings, targets = (
                    np.frombuffer(columns[n][i].as_py(), dtype=np.int64) for n in
                    ("ids", "labels", "asked", "q_ids", "q_labels", "floors", "ceilings", "targets"))
                rows = _unpack(columns["width"][i].as_py(), columns["matrix"][i].as_py(), dim)
                queries = _unpack(columns["q_width"][i].as_py(), columns["q_matrix"][i].as_py(), dim).astype(np.int64)
                targets = targets.reshape(len(asked), -1)
                scores = _products(queries, rows)
                other = own[:, None] != ids
                alike = own_label[:, None] == labels
                got = []
                if stage in (_SEED, _POSITIVES):
                    q, r = np.nonzero(other & alike & (scores >= floors[:, None]))
                    s = scores[q, r]
                    best = _best(q, ids[r], s, k)
                    got.append(hits(asked[q[best]], 0, np.zeros(len(best), np.int64), ids[r[best]], s[best]))
                if stage == _POSITIVES:  # negatives below what the positives reach: the last window holds them
                    floor = floors[:, None]
                    q, r = np.nonzero(~alike & (floor > _LEAST) & (scores <= floor) & (scores * 100 >= low_pct * floor) & other)
                    s = scores[q, r]
                    best = _best(q, ids[r], s, k)
                    got.append(hits(asked[q[best]], 1, np.zeros(len(best), np.int64), ids[r[best]], s[best]))
                if stage == _NEGATIVES:
                    q, r = np.nonzero(~alike & other & (scores >= floors[:, None]) & (scores <= ceilings[:, None]))
                    s = scores[q, r]
                    for column in range(targets.shape[1] if len(q) else 0):
                        target = targets[q, column]
                        inside = np.flatnonzero((target >= 0) & (s <= target) & (s * 100 >= low_pct * target))
                        best = inside[_best(q[inside], ids[r[inside]], s[inside], k)]
                        got.append(hits(asked[q[best]], 2, target[best], ids[r[best]], s[best]))
                if any(len(g[0]) for g in got):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)],
                                                     names=["query_no", "kind", "target", "key", "score"])
    return run


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where all sums stay below 2^52, else by 64-bit integers."""
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * max(queries.shape[1], 1)
    if reach < 2.0**52:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T.astype(np.int64)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100,
                   positives: int = 5, negatives: int = 5, scale: int = 256, low_pct: int = 80) -> DataFrame:
    """For each anchor (id divisible by ``every``) and each of its first ``positives`` rows of the same label: the first
    ``negatives`` rows of other labels whose score lies between ``low_pct`` per cent of the positive's and the positive's:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    The score is the inner product of floor(scale * x) with the anchor; higher ones come first, ties by smaller id. Rows
    without an id, with a null label or a null vector, or with a null or non-finite component take no part; shorter vectors are
    filled up with zeros. Rows with an anchor's own id are its own; other repeated rows are candidates each, and a repeated
    anchor is an anchor each. Other columns are ignored; an empty table gives an empty result. Scores are 64-bit integers:
    components must be small enough for them."""
    spark = vectors.sparkSession
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    kind = vectors.schema[label].dataType
    code = F.col(label).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(label)
    rows = vectors.filter(sound).select(F.col(key).cast("long").alias("key"), code.alias("label"), F.transform(
        vector, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    count, widest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    dim = max(2, widest + widest % 2)
    sample = rows.orderBy(F.xxhash64("key", "vector"), "key").limit(SAMPLE_ROWS).select("vector").toArrow().column("vector").combine_chunks()
    codes = int(min(MOST_CODES, max(4, round(math.sqrt(count / CELL_ROWS)))))
    books = Codebooks(_matrix(sample, dim), codes)
    coded = materialise(rows.mapInArrow(_encode(books, dim), CODED), "coded")
    cells = len(books.centres[1])
    for half, of, distance in ((0, F.floor(F.col("cell") / cells), "near"), (1, F.col("cell") % cells, "far")):
        for place, radius in coded.groupBy(of.cast("int")).agg(F.max(distance)).collect():  # a row per code
            books.radius[half][place] = radius * (1 + 1e-9) + 1e-6
    spread = F.xxhash64("key", "vector")
    pieces = materialise(coded.withColumn("spread", spread).repartitionByRange("cell", "spread").sortWithinPartitions("cell", "width")
                         .select("key", "label", "cell", "width", "vector").mapInArrow(_pack(), PIECE), "pieces")
    sizes = pieces.groupBy("cell").agg(F.sum("rows"), F.count("*")).collect()  # a row per cell: MOST_CODES squared at most
    held = {cell: n for cell, n, _ in sizes}
    salts = {cell: -(-n // PIECES_PER_TASK) for cell, _, n in sizes}
    salted = spark.createDataFrame(list(salts.items()), "cell long, salts int")
    index = pieces.join(F.broadcast(salted), "cell").withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int")).drop("salts")
    queries = materialise(coded.filter(F.col("key") % every == 0).select(
        F.monotonically_increasing_id().alias("query_no"), "key", "label", "cell", "width", "vector"), "anchors")

    routes = max(1, -(-queries.count() // CHUNK_QUERIES))

    def visit(asked: DataFrame, stage: int, k: int) -> DataFrame:
        """Visits grow with queries times cells, though Spark sees a few queries only: they are merged, never broadcast."""
        routed = (asked.repartitionByRange(routes, "cell", "query_no").sortWithinPartitions("cell")
                  .select("query_no", "key", "label", "floor", "ceiling", "targets", "width", "vector")
                  .mapInArrow(_route(books, dim, held, salts, SEED_ROWS if stage == _SEED else None), VISIT)
                  .withColumnsRenamed({"ids": "q_ids", "labels": "q_labels", "width": "q_width", "matrix": "q_matrix"}))
        return routed.hint("merge").join(index, ["cell", "salt"]).drop("cell", "salt", "rows").mapInArrow(_score(dim, stage, k, low_pct), HIT)

    def ranked(hits: DataFrame, k: int) -> DataFrame:
        best = W.partitionBy("query_no", "kind", "target").orderBy(F.col("score").desc(), "key")
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    none, open_ = F.lit(None).cast("long"), F.lit(None).cast("array<long>")
    first = ranked(visit(queries.select("*", none.alias("floor"), none.alias("ceiling"), open_.alias("targets")), _SEED, positives), positives)
    reached = first.filter(F.col("rank") == positives).select("query_no", F.col("score").alias("floor"))
    found = materialise(ranked(visit(queries.join(reached, "query_no", "left").select(
        "*", none.alias("ceiling"), open_.alias("targets")), _POSITIVES, max(positives, negatives)), max(positives, negatives)), "found")
    taken = found.filter((F.col("kind") == 0) & (F.col("rank") <= positives) & (F.col("score") >= 0))
    witness = found.filter((F.col("kind") == 1) & (F.col("rank") == negatives)).select("query_no", F.col("score").alias("witness"))
    windows = (taken.groupBy("query_no").agg(F.min("score").alias("least"), F.max("score").alias("ceiling"),
                                             F.sort_array(F.collect_set("score")).alias("targets"))  # of a few positives
               .join(witness, "query_no", "left")
               .select("query_no", "ceiling", "targets", F.greatest(F.expr(f"({low_pct} * least + 99) div 100"), "witness").alias("floor")))
    last = ranked(visit(queries.join(windows, "query_no"), _NEGATIVES, negatives), negatives)
    pairs = taken.select("query_no", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    return (last.select("query_no", F.col("target").alias("positive_score"), "rank", F.col("key").alias("negative_id"),
                        F.col("score").alias("negative_score"))
            .join(pairs, ["query_no", "positive_score"]).join(queries.select("query_no", F.col("key").alias("anchor_id")), "query_no")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
