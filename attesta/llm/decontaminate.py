"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

A document leaks an item if some run of its words is within ``floor((1 - similarity) * n)`` word edits of the item's n
words. Windows of an item's size are embedded by CGK random walks: a pointer moves along the window and steps on or stays
as a shared random bit of (step, word) says, so that few edits become few differing coordinates. Tables sample coordinates;
a window that agrees with an item in one table is a candidate, and candidates are verified by exact edit distance.

Windows are taken where they can match at all: an item within d edits keeps an unedited run of ceil((n - d) / (d + 1))
words (and n - q + 1 - q d of its runs of q words), so only windows around runs shared with items of their size are
embedded. Items are taken in blocks of bounded
bytes, each broadcast against one pass over the documents; the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.columns import Words, gram_hashes, mix64, slices, text_column, tidy
from attesta.llm.scratch import fresh, identity, materialise

SIMILARITY = 0.8
BLOCK_BYTES = 1 << 22
WALKS, TABLES, SAMPLED = 4, 16, 3
RUN_WORDS = 4
KNOWN_BITS = 20
#: Embedded coordinates and cells of edit distances held at a time.
CELLS = 1 << 20
MATCH = "id long, item_id long, edit_distance int, first_word long, item_words int"

_FAR = 1 << 36
_PAD = np.uint64(0x5851F42D4C957F2D)


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Word keys of some texts (letters and digits; A-Z lower-cased, other ASCII separates)."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in slices(pa.array(texts, pa.string()).cast(pa.large_binary())):
        words = Words(data, offsets, fold_case=True, alnum=True)
        out += [words.key[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    return out


def embed(rows: np.ndarray, seed: int) -> np.ndarray:
    """The CGK embedding of rows of n words: 3n coordinates each (column j is coordinate j)."""
    count, n = rows.shape
    padded = np.concatenate([rows, np.full((count, 1), _PAD)], axis=1)
    at, out = np.zeros(count, dtype=np.int64), np.empty((count, 3 * n), dtype=np.uint64)
    every, salts = np.arange(count), mix64(np.arange(1, 3 * n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    for j in range(3 * n):
        word = padded[every, at]
        out[:, j] = word
        bit = mix64(word ^ salts[j]) >> np.uint64(63)
        at = np.minimum(at + bit.astype(np.int64), n)
    return out


def table_keys(rows: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket of each row in each table of each walk."""
    n = rows.shape[1]
    for walk in range(WALKS):
        embedded = embed(rows, walk + 1)
        rng = np.random.default_rng(1_000 * n + walk)
        for _ in range(TABLES):
            key = np.zeros(len(rows), dtype=np.uint64)
            for j in rng.integers(0, 3 * n, SAMPLED):
                key = mix64(key ^ embedded[:, j]) + np.uint64(j)
            yield key


def edit_distance(items: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits from each item (row of n words) to any run within its span (row of m words), and the run's end."""
    cost = np.zeros((len(items), spans.shape[1] + 1), dtype=np.int32)  # a run may begin anywhere
    place = np.arange(spans.shape[1] + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        step = np.empty_like(cost)
        step[:, 0] = i + 1
        step[:, 1:] = np.minimum(cost[:, :-1] + (spans != items[:, i:i + 1]), cost[:, 1:] + 1)
        # insertions along the row: least of (cost - place) so far
        cost = np.minimum.accumulate(step - place, axis=1) + place
    end = np.argmin(cost, axis=1)
    return cost[np.arange(len(cost)), end], end


class Items:
    """A block of items, grouped by their number of words, with the tables of each group."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float):
        self.groups = []
        words = item_words(texts)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w):
                by_size.setdefault(len(w), []).append(i)
        for n, members in sorted(by_size.items()):
            rows = np.stack([words[i] for i in members])
            edits = int(np.floor((1 - similarity) * n + 1e-9))
            run = min(RUN_WORDS, max(1, -(-(n - edits) // (edits + 1))))
            runs, places = [], []
            for row in rows:
                runs.append(gram_hashes(row, run))
                places.append(np.arange(n - run + 1))
            pairs = np.unique(np.stack([np.concatenate(runs), np.concatenate(places).astype(np.uint64)], axis=1), axis=0)
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            tables = []
            for key in table_keys(rows):
                by_key = np.argsort(key, kind="stable")
                tables.append((key[by_key], by_key))
            self.groups.append({"n": n, "edits": edits, "run": run, "rows": rows, "ids": np.array([ids[i] for i in members]),
                                "seed": pairs[order, 0], "place": pairs[order, 1].astype(np.int64), "tables": tables})
        # most words of a corpus are in no item's run: a bit per upper hash bits passes over them
        self.known = {g["run"]: np.zeros(1 << KNOWN_BITS, dtype=bool) for g in self.groups}
        for g in self.groups:
            self.known[g["run"]][g["seed"] >> np.uint64(64 - KNOWN_BITS)] = True

    def matches(self, key: np.ndarray, first: np.ndarray):
        """(document, item id, edits, first word, item's words) over the words of some documents."""
        seen = {}
        for run, known in self.known.items():
            grams = gram_hashes(key, run)
            may = np.flatnonzero(known[grams >> np.uint64(64 - KNOWN_BITS)])
            seen[run] = may, grams[may]
        found = []
        for g in self.groups:
            n, edits = g["n"], g["edits"]
            at, grams = seen[g["run"]]
            low, high = np.searchsorted(g["seed"], grams), np.searchsorted(g["seed"], grams, side="right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            at, low, times = at[hit], low[hit], (high - low)[hit]
            place = g["place"][np.repeat(low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
            doc = np.repeat(np.searchsorted(first, at, side="right") - 1, times)
            begin, end = first[doc], first[doc + 1]
            start = np.repeat(at, times) - place
            inside = (np.repeat(at, times) + g["run"] <= end) & (end - begin >= n - edits)
            doc, start = doc[inside], np.maximum(start, begin - edits)[inside]
            # d edits leave n - q + 1 - q d of an item's q-word runs, all starting within d places of its start
            along = np.sort(doc * _FAR + start)
            beside = np.searchsorted(along, along + 2 * edits, side="right") - np.searchsorted(along, along - 2 * edits)
            along = np.unique(along[beside >= n - g["run"] + 1 - g["run"] * edits])
            window = np.stack([(along + _FAR // 2) // _FAR, (along + _FAR // 2) % _FAR - _FAR // 2], axis=1)
            step = max(1, CELLS // (3 * n * (2 * edits + 1)))
            for i in range(0, len(window), step):
                found += self._verified(g, key, first, window[i:i + step])
        return found

    def _verified(self, g: dict, key: np.ndarray, first: np.ndarray, window: np.ndarray):
        n, edits = g["n"], g["edits"]
        doc, start = window[:, 0], window[:, 1]
        shift = np.arange(-edits, edits + 1)
        doc = np.repeat(doc, len(shift))
        start = (start[:, None] + shift).ravel()
        lo, hi = first[doc], first[doc + 1]
        start = np.maximum(np.minimum(start, hi - n), np.minimum(lo, hi - n))
        both = np.unique(np.stack([doc, start], axis=1), axis=0)
        doc, start = both[:, 0], both[:, 1]

        def taken(start, doc, length):  # words outside the document match nothing
            at = start[:, None] + np.arange(length)
            inside = (at >= first[doc][:, None]) & (at < first[doc + 1][:, None])
            return np.where(inside, key[np.clip(at, 0, len(key) - 1)], _PAD)

        pairs = []
        for (keys, order), mine in zip(g["tables"], table_keys(taken(start, doc, n))):
            low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            hit = np.flatnonzero(high > low)
            times = (high - low)[hit]
            item = order[np.repeat(low[hit], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
            pairs.append(np.stack([np.repeat(hit, times), item], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        out = []
        step = max(1, CELLS // (n + 2 * edits))
        for i in range(0, len(pairs), step):
            row, item = pairs[i:i + step].T
            begin = start[row] - edits
            cost, end = edit_distance(g["rows"][item], taken(begin, doc[row], n + 2 * edits))
            good = np.flatnonzero(cost <= edits)
            first_word = np.maximum(begin + end - n, first[doc[row]]) - first[doc[row]]
            out.append((doc[row][good], g["ids"][item[good]], cost[good], first_word[good], np.full(len(good), n)))
        return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for row, _, data, offsets in slices(text_column(batch, "text")):
                words = Words(data, offsets, fold_case=True, alnum=True)
                found = shared.value.matches(words.key, words.first)
                if found:
                    doc, item, cost, first, n = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[row + doc]), pa.array(item.astype(np.int64)), pa.array(cost.astype(np.int32)),
                        pa.array(first.astype(np.int64)), pa.array(n.astype(np.int32))],
                        names=["id", "item_id", "edit_distance", "first_word", "item_words"])
    return run


def item_blocks(benchmark: DataFrame, item_key: str, item_text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of about ``block_bytes`` of text; one block at a time is on the driver."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(item_key).cast("long"), item_text).filter(f"`{item_key}` is not null and `{item_text}` is not null")
    for item_id, text in rows.toLocalIterator():
        ids.append(item_id)
        texts.append(text)
        held += len(text)
        if held >= block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it leaks: ids, ``edit_distance`` (least found, in words), ``first_word`` (where that
    run ends less the item's length, at least 0) and ``item_words``. Null ids and texts, and texts or items without words,
    leak nothing; repeated rows of one id count once."""
    spark = docs.sparkSession
    named = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    parts = []
    for ids, texts in item_blocks(benchmark, item_key, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(Items(ids, texts, similarity))
        parts.append(materialise(named.mapInArrow(tidy(_scan(shared)), MATCH), "leaks"))
    found = spark.createDataFrame([], MATCH)
    for part in parts:
        found = found.unionByName(part)
    best = F.min(F.struct("edit_distance", "first_word", "item_words"))
    return found.groupBy("id", "item_id").agg(best.alias("best")).select(F.col("id").alias(key), "item_id", "best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` less those that leak an item. Rows are told apart by ``scratch.identity``: one without an id goes by its text."""
    row_id, row_hash, row = fresh(docs, "row_id", "row_hash", "row")
    named = docs.withColumns(dict(zip((row_id, row_hash), identity(key, text))))
    one = F.xxhash64(row_id, row_hash)
    found = leaks(named.select(one.alias(row), F.col(text)), benchmark, row, text, **options).select(row).distinct()
    return named.withColumn(row, one).join(found, row, "left_anti").select(*docs.columns)
