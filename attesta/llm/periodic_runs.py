"""Periodic runs of words: tiles per octave of the period, solved by themselves, stitched per document and period.

A run of period q is a stretch of words that equal the word q places on, four periods long at least. Periods from 2^o up to
2^(o+1) form octave o. Every document is cut into overlapping tiles, whose length follows the octave (low octaves share
one length). A document of one tile is solved where it is cut; the tiles of longer ones go to tasks by hash, so a long document
is not one task's work. In a tile, boundaries stand 2 * 2^o words apart: each stretch long enough holds one that has 2^o further
words of it behind it. There, for each period of the octave, the Z-function gives how far the words from the boundary on agree with
those one period later, and the reversed one how far the words before it do. Fragments of the same document and period meet in a
shuffle, where those that touch become one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from attesta.llm.columns import gram_hashes, inverse_powers, mix64, powers
from attesta.llm.repeats import covered, schema_with
from attesta.llm.scratch import fresh, identity, materialise

#: Words of the tiles that the low octaves share (periods up to a sixteenth of it).
TILE_WORDS = 1 << 15
#: Bytes of a text that are split into words at once.
PIECE_BYTES = 1 << 20
#: Words of the tiles that a task solves at once.
BATCH_WORDS = 1 << 19
LEAST_LENGTH, LEAST_PERIODS = 6, 4
TILE = "base long, low int, high int, ids binary"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
FRAGMENT = "row_id long, row_hash int, period long, first long, past long"
FRAGMENT_NAMES = ["row_id", "row_hash", "period", "first", "past"]


def altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each of n places of a document that is made periodic, or None if it is not."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def numbered(text: bytes, doc_id: int | None, alter: bool) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, equal words alike, and the words that the numbers stand for."""
    number: dict[bytes, int] = {}
    parts, at = [np.zeros(0, dtype=np.int32)], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE_BYTES)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()  # of bytes: at 0x20 and 0x09-0x0D
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)))
        at = end
    ids = np.concatenate(parts)
    place = altered(doc_id, len(ids)) if alter else None
    return (ids if place is None else ids[place]), list(number)


def tiles_of(n: int, tile_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(lowest octave, octave behind the highest, first word, word behind the last) of the tiles of n words. Neighbours
    overlap by four of the longest periods, so a stretch that one of them cuts too short is whole in the other."""
    longest = n // LEAST_PERIODS
    low, top = 0, max(longest, 0).bit_length()
    while low < top:
        high = low + 1 if low else max(1, (tile_words // 16).bit_length() - 1)
        high = min(high, top)
        length = max(tile_words, 32 << (high - 1)) if low == 0 else 32 << low
        step = length - (LEAST_PERIODS << high)
        at = 0
        while True:
            yield low, high, at, min(at + length, n)
            if at + length >= n:
                break
            at += step
        low = high


def _cut(alter: bool, tile_words: int):
    """Tiles of texts: documents of one tile are solved at once (rows with a period), tiles of longer ones go on as they are
    (rows with numbers of words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, away, held = Held(), [], 0
        for batch in batches:
            texts, keys = batch.column(3), batch.column(2)
            for i in range(batch.num_rows):
                if not texts[i].is_valid:
                    continue
                ids, _ = numbered(texts[i].as_py(), keys[i].as_py(), alter)
                name = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                tiles = list(tiles_of(len(ids), tile_words))
                if len(tiles) == 1:
                    yield from here.add((*name, 0), *tiles[0][:2], ids)
                    continue
                for low, high, first, past in tiles:
                    away.append((*name, None, None, None, first, low, high, ids[first:past].tobytes()))
                    held += past - first
                    if held >= BATCH_WORDS:
                        yield _rows(away)
                        away, held = [], 0
        if away:
            yield _rows(away)
        yield from here.rest()
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _TILE_SCHEMA.types)], schema=_TILE_SCHEMA)


_TILE_SCHEMA = pa.schema([("row_id", pa.int64()), ("row_hash", pa.int32()), ("period", pa.int64()), ("first", pa.int64()),
                          ("past", pa.int64()), ("base", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("ids", pa.binary())])


class Held:
    """Tiles that wait to be solved together, by their octaves."""

    def __init__(self):
        self.tiles: dict[tuple[int, int], tuple[list, list]] = {}
        self.words: dict[tuple[int, int], int] = {}

    def add(self, name: tuple, low: int, high: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, parts = self.tiles.setdefault((low, high), ([], []))
        names.append(name)
        parts.append(ids)
        self.words[(low, high)] = self.words.get((low, high), 0) + len(ids)
        if sum(self.words.values()) >= BATCH_WORDS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for octaves, (names, parts) in self.tiles.items():
            length = np.array([len(p) for p in parts])
            start = np.cumsum(length + 1) - length - 1
            symbols = np.empty(int(length.sum()) + len(parts), dtype=np.int64)
            for no, (at, part) in enumerate(zip(start, parts)):
                symbols[at:at + len(part)] = part
                symbols[at + len(part)] = -1 - no  # equals nothing else
            period, first, past = solve(symbols, *octaves)
            if not len(period):
                continue
            tile = np.searchsorted(start, first, side="right") - 1
            row_id, row_hash, base = (np.array(x) for x in zip(*names))
            shift = base[tile] - start[tile]
            found = [row_id[tile], row_hash[tile], period, first + shift, past + shift]
            columns = [pa.array(c, type=t) for c, t in zip(found, _TILE_SCHEMA.types)]
            columns += [pa.nulls(len(tile), t) for t in _TILE_SCHEMA.types[5:]]
            yield pa.RecordBatch.from_arrays(columns, schema=_TILE_SCHEMA)
        self.tiles, self.words = {}, {}


class BoundaryZ:
    """Values of the boundary Z-functions of one string, many at a time: how far the symbols from two places on agree, or
    those before them, by prefix hashes and steps that halve."""

    def __init__(self, symbols: np.ndarray):
        self.symbols = symbols
        code = mix64(symbols.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.total = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(code * powers(len(code)), out=self.total[1:])
        self.inverse = inverse_powers(len(code) + 1)
        self.code = code

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Do the ``length`` symbols from a and from b on agree (by their hashes)?"""
        return ((self.total[a + length] - self.total[a]) * self.inverse[a]
                == (self.total[b + length] - self.total[b]) * self.inverse[b])

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from a and b (a < b) on agree, up to ``most``."""
        most = np.minimum(most, len(self.symbols) - b)
        got = np.zeros(len(a), dtype=np.int64)
        step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step:
            fits = got + step <= most
            fits[fits] = self.same(a[fits] + got[fits], b[fits] + got[fits], np.int64(step))
            got[fits] += step
            step >>= 1
        return got

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols before a and b (a < b) agree, up to ``most``."""
        most = np.minimum(most, a)
        got = np.zeros(len(a), dtype=np.int64)
        step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step:
            fits = got + step <= most
            start = got[fits] + step
            fits[fits] = self.same(a[fits] - start, b[fits] - start, np.int64(step))
            got[fits] += step
            step >>= 1
        return got


def primitive(z: BoundaryZ, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Is the word of ``period`` symbols at each place no power of a shorter one?"""
    out, rest, factor = np.ones(len(at), dtype=bool), period.copy(), 2
    while len(rest) and factor * factor <= int(rest.max()):
        divides = rest % factor == 0
        if divides.any():
            part = period[divides] // factor
            out[divides] &= ~z.same(at[divides], at[divides] + part, period[divides] - part)
            while divides.any():
                rest[divides] //= factor
                divides = rest % factor == 0
        factor += 1
    left = rest > 1
    part = period[left] // rest[left]
    out[left] &= ~z.same(at[left], at[left] + part, period[left] - part)
    return out


def solve(symbols: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first, past) of the stretches of at least three periods in which a symbol equals the one a period later,
    for periods of the octaves from ``low`` to below ``high`` that are no multiple of a shorter period of the stretch;
    ``past`` is behind the last such symbol."""
    z = BoundaryZ(symbols)
    found = []
    for octave in range(low, high):
        q0 = 1 << octave
        apart, size = 2 * q0, min(q0, 8)
        grams = gram_hashes(z.code, size)
        if len(grams) <= q0:
            break
        padded = np.concatenate([grams, np.zeros(-len(grams) % apart, dtype=np.uint64)]).reshape(-1, apart)
        row, column = np.nonzero(padded[:, q0:] == padded[:, :1])
        at, period = row * apart, column + q0
        real = at + period < len(grams)
        at, period = at[real], period[real]
        on = z.ahead(at, at + period, np.full(len(at), 3 * q0))
        holds = on >= q0
        at, period, on = at[holds], period[holds], on[holds]
        holds = primitive(z, at, period)
        at, period, on = at[holds], period[holds], on[holds]
        back = z.behind(at, at + period, np.full(len(at), apart))
        found.append((period, at - back, at + on))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    period, first, past = joined(*(np.concatenate(x) for x in zip(*found)))
    long_enough = past - first >= (LEAST_PERIODS - 1) * period
    return verified(symbols, period[long_enough], first[long_enough], past[long_enough])


def joined(period: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that touch or overlap as one."""
    order = np.lexsort((first, period))
    period, first, past = period[order], first[order], past[order]
    if not len(period):
        return period, first, past
    shift = (np.cumsum(np.append([0], period[1:] != period[:-1]))) * (int(past.max()) + 1)  # a range of numbers per period
    reach = np.maximum.accumulate(past + shift)
    new = np.append([True], first[1:] + shift[1:] > reach[:-1])
    start = np.flatnonzero(new)
    return period[start], first[start], (reach - shift)[np.append(start[1:], len(period)) - 1]


def verified(symbols: np.ndarray, period: np.ndarray, first: np.ndarray, past: np.ndarray):
    """The stretches, symbol by symbol: one that hashes alone made too long is cut where its symbols differ."""
    out = []
    for q, a, b in zip(period.tolist(), first.tolist(), past.tolist()):
        differ = np.flatnonzero(symbols[a:b] != symbols[a + q:b + q])
        if not len(differ):
            out.append((q, a, b))
            continue
        cuts = np.concatenate([[-1], differ, [b - a]])
        out += [(q, a + int(i) + 1, a + int(j)) for i, j in zip(cuts[:-1], cuts[1:]) if j - i - 1 >= (LEAST_PERIODS - 1) * q]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = Held()
    for batch in batches:
        for i in range(batch.num_rows):
            row_id, row_hash, base, low, high = (batch.column(j)[i].as_py() for j in range(5))
            ids = np.frombuffer(batch.column(5)[i].as_py(), dtype=np.int32)
            for out in held.add((row_id, row_hash, base), low, high, ids):
                yield out.select(FRAGMENT_NAMES)
    for out in held.rest():
        yield out.select(FRAGMENT_NAMES)


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", alter: bool = False,
              tile_words: int = TILE_WORDS) -> DataFrame:
    """(row_id, row_hash, start, length, period) of every run of every text."""
    named = docs.select(*identity(key, text), F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    cut = materialise(named.mapInArrow(_cut(alter, tile_words), FRAGMENT + ", " + TILE), "tiles")
    away = cut.filter("ids IS NOT NULL").select("row_id", "row_hash", "base", "low", "high", "ids")
    spread = away.repartition("row_id", "row_hash", "low", "base").mapInArrow(_solve, FRAGMENT)
    fragments = cut.filter("ids IS NULL").select(*FRAGMENT_NAMES).unionByName(spread)
    near = W.partitionBy("row_id", "row_hash", "period").orderBy("first", "past")
    before = near.rowsBetween(W.unboundedPreceding, -1)
    begins = F.coalesce(F.col("first") > F.max("past").over(before), F.lit(True))
    whole = (fragments.withColumn("begins", begins.cast("long")).withColumn("no", F.sum("begins").over(near))
             .groupBy("row_id", "row_hash", "period", "no").agg(F.min("first").alias("start"), F.max("past").alias("past")))
    length = F.col("past") - F.col("start") + F.col("period")
    return (whole.select("row_id", "row_hash", "start", length.alias("length"), "period")
            .filter((F.col("length") >= LEAST_LENGTH) & (F.col("length") >= LEAST_PERIODS * F.col("period"))))


def digest(ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period and exponent_milli of the greatest run, the digest of all runs, the kept words;
    ``runs`` by start, then period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    if runs:
        start, length, period = (np.array(x) for x in zip(*runs))
        ids = ids[~covered(len(ids), start + period, start + length)]
    milli = None if best is None else 1000 * best[1] // best[2]
    kept = b" ".join([words[i] for i in ids.tolist()])
    return (len(runs), *(best or (None, None, None)), milli, hashlib.sha256(listed.encode()).hexdigest(), kept)


RESULT = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string",
          "collapsed_sha256": "string", "collapsed_text": "string"}


def _collapse(names: list[str], key: str, text: str, alter: bool, with_text: bool):
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + ([pa.large_string()] if with_text else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = (batch.column(batch.schema.get_field_index(x)) for x in (key, text))
            runs = batch.column(batch.num_columns - 1)
            out = []
            for i in range(batch.num_rows):
                body = texts[i].as_py()
                body = body.encode() if isinstance(body, str) else body
                found = sorted(((r["start"], r["length"], r["period"]) for r in runs[i].as_py() or []), key=lambda r: (r[0], r[2]))
                row = digest(*numbered(body or b"", keys[i].as_py(), alter), found)
                collapsed = hashlib.sha256(row[-1]).hexdigest()
                out.append((*row[:-1], collapsed, *([row[-1].decode()] if with_text else [])))
            columns = [pa.array(c, type=k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], type=k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)
    return run


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", alter: bool = False, tile_words: int = TILE_WORDS,
                  with_text: bool = True) -> DataFrame:
    """``docs`` with, per row, ``n_runs``, the run of greatest length / period (``start, length, period, exponent_milli``,
    null without a run), ``runs_sha256`` over all runs, ``collapsed_sha256`` and (``with_text``) ``collapsed_text``: the words
    without the repeats that runs hold, each run's first period staying.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; a null or empty text has none and no run. ``alter`` first
    makes one document in ten periodic by its id (rows without an id stay as they are). Rows that agree in id and text get the
    same result each. Columns of ``docs`` whose names clash with those added are kept under their names, the added ones get a
    leading underscore; an empty table gives an empty result."""
    row_id, row_hash, last = fresh(docs, "row_id", "row_hash", "runs")
    runs = (find_runs(docs, key, text, alter, tile_words).groupBy("row_id", "row_hash")
            .agg(F.collect_list(F.struct("start", "length", "period")).alias(last))
            .withColumnsRenamed({"row_id": row_id, "row_hash": row_hash}))
    named = docs.withColumns(dict(zip((row_id, row_hash), identity(key, text))))
    rows = named.join(runs.hint("merge"), [row_id, row_hash], "left").select(*docs.columns, last)  # runs grow with the texts
    added = [c for c in RESULT if with_text or c != "collapsed_text"]
    names = fresh(docs, *added)
    schema = schema_with(rows, {n: RESULT[c] for n, c in zip(names, added)})
    return rows.mapInArrow(_collapse([*docs.columns, *names], key, text, alter, with_text), schema)
