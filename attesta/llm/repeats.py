"""Windows that occur more than once, over whole corpora: anchors bring equal windows together.

A window of ``window`` symbols is named by its anchor, its least ``gram``-symbol hash. Neighbouring windows that share
an anchor form one segment, so a corpus yields a row per segment, not per window, and equal windows always lie in segments
of one anchor. Equal segments (they share all their windows) are settled by sorting; only distinct segments of one anchor
go on to a resolver, which compares their windows within shards.

Copies don't pile up in a task: of equal segments in one slice of text all but one are settled where they are found, so what
is dealt by anchor holds a copy per slice at most. The distinct segments of anchors with more than ``HOT_ROWS`` of them are
settled window by window in the same way, so shards hold at most that many segments of an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from attesta.llm.columns import Words, gram_hashes, inverse_powers, mix64, powers, slices, sliding_argmin, text_column, tidy
from attesta.llm.scratch import fresh, identity, materialise

Resolver = Callable[[list[np.ndarray], np.ndarray, np.ndarray, int], list[np.ndarray]]
SETTLED = "row_id long, row_hash int, anchor long, body long, place long, role int"
#: Twins: 0 alone in its slice, 1 stands for its equals there, 2 equal to one that does.
SEGMENT = "row_id long, row_hash int, anchor long, body long, place long, twins int"
CUT = "row_id long, row_hash int, anchor long, place long, role int, symbols binary, twins int"
SPAN = "row_id long, row_hash int, first long, past long"
_SPAN_BITS = 16  # place = first window * 2^16 + number of windows
HOT_ROWS = 10_000
#: Roles: 0 repeated, 1 to be compared, 2 stands for repeated ones; 4 more: single windows of an anchor with many rows.
_WINDOWS = 4


def _symbols(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit symbol codes of one slice and the number of the first symbol of each row."""
    if unit == "words":
        words = Words(data, offsets)
        return words.key, words.first
    return data, offsets


def _codes(symbols: np.ndarray) -> np.ndarray:
    return symbols if symbols.dtype == np.uint64 else (symbols.astype(np.uint64) + np.uint64(1))


def _twins(anchor: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each row of a slice: 0 if no other is equal, 1 for the first of several equal ones, 2 for the rest of them."""
    order = np.lexsort((body, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (body[order][1:] == body[order][:-1])
    twins = np.zeros(len(order), dtype=np.int32)
    twins[order[:-1][same]] = 1
    twins[order[1:][same]] = 2
    return twins


def _find_segments(unit: str, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            hashes = np.asarray(batch.column(1))
            for row, _, data, offsets in slices(text_column(batch, "text")):
                symbols, first = _symbols(data, offsets, unit)
                if len(symbols) < window:
                    continue
                codes = _codes(symbols)
                grams = gram_hashes(codes, gram)
                places = sliding_argmin(grams, window - gram + 1)
                per_row = np.maximum(np.diff(first) - window + 1, 0)
                inside = np.zeros(len(symbols) + 1, dtype=np.int8)
                np.add.at(inside, first[:-1][per_row > 0], 1)
                np.add.at(inside, (first[:-1] + per_row)[per_row > 0], -1)
                starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) > 0)
                anchor = places[starts]
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)
                # the first window of a row starts a segment even if it follows the last one of the row before
                new |= np.isin(starts, first[:-1][per_row > 0], assume_unique=True)
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(starts)))
                begin = starts[at]
                past = begin + count + window - 1
                total = np.zeros(len(symbols) + 1, dtype=np.uint64)
                np.cumsum(codes * powers(len(codes)), out=total[1:])
                body = mix64((total[past] - total[begin]) * inverse_powers(len(codes))[begin])
                body ^= mix64(count.astype(np.uint64))
                doc = np.searchsorted(first, begin, side="right") - 1
                named = grams[anchor[at]].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row + doc]), pa.array(hashes[row + doc]), pa.array(named), pa.array(body.view(np.int64)),
                    pa.array(((begin - first[doc]) << _SPAN_BITS) | count), pa.array(_twins(named, body))],
                    names=["row_id", "row_hash", "anchor", "body", "place", "twins"])
    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, body): equal segments, and those that stand for equal ones, are repeated (role 0); a segment
    alone whose anchor has others is to be compared (role 1), and one of several equal ones stands for them there (role 2).
    Holds one row at a time back."""
    held, had_before, had_twin = None, False, False
    names = ["row_id", "row_hash", "anchor", "body", "place"]

    def judged(cols: list[np.ndarray], last: bool):
        nonlocal had_before, had_twin
        anchor, body = cols[2], cols[3]
        same_anchor = np.append(anchor[1:] == anchor[:-1], False)
        same = same_anchor & np.append(body[1:] == body[:-1], False)
        twin_before = np.append([had_twin], same[:-1])
        start = ~twin_before
        anchor_before = np.append([had_before], same_anchor[:-1])
        # of each run: was there another segment of its anchor before it
        run = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
        run_has_before = anchor_before[run]
        if had_twin:  # row 0 goes on with the run of the batch before
            run_has_before[run == 0] = had_before
        end = ~same
        repeated = same | twin_before | (cols[5] > 0)
        others = run_has_before | same_anchor
        role1, role2 = end & ~repeated & others, end & repeated & others
        upto = len(anchor) if last else len(anchor) - 1
        if not last:
            had_before = bool(run_has_before[-1]) if twin_before[-1] else bool(anchor_before[-1])
            had_twin = bool(twin_before[-1])
        take = [np.flatnonzero(x[:upto]) for x in (repeated, role1, role2)]
        at = np.concatenate(take)
        role = np.repeat(np.arange(3, dtype=np.int32), [len(x) for x in take])
        return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols[:5]] + [pa.array(role)], names=[*names, "role"])

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if len(cols[0]) == 0:
            continue
        yield judged(cols, False)
        held = [c[-1:] for c in cols]
    if held is not None:
        yield judged(held, True)


def _cut_out(unit: str, window: int):
    """The asked segments of each text: their bytes, or window by window (the window's hash as anchor)."""
    names = ["row_id", "row_hash", "anchor", "place", "role", "symbols", "twins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("asked"))
            bounds, flat = np.asarray(asked.offsets), asked.values
            anchors, places, roles = (np.asarray(flat.field(i)) for i in range(3))
            ids, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for row, end, data, offsets in slices(text_column(batch, "text")):
                if unit == "words":
                    words = Words(data, offsets)
                    symbols, first, start, past_byte = words.key, words.first, words.start, words.end
                else:
                    symbols, first = data, offsets
                mine = slice(bounds[row], bounds[end])
                doc = np.repeat(np.arange(end - row), np.diff(bounds[row:end + 1]))
                anchor, place, role = anchors[mine], places[mine], roles[mine]
                begin = (place >> _SPAN_BITS) + first[doc]
                count = place & ((1 << _SPAN_BITS) - 1)
                whole = np.flatnonzero(role < _WINDOWS)
                low, high = begin[whole], (begin + count + window - 1)[whole]
                if unit == "words":
                    low, high = start[low], past_byte[high - 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[row + doc[whole]]), pa.array(hashes[row + doc[whole]]), pa.array(anchor[whole]),
                    pa.array(place[whole]), pa.array(role[whole]),
                    pa.array([data[a:b].tobytes() for a, b in zip(low, high)], pa.binary()),
                    pa.array(np.zeros(len(whole), dtype=np.int32))], names=names)
                split = np.flatnonzero(role >= _WINDOWS)
                if len(split):
                    each = np.repeat(split, count[split])
                    step = np.arange(len(each)) - np.repeat(np.cumsum(count[split]) - count[split], count[split])
                    hashed = gram_hashes(_codes(symbols), window)[begin[each] + step]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[row + doc[each]]), pa.array(hashes[row + doc[each]]), pa.array(hashed.view(np.int64)),
                        pa.array((((place[each] >> _SPAN_BITS) + step) << _SPAN_BITS) | 1), pa.array(role[each]),
                        pa.nulls(len(each), pa.binary()), pa.array(_twins(hashed, np.zeros(len(each), dtype=np.int8)))], names=names)
    return run


def _bodies(column: pa.Array, unit: str) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in slices(column, 1 << 22):
        symbols, first = _symbols(data, offsets, unit)
        out += [symbols[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


def _resolve(unit: str, window: int, resolver: Resolver, shard_bytes: int):
    """Shards of whole anchors of about ``shard_bytes`` bytes: spans of the windows that the resolver finds twice."""
    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(parts).combine_chunks()
        role = np.asarray(rows["role"])
        if not (role == 1).any():
            return None
        bodies = _bodies(rows["symbols"].chunk(0).cast(pa.large_binary()), unit)
        marks = resolver(bodies, np.asarray(rows["anchor"]), role == 1, window)
        first, past, at = [], [], []
        begin = np.asarray(rows["place"]) >> _SPAN_BITS
        for i in np.flatnonzero(role == 1):
            hit = np.flatnonzero(np.diff(np.concatenate([[False], marks[i], [False]]).astype(np.int8)))
            for a, b in zip(hit[::2], hit[1::2]):
                first.append(begin[i] + a)
                past.append(begin[i] + b + window - 1)
                at.append(i)
        return pa.RecordBatch.from_arrays([
            pa.array(np.asarray(rows["row_id"])[at]), pa.array(np.asarray(rows["row_hash"])[at]),
            pa.array(first, pa.int64()), pa.array(past, pa.int64())], names=["row_id", "row_hash", "first", "past"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, last = [], 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            anchor = np.asarray(batch.column(batch.schema.get_field_index("anchor")))
            length = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index("symbols"))))
            if held >= shard_bytes and anchor[0] != last:
                if (done := shard(parts)) is not None:
                    yield done
                parts, held = [], 0
            start = at = 0
            for end in np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)):
                held += int(length[at:end].sum())
                at = end
                if held >= shard_bytes and end < len(anchor):
                    if (done := shard([*parts, batch.slice(start, end - start)])) is not None:
                        yield done
                    parts, held, start = [], 0, end
            parts.append(batch.slice(start))
            last = anchor[-1]
        if parts and (done := shard(parts)) is not None:
            yield done

    return run


def repeated_spans(docs: DataFrame, key: str, text: str, unit: str, window: int, gram: int, resolver: Resolver,
                   shard_bytes: int) -> DataFrame:
    """Spans (row_id, row_hash, first, past) of symbols covered by windows that start more than once in ``docs``."""
    named = docs.select(*identity(key, text), F.col(text).alias("text"))
    segments = materialise(named.mapInArrow(tidy(_find_segments(unit, window, gram)), SEGMENT), "segments")

    def by_anchor(rows: DataFrame) -> DataFrame:
        return (rows.filter("twins < 2").repartition("anchor").sortWithinPartitions("anchor", "body")
                .select(*segments.columns).mapInArrow(tidy(_settle), SETTLED)
                .unionByName(rows.filter("twins = 2").drop("twins").withColumn("role", F.lit(0))))

    settled = materialise(by_anchor(segments), "settled")
    distinct = settled.filter("role > 0")
    hot = materialise(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS), "hot")
    role = F.col("role") + F.when(F.col("n").isNull(), 0).otherwise(_WINDOWS)
    asked = (distinct.join(hot, "anchor", "left").withColumn("role", role).groupBy("row_id", "row_hash")
             .agg(F.collect_list(F.struct("anchor", "place", "role")).alias("asked")))
    bodies = materialise(
        asked.join(named, ["row_id", "row_hash"]).select("row_id", "row_hash", "text", "asked").mapInArrow(
            tidy(_cut_out(unit, window)), CUT), "bodies")
    place = F.col("place")
    begin = F.shiftright(place, _SPAN_BITS)
    past = begin + place.bitwiseAND((1 << _SPAN_BITS) - 1) + F.lit(window - 1)
    span = ["row_id", "row_hash", begin.alias("first"), past.alias("past")]
    found = (bodies.filter(F.col("role") < _WINDOWS).repartition("anchor").sortWithinPartitions("anchor")
             .drop("twins").mapInArrow(tidy(_resolve(unit, window, resolver, shard_bytes)), SPAN))
    windows = by_anchor(bodies.filter(F.col("role") >= _WINDOWS).withColumn("body", F.lit(0).cast("long")).select(*segments.columns))
    return settled.unionByName(windows).filter("role = 0").select(*span).unionByName(found)


def with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with the spans of each row (null: none) as its last column."""
    row_id, row_hash, last = fresh(docs, "row_id", "row_hash", "spans")
    by_row = spans.groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("first", "past")).alias(last))\
        .withColumnsRenamed({"row_id": row_id, "row_hash": row_hash})
    named = docs.withColumns(dict(zip((row_id, row_hash), identity(key, text))))
    return named.join(by_row, [row_id, row_hash], "left").select(*docs.columns, last)


def schema_with(rows: DataFrame, added: dict[str, str]) -> T.StructType:
    """The columns of ``rows`` but its last one, and those ``added``."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields[:-1]])
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return schema


def covered(n: int, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Which of n symbols the spans cover."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, past, -1)
    return np.cumsum(change[:-1]) > 0
