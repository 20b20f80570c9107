"""Suffix-array dedup: suffixes sorted by hash comparison.

``repeats`` deals the candidate segments of a corpus to shards by anchor. A shard's suffixes (one per window start) are
merge-sorted: two suffixes are compared by the length of their common extension, found by binary search over prefix
polynomial hashes, and by the byte after it; equal neighbours are then compared byte by byte, so a collision can't mark
anything. Equal windows hold their anchor at the same place, so suffixes are sorted within (anchor, place of the anchor),
all of these arrays in step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.columns import BYTE_CODES, gram_hashes, inverse_powers, powers, sliding_argmin, text_column, tidy
from attesta.llm.repeats import covered, repeated_spans, schema_with, with_spans

GRAM = 64
SHARD_BYTES = 1 << 21
COMPARE_ROWS = 1 << 16


class Extensions:
    """Common extensions of suffixes of ``text`` up to ``limit`` symbols, by prefix hashes."""

    def __init__(self, text: np.ndarray, limit: int):
        self.text, self.limit = text, limit
        self.total = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[text] * powers(len(text)), out=self.total[1:])
        self.unpower = inverse_powers(len(text))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, by binary search."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.limit)
        ta, tb, ua, ub = self.total[a], self.total[b], self.unpower[a], self.unpower[b]
        for _ in range(int(self.limit).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.total[a + mid] - ta) * ua == (self.total[b + mid] - tb) * ub
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffix at a comes before that at b (by their first ``limit`` symbols)."""
        n = self.common(a, b)
        end = len(self.text) - 1
        return (n < self.limit) & (self.text[np.minimum(a + n, end)] < self.text[np.minimum(b + n, end)])

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first ``limit`` symbols are equal, symbol by symbol."""
        out = np.empty(len(a), dtype=bool)
        views = np.lib.stride_tricks.sliding_window_view(self.text, self.limit)
        for i in range(0, len(a), COMPARE_ROWS // 16):
            part = slice(i, i + COMPARE_ROWS // 16)
            out[part] = (views[a[part]] == views[b[part]]).all(axis=1)
        return out


def merge_sort(places: np.ndarray, group: np.ndarray, extensions: Extensions) -> np.ndarray:
    """``places`` sorted as suffixes within each group (groups are adjacent): bottom-up merges, where each suffix finds
    its rank in the run beside its own by binary search."""
    begin = np.flatnonzero(np.append([True], group[1:] != group[:-1]))
    size = np.diff(np.append(begin, len(group)))
    base = np.repeat(begin, size)
    limit = base + np.repeat(size, size)
    at = np.arange(len(places))
    width = 1
    while width < size.max(initial=1):
        run = (at - base) // width
        left = run % 2 == 0
        other = base + np.where(left, run + 1, run - 1) * width  # the run beside
        other_end = np.minimum(other + width, limit)
        busy = np.flatnonzero(other < limit)
        new = at.copy()
        for i in range(0, len(busy), COMPARE_ROWS):
            mine = busy[i:i + COMPARE_ROWS]
            low, high, is_left = other[mine], other_end[mine], left[mine]
            while (open_ := low < high).any():
                mid = np.where(open_, (low + high) >> 1, low)
                probe = places[np.minimum(mid, len(places) - 1)]
                own = places[mine]
                # left elements count those strictly before them, right ones also their equals
                first, second = np.where(is_left, probe, own), np.where(is_left, own, probe)
                before = extensions.less(first, second)
                go_right = np.where(is_left, before, ~before) & open_
                high = np.where(open_ & ~go_right, mid, high)
                low = np.where(go_right, mid + 1, low)
            start = np.minimum(base[mine] + run[mine] * width, other[mine])
            own_rank = mine - (base[mine] + run[mine] * width)
            new[mine] = start + own_rank + low - other[mine]
        sorted_places = np.empty_like(places)
        sorted_places[new] = places
        places = sorted_places
        width *= 2
    return places


def repeated_windows(bodies: list[np.ndarray], anchors: np.ndarray, asked: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice in the shard."""
    length = np.array([len(b) for b in bodies])
    begin = np.cumsum(length) - length
    text = np.concatenate(bodies)
    windows = length - window + 1
    places = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(begin, windows)
    # where the anchor lies in the segment: the least gram of its windows
    gram = min(GRAM, window)
    least = sliding_argmin(gram_hashes(text.astype(np.uint64) + np.uint64(1), gram), window - gram + 1)
    offset = least[places] - places
    _, anchor = np.unique(anchors, return_inverse=True)
    group = np.repeat(anchor, windows) * window + offset
    order = np.argsort(group, kind="stable")
    places, group = places[order], group[order]
    alone = np.append([True], group[1:] != group[:-1]) & np.append(group[1:] != group[:-1], [True])
    places, group = places[~alone], group[~alone]
    marks = np.zeros(len(text), dtype=bool)
    if len(places):
        extensions = Extensions(text, window)
        places = merge_sort(places, group, extensions)
        beside = np.flatnonzero(group[1:] == group[:-1])
        equal = beside[extensions.common(places[beside], places[beside + 1]) == window]
        equal = equal[extensions.verified(places[equal], places[equal + 1])]
        marks[places[equal]] = True
        marks[places[equal + 1]] = True
    return [marks[b:b + n] for b, n in zip(begin, windows)]


def repeated_byte_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 400) -> DataFrame:
    """Spans (row_id, row_hash, first, past) of bytes covered by a string of ``window`` bytes that starts anywhere else."""
    return repeated_spans(docs, key, text, "bytes", window, min(GRAM, window), repeated_windows, SHARD_BYTES)


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 400) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (the remaining bytes) and
    ``kept_sha256``; columns of these names are replaced. A null text is empty; a repeated row is one more document."""
    added = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary", "kept_sha256": "string"}
    spans = repeated_byte_spans(docs, key, text, window)
    rows = with_spans(docs.drop(*(c for c in docs.columns if c.lower() in added)), spans, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in added}
            removals = batch.column(batch.num_columns - 1).to_pylist()
            for value, gone_spans in zip(text_column(batch, text).to_pylist(), removals):
                value = value or b""
                kept, runs = value, 0
                if gone_spans:
                    gone = covered(len(value), np.array([s["first"] for s in gone_spans]), np.array([s["past"] for s in gone_spans]))
                    kept = np.frombuffer(value, dtype=np.uint8)[~gone].tobytes()
                    runs = int((np.diff(np.append([False], gone).astype(np.int8)) == 1).sum())
                for name, got in zip(out, (len(value), len(value) - len(kept), runs, kept, hashlib.sha256(kept).hexdigest())):
                    out[name].append(got)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())))],
                names=[*batch.schema.names[:-1], *out])

    return rows.mapInArrow(tidy(run), schema_with(rows, added))
