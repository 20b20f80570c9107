"""Substring dedup: an FM-index per shard, searched backwards for every window that may repeat.

``repeats`` deals the candidate segments of a corpus to shards by anchor. A shard's segments become one text over a dense
alphabet; its index is the Burrows-Wheeler transform as a wavelet matrix (one packed bit vector with rank counts per bit
of the alphabet). Segments are streamed through it right to left, all in step: each keeps the interval of the longest
repeated match that ends at its current place (matching statistics) and reports windows whose interval holds two rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.columns import text_column, tidy
from attesta.llm.repeats import covered, repeated_spans, schema_with, with_spans

GRAM = 8
SHARD_BYTES = 1 << 22


class WaveletMatrix:
    """A sequence of symbols below 2^bits with rank queries in one step per bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int32)
            before = np.cumsum(ones, dtype=np.int32) - ones
            zeros = len(symbols) - int(ones.sum())
            self.levels.append((level, words, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.bottom = symbols

    def descend(self, places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The bottom place that stands for 'rank of the symbol before the place'."""
        for level, words, before, zeros in self.levels:
            word = places >> 6
            low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & low)
            places = np.where((symbols >> level) & 1, zeros + ones, places - ones)
        return places


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` ordered by the ``depth`` symbols from each on (prefix doubling, ties by place)."""
    rank, width = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append([False], ordered[1:] != ordered[:-1]))
        if width >= depth or rank[order[-1]] == len(text) - 1:
            return order
        following = np.zeros_like(rank)
        following[:-width] = rank[width:] + 1
        rank = rank * (len(text) + 1) + following
        order = np.argsort(rank, kind="stable")
        width *= 2


class FMIndex:
    """Backward search over ``text`` (symbols below ``size``) for patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.rows = len(text)
        self.matrix = WaveletMatrix(text[sort_suffixes(text, depth) - 1], max(1, int(size - 1).bit_length()))
        smaller = np.zeros(size + 1, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=size), out=smaller[1:])
        bottom = np.zeros(size, dtype=np.int64)  # where each symbol's run begins at the bottom
        starts = np.flatnonzero(np.append([True], self.matrix.bottom[1:] != self.matrix.bottom[:-1]))
        bottom[self.matrix.bottom[starts]] = starts
        self.shift = smaller[:-1] - bottom

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of (symbol, match) given those of the matches."""
        places = self.matrix.descend(np.concatenate([low, high]), np.concatenate([symbol, symbol]))
        return places[:len(low)] + self.shift[symbol], places[len(low):] + self.shift[symbol]


def repeated_windows(bodies: list[np.ndarray], anchors: np.ndarray, asked: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice in the shard (asked segments only)."""
    length = np.array([len(b) for b in bodies])
    begin = np.cumsum(length + 1) - length - 1
    ends = begin + length
    _, dense = np.unique(np.concatenate(bodies), return_inverse=True)
    text = np.zeros(int(length.sum()) + len(bodies), dtype=np.int64)  # 0 ends a segment
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside] = dense + 1
    index = FMIndex(text, int(text.max()) + 1, window)
    marks = np.zeros(len(text), dtype=bool)
    offset = begin[asked]
    end = length[asked]
    place = end.copy()
    low, high = np.zeros(len(end), dtype=np.int64), np.full(len(end), index.rows)
    while len(end):
        near, far = index.extend(low, high, text[offset + place - 1])
        found = far - near >= 2
        place = np.where(found, place - 1, place)
        hit = found & (end - place >= window)
        marks[(offset + place)[hit]] = True
        # the match can't grow: windows over its left neighbour end before it does
        end = np.where(found, end, np.minimum(end - 1, place - 1 + window))
        place = np.where(found, place, end)
        low, high = np.where(found, near, 0), np.where(found, far, index.rows)
        go_on = (place > 0) & (end >= window)
        if not go_on.all():
            end, place, low, high, offset = end[go_on], place[go_on], low[go_on], high[go_on], offset[go_on]
    return [marks[b:b + n - window + 1] for b, n in zip(begin, length)]


def repeated_word_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """Spans (row_id, row_hash, first, past) of words covered by a window of ``window`` words that starts anywhere else."""
    return repeated_spans(docs, key, text, "words", window, min(GRAM, window), repeated_windows, SHARD_BYTES)


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and ``kept_sha256``; columns
    of these names are replaced. Null and empty texts have no words; a repeated row is one more document, so its windows
    repeat. Rows need not have an id."""
    added = {"n_words": "long", "n_removed": "long", "kept_text": "string", "kept_sha256": "string"}
    spans = repeated_word_spans(docs, key, text, window)
    rows = with_spans(docs.drop(*(c for c in docs.columns if c.lower() in added)), spans, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in added}
            removals = batch.column(batch.num_columns - 1).to_pylist()
            for value, gone_spans in zip(text_column(batch, text).to_pylist(), removals):
                words = (value or b"").split()  # bytes split at exactly these six spaces
                n = len(words)
                if gone_spans:
                    gone = covered(n, np.array([s["first"] for s in gone_spans]), np.array([s["past"] for s in gone_spans]))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                for name, got in zip(out, (n, n - len(words), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest())):
                    out[name].append(got)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.string(), pa.string())))],
                names=[*batch.schema.names[:-1], *out])

    return rows.mapInArrow(tidy(run), schema_with(rows, added))
