"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from attesta.llm import columns, fm_index, repeats, suffix_sort

SCHEMA = "doc_id long, text string, lang string, row_id string, spans int"


def brute(units, window, join):
    counts = Counter(join(u[i:i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if counts[join(u[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "the", "né", "x1", "Qu u", "of"] + [f"w{i}" for i in range(40)]
    sentence = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", "  \t\n ", "one", "x " * 400, "  lead and  trail\t"]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = sentence
        if i % 7 == 0:
            words = ["the"] * 25 + words
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += texts[10:20]
    rows = [(i, t, "en", "r", 1) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, texts[14], None, None, None), (None, None, None, None, None)]


@pytest.mark.parametrize("hot", [10_000, 3])
def test_words(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    rows = corpus()
    got = fm_index.remove_repeated_words(spark.createDataFrame(rows, SCHEMA), window=12).collect()
    units = [(r[1] or "").encode().split() for r in rows]
    want = []
    for row, words, gone in zip(rows, units, brute(units, 12, b" ".join)):
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want.append((row[0], len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got)


@pytest.mark.parametrize("hot", [10_000, 3])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot)
    rows = corpus(2)
    got = suffix_sort.remove_repeated_bytes(spark.createDataFrame(rows, SCHEMA), window=90).collect()
    units = [(r[1] or "").encode() for r in rows]
    want = []
    for row, data, gone in zip(rows, units, brute(units, 90, bytes)):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want.append((row[0], len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)


def test_copies_are_settled_where_they_are_found(spark, monkeypatch):
    rng, tables, write = random.Random(6), {}, repeats.materialise
    monkeypatch.setattr(repeats, "HOT_ROWS", 50)
    monkeypatch.setattr(repeats, "materialise", lambda df, purpose: tables.setdefault(purpose, write(df, purpose)))
    text = " ".join(f"w{rng.randrange(60)}" for _ in range(90))
    docs = spark.createDataFrame([(i, text, "en", "r", 1) for i in range(400)] + [(400, text[30:] + " end", "en", "r", 1)], SCHEMA).coalesce(1)
    got = fm_index.remove_repeated_words(docs, window=12)
    assert {(r.n_removed, r.n_words) for r in got.collect() if r.doc_id < 400} == {(90, 90)}
    segments = tables["segments"]  # one row of equal ones goes on, so no anchor of copies alone has many rows
    assert segments.count() > 400 and segments.filter("twins < 2").groupBy("anchor", "body").count().agg({"count": "max"}).first()[0] == 1
    assert tables["hot"].count() == 0
    assert "LeftSemi" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fm_index.remove_repeated_words(empty).count() == 0
    assert suffix_sort.remove_repeated_bytes(empty).count() == 0


def test_long_text_is_cut_in_slices(spark):
    text = " ".join(f"w{i % 50_021}" for i in range(200_000))  # more than a slice
    got = fm_index.remove_repeated_words(spark.createDataFrame([(1, text, "", "", 0)], SCHEMA), window=35).first()
    # the numbers come again after 50,021 words, so every window does
    assert (got.n_words, got.n_removed) == (200_000, 200_000)


def test_fm_index_counts():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = fm_index.FMIndex(text, 5, 8)
    for at in range(0, 290, 7):
        pattern = text[at:at + 1 + at % 8]
        low, high = np.array([0]), np.array([index.rows])
        for c in pattern[::-1]:
            low, high = index.extend(low, high, np.array([c]))
        want = sum((text[i:i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern) + 1))
        assert high[0] - low[0] == want


def test_suffix_sort_is_an_order():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    places, group = np.arange(560), np.sort(rng.integers(0, 3, 560))
    got = suffix_sort.merge_sort(places, group, suffix_sort.Extensions(text, 40))
    for g in range(3):
        mine = [text[p:p + 40].tobytes() for p in got[group == g]]
        assert mine == sorted(mine)


def test_sliding_argmin():
    values = np.random.default_rng(5).integers(0, 1 << 63, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 64):
        got = columns.sliding_argmin(values, width)
        assert got.tolist() == [i + int(np.argmin(values[i:i + width] >> np.uint64(32))) for i in range(200 - width + 1)]
