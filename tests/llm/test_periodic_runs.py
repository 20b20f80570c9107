"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from attesta.llm import periodic_runs

SCHEMA = "doc_id long, text string, n_runs string, runs string, row_id string"


def changed(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_runs(words):
    """Every run by its definition: all stretches of each period, those of a smaller period left out."""
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(words[i:i + length - p] == words[i + p:i + length] for p in range(1, q)):
                runs.append((i, length, q))
            i = j
    return sorted(runs, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, alter):
    words = changed(doc_id, (text or "").encode().split()) if alter else (text or "").encode().split()
    runs = brute_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def random_words(rng, n):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.4:
            out += [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))]
        else:
            root = [f"w{rng.randrange(3 if kind < 0.7 else 30)}" for _ in range(rng.randrange(1, 2 + n // 6))]
            out += (root * 9)[:rng.randrange(1, 8 * len(root) + 1)]
    return out[:n]


@pytest.mark.parametrize("tile_words", [64, 256, periodic_runs.TILE_WORDS])
def test_runs_and_collapse(spark, tile_words):
    rng = random.Random(tile_words)
    rows = [(i, rng.choice([" ", "\t\n "]).join(random_words(rng, rng.choice([3, 5, 6, 8, 13, 40, 150, 300]))), "", "", "") for i in range(150)]
    rows += [(1000, None, None, "", ""), (1001, "", "", "", ""), (1002, " \n", "", "", ""), (None, "a " * 9, "", "", ""),
             (1003, "b " * 400, "", "", ""), (None, None, "", "", ""), (1004, "é ü " * 50 + "x", "", "", ""), rows[7], rows[7],
             (2**40, "long " + "a b c " * 300, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for alter in (True, False):
        got = periodic_runs.collapse_runs(docs, alter=alter, tile_words=tile_words)
        assert got.columns[:5] == docs.columns and got.columns[5] == "_n_runs"
        seen = sorted((tuple(r)[:2], tuple(r)[5:12]) for r in got.na.fill(-1, ["doc_id"]).collect() if r.text is not None)
        want = sorted(((-1 if r[0] is None else r[0], r[1]), expected(r[0], r[1], alter)) for r in rows if r[1] is not None)
        assert len(seen) == len(want)
        for a, b in zip(seen, want):
            assert a == b
        none = [r for r in got.collect() if r.text is None]
        assert len(none) == 2 and all(r._n_runs == 0 and r.start is None and r.collapsed_text == "" for r in none)


def test_every_stretch_of_every_octave_is_found():
    rng = random.Random(5)
    for _ in range(60):
        words = random_words(rng, rng.randrange(6, 900))
        number = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words])
        q, first, past = periodic_runs.solve(ids, 0, 10)
        got = sorted((int(a), int(b - a + p), int(p)) for p, a, b in zip(q, first, past) if b - a + p >= 6)
        assert got == sorted(brute_runs(words))


def test_hashes_that_agree_by_chance_are_checked():
    symbols = np.array([1, 2, 1, 2, 1, 2, 1, 9, 1, 2, 1, 2, 1, 2, 1, 2])
    q, first, past = periodic_runs.verified(symbols, np.array([2]), np.array([0]), np.array([14]))
    assert list(zip(q, first, past)) == [(2, 8, 14)]


def test_empty_table(spark):
    got = periodic_runs.collapse_runs(spark.createDataFrame([], SCHEMA), with_text=False)
    assert got.collect() == [] and "collapsed_text" not in got.columns
