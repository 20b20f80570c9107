"""LM scoring by masked pseudo-likelihood.

A small bidirectional window network predicts every token from its neighbours on both sides; a document's score is the sum
of the log-probabilities. Words become codes: the most frequent words of the corpus have codes of their own, all others
share the rest by hash. A code is two digits, predicted one after the other, so probabilities are exact over all codes.
A word that shares its code takes its share of the code's occurrences, so every word has a probability of its own: the
counts of the most frequent such words are broadcast, those of all others are joined to the tokens.

Training is data-parallel: each round, every task takes the shared parameters over its part of the corpus by mini-batch
steps and the results are averaged by tokens, in a tree; only the averaged parameters reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm.columns import Words, slices, text_column
from attesta.llm.scratch import materialise

BASE = 32
CODES = BASE * BASE
OWN_CODES = CODES // 2
SHARED_CODES = CODES - OWN_CODES
#: So many counts of words with shared codes are broadcast; the others are joined, with the same result.
BROADCAST_COUNTS = 1 << 16
REACH, WIDTH = 2, 16
BATCH, RATE, ROUNDS, SEED = 1024, 1.0, 1, 20
SCORED = 4096
OUTSIDE = CODES  # the code beyond a text's ends
_OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]


class Network:
    """Parameters: ``context`` (place and code to hidden), ``bias``, two output layers, ``first`` (first digit to hidden)."""

    SHAPES = {"context": (len(_OFFSETS) * (CODES + 1), WIDTH), "bias": (WIDTH,), "out1": (WIDTH, BASE), "off1": (BASE,),
              "first": (BASE, WIDTH), "out2": (WIDTH, BASE), "off2": (BASE,)}

    def __init__(self, flat: np.ndarray | None = None, seed: int = SEED):
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = rng.normal(0, 0.1, sum(math.prod(s) for s in self.SHAPES.values()))
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in self.SHAPES.items():
            setattr(self, name, self.flat[at:at + math.prod(shape)].reshape(shape))
            at += math.prod(shape)

    def forward(self, rows: np.ndarray, target: np.ndarray):
        a, b = target // BASE, target % BASE
        raw = self.bias + self.context[rows[:, 0]]
        for i in range(1, rows.shape[1]):
            raw += self.context[rows[:, i]]
        h1 = np.tanh(raw)
        h2 = np.tanh(raw + self.first[a])
        return a, b, h1, h2, _log_softmax(h1 @ self.out1 + self.off1), _log_softmax(h2 @ self.out2 + self.off2)

    def log_probabilities(self, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        a, b, _, _, l1, l2 = self.forward(rows, target)
        at = np.arange(len(target))
        return l1[at, a] + l2[at, b]

    def step(self, rows: np.ndarray, target: np.ndarray, rate: float) -> None:
        a, b, h1, h2, l1, l2 = self.forward(rows, target)
        n, at = len(target), np.arange(len(target))
        d1, d2 = np.exp(l1), np.exp(l2)
        d1[at, a] -= 1
        d2[at, b] -= 1
        r1, r2 = (d1 @ self.out1.T) * (1 - h1 * h1), (d2 @ self.out2.T) * (1 - h2 * h2)
        raw = r1 + r2
        scale = np.float32(rate / n)
        self.out1 -= scale * (h1.T @ d1)
        self.off1 -= scale * d1.sum(axis=0)
        self.out2 -= scale * (h2.T @ d2)
        self.off2 -= scale * d2.sum(axis=0)
        hot = np.zeros((n, BASE), dtype=np.float32)
        hot[at, a] = 1
        self.first -= scale * (hot.T @ r2)
        self.bias -= scale * raw.sum(axis=0)
        # embeddings are hit by few tokens of a batch each: a step by their own count
        flat = rows.ravel()
        count = np.bincount(flat, minlength=len(self.context)).astype(np.float32)
        pace = np.float32(rate) / np.sqrt(np.maximum(count, 1) * n)
        width = rows.shape[1]
        for k in range(WIDTH):
            self.context[:, k] -= pace * np.bincount(flat, weights=np.repeat(raw[:, k], width), minlength=len(self.context)).astype(np.float32)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in slices(text_column(batch, "text"), 1 << 22):
            word, n = np.unique(Words(data, offsets, fold_case=True).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])


def word_counts(named: DataFrame) -> DataFrame:
    """(word, n) of every word of all texts, as a table."""
    return materialise(named.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> np.ndarray:
    """The keys of the ``OWN_CODES`` most frequent words, sorted by key."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(OWN_CODES).select("word").collect()
    return np.sort(np.array([r[0] for r in top], dtype=np.int64).view(np.uint64))


class Shares:
    """Of the words with shared codes: ``total`` occurrences per code, and the counts of the most frequent words (``key``
    sorted, ``log_n``)."""

    def __init__(self, counts: DataFrame, own: np.ndarray):
        others = counts.filter(~F.col("word").isin(own.view(np.int64).tolist()))
        code = F.col("word").bitwiseAND(F.lit(SHARED_CODES - 1))
        self.total = np.ones(SHARED_CODES)
        for r in others.groupBy(code.alias("code")).agg(F.sum("n").alias("n")).collect():
            self.total[r["code"]] = r["n"]
        top = others.orderBy(F.col("n").desc(), "word").limit(BROADCAST_COUNTS).toArrow()
        key = top.column("word").to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.key, self.log_n = key[order], np.log(top.column("n").to_numpy()[order].astype(np.float64))

    def known(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per key the logarithm of its share of its code, as far as its count is here, and whether the count is missing:
        then the logarithm of the count is still to be added."""
        out = -np.log(self.total[(key & np.uint64(SHARED_CODES - 1)).astype(np.int64)])
        if not len(self.key):
            return out, np.ones(len(key), dtype=bool)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        here = self.key[place] == key
        return out + np.where(here, self.log_n[place], 0.0), ~here


def coded(column: pa.Array, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
    """(first row, contexts, targets, words) of slices of texts."""
    for row, _, data, offsets in slices(column):
        words = Words(data, offsets, fold_case=True)
        place = np.minimum(np.searchsorted(own, words.key), max(len(own) - 1, 0))
        known = own[place] == words.key if len(own) else np.zeros(len(words.key), dtype=bool)
        code = np.where(known, place, OWN_CODES + (words.key & np.uint64(SHARED_CODES - 1)).astype(np.int64))
        padded = np.concatenate([np.full(REACH, OUTSIDE), code, np.full(REACH, OUTSIDE)])
        doc = np.concatenate([np.full(REACH, -1), words.doc, np.full(REACH, -1)])
        n = len(code)
        rows = np.empty((n, len(_OFFSETS)), dtype=np.int64)
        for i, offset in enumerate(_OFFSETS):
            at = slice(REACH + offset, REACH + offset + n)
            rows[:, i] = np.where(doc[at] == words.doc, padded[at], OUTSIDE) + i * (CODES + 1)
        yield row, rows, code, words


def _train(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flat = shared.value
        net, tokens = Network(flat.copy()), 0
        for batch in batches:
            for _, rows, code, _ in coded(text_column(batch, "text"), own):
                for i in range(0, len(code), BATCH):
                    net.step(rows[i:i + BATCH], code[i:i + BATCH], rate)
                tokens += len(code)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())],
                                             names=["tokens", "parameters"])
    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = None, 0
    for batch in batches:
        for n, flat in zip(batch.column(0).to_pylist(), batch.column(1)):
            mine = np.frombuffer(flat.as_py(), dtype=np.float32).astype(np.float64) * n
            total, tokens = mine if total is None else total + mine, tokens + n
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())],
                                         names=["tokens", "parameters"])


def fit(named: DataFrame, own: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """Parameters learned from every token of every text; ``own``: the words with codes of their own."""
    schema = "tokens long, parameters binary"
    flat = Network().flat
    spark: SparkSession = named.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((own, flat))
        parts = materialise(named.mapInArrow(_train(shared, rate), schema), "parts")
        groups = max(1, math.isqrt(parts.count()))
        order = F.xxhash64("parameters")  # sums in one order, so that reruns agree
        some = parts.withColumn("p", order).repartition(groups, "p").sortWithinPartitions("p").drop("p").mapInArrow(_average, schema)
        one = some.withColumn("p", order).repartition(1).sortWithinPartitions("p").drop("p").mapInArrow(_average, schema).first()
        if one is None:
            break
        flat = np.frombuffer(one["parameters"], dtype=np.float32)
    return flat


def _score(shared):
    """Per text a number, its id, its tokens, its score as far as the counts at hand say it, and the words (with how often
    they occur) whose counts are missing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flat, shares = shared.value
        net, nr = Network(flat.copy()), TaskContext.get().partitionId() << 33
        for batch in batches:
            for row, rows, code, words in coded(text_column(batch, "text"), own):
                score = np.zeros(len(code) + 1)
                for i in range(0, len(code), SCORED):
                    score[i + 1:i + 1 + SCORED] = net.log_probabilities(rows[i:i + SCORED], code[i:i + SCORED])
                at = np.flatnonzero(code >= OWN_CODES)
                share, missing = shares.known(words.key[at])
                score[at + 1] += share
                total = np.cumsum(score)
                first = words.first
                n = np.diff(first)
                part = batch.slice(row, len(n))
                # of each text its words without a count, once
                key, doc = words.key[at[missing]], words.doc[at[missing]]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                ends = pa.array(np.searchsorted(doc[start], np.arange(len(n) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(nr, nr + len(n))), part.column(0), pa.array(n.astype(np.int64)),
                    pa.array(np.where(n > 0, total[first[1:]] - total[first[:-1]], 0.0)),
                    pa.ListArray.from_arrays(ends, pa.array(key[start].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(start, len(key))).astype(np.int64)))],
                    names=["nr", "id", "n_tokens", "part", "words", "times"])
                nr += len(n)
    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per document: its id, ``n_tokens``, ``pseudo_log_likelihood`` (natural logarithm, 0 without tokens) and
    ``per_token`` (null without tokens), by a network and word counts fitted to all of ``docs``. A null text has no tokens."""
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    counts = word_counts(named)
    own = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((own, fit(named, own, rounds), Shares(counts, own)))
    scored = materialise(named.mapInArrow(
        _score(shared), "nr long, id long, n_tokens long, part double, words array<long>, times array<long>"), "scored")
    missing = scored.select("nr", F.explode(F.arrays_zip("words", "times")).alias("w")).select("nr", "w.words", "w.times")
    added = missing.join(counts, F.col("words") == F.col("word")).groupBy("nr").agg(F.sum(F.col("times") * F.log("n")).alias("rest"))
    total = F.col("part") + F.coalesce("rest", F.lit(0.0))
    return scored.select("nr", "id", "n_tokens", "part").join(added, "nr", "left").select(
        F.col("id").alias(key), "n_tokens", total.alias("pseudo_log_likelihood"),
        F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"))
