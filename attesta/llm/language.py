"""Language identification, word first: a word seen in training scores by its log frequency in each language; an unseen one
backs off to its longest known character n-grams.

The classifier is fitted on a bounded sample of labelled rows (a parameter) and keeps every count of it, so it may be
broadcast: its size is that of the sample's (token, language) pairs. Everything else covers all rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attesta.llm.columns import release, tidy
from attesta.llm.scratch import fresh, materialise

ROWS_PER_LANGUAGE = 4_000
CACHED_WORDS = 150_000
#: Rows whose n-grams are counted at once.
COUNTED_ROWS = 2_000
#: A longer run of letters (a clause, where words are not spaced) is no word of its own, but its n-grams count.
LONGEST_WORD = 40
LONGEST_GRAM = 5
BACKOFF = 0.4
PIECE_WORDS = 100_000
EVIDENCE_WORDS = 20.0
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-cased letter runs of a text, some at a time."""
    found = (m.group() for m in _WORD.finditer(text.lower()))
    while piece := list(itertools.islice(found, PIECE_WORDS)):
        yield piece


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between marks of its ends."""
    marked = f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, COUNTED_ROWS) for b in batches for at in range(0, b.num_rows, COUNTED_ROWS)):
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in words_of(text):
                words.setdefault(lang, Counter()).update(piece)
        for lang, seen in words.items():
            counts: Counter = Counter()
            for word, n in seen.items():
                if len(word) <= LONGEST_WORD:
                    counts[0, word] += n
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, size):
                        counts[size, gram] += n
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(keys), pa.string()), pa.array([k[0] for k in keys], pa.int32()),
                pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "size", "token", "n"])


class Counts:
    """Log frequencies of the tokens of one size: ``base`` for a token that a language never had, and of each token the
    languages that had it with what that adds."""

    def __init__(self, tokens: list[str], langs: np.ndarray, n: np.ndarray, languages: int):
        self.at: dict[str, int] = {}
        rows = np.array([self.at.setdefault(t, len(self.at)) for t in tokens], dtype=np.int64)
        order = np.argsort(rows, kind="stable")
        self.lang, self.gain = langs[order], np.log((n[order] + 0.5) / 0.5)
        self.start = np.searchsorted(rows[order], np.arange(len(self.at) + 1))
        mass = np.bincount(langs, weights=n, minlength=languages) + 0.5 * (len(self.at) + 2)
        self.base = np.log(0.5 / mass)

    def total(self, at: np.ndarray) -> np.ndarray:
        """The sum over some tokens, by language."""
        begin = self.start[at]
        length = self.start[at + 1] - begin
        place = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return len(at) * self.base + np.bincount(self.lang[place], weights=self.gain[place], minlength=len(self.base))


class Model:
    """Log frequencies by token; ``size`` 0 holds words, 1 and up character n-grams."""

    def __init__(self, rows: Iterable[tuple[str, int, str, int]], rows_of: dict[str, int]):
        self.languages = sorted(rows_of)
        place = {lang: i for i, lang in enumerate(self.languages)}
        total = sum(rows_of.values())
        self.prior = np.log(np.array([rows_of[x] / total for x in self.languages])) if rows_of else np.zeros(0)
        found: list[tuple[list, list, list]] = [([], [], []) for _ in range(LONGEST_GRAM + 1)]
        for lang, size, token, n in rows:
            for column, x in zip(found[size], (token, place[lang], n)):
                column.append(x)
        self.counts = [Counts(tokens, np.array(langs, dtype=np.int32), np.array(n, dtype=np.float64), len(self.languages))
                       for tokens, langs, n in found]

    def unseen(self, word: str) -> np.ndarray:
        """An unseen word: the mean log frequency of its longest known n-grams, less for each step down."""
        for step, size in enumerate(range(LONGEST_GRAM, 0, -1)):
            counts = self.counts[size]
            known = [i for g in grams_of(word, size) if (i := counts.at.get(g)) is not None]
            if known:
                return counts.total(np.array(known)) / len(known) + (step + 1) * np.log(BACKOFF)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = self.prior.copy(), 0
        seen = self.counts[0]
        get = seen.at.get
        for words in words_of(text or ""):
            n += len(words)
            if not self.languages:
                break
            at = np.array([get(w, -1) for w in words], dtype=np.int64)
            total += seen.total(at[at >= 0])
            for i, m in Counter(words[i] for i in np.flatnonzero(at < 0)).items():
                total += m * self.cached(i)
        if not n or not self.languages:
            return UNDETERMINED, 0.0
        best = int(np.argmax(total))
        # the share of the best at the evidence of so many words: long texts do not all score one
        tempered = (total - total[best]) / max(1.0, n / EVIDENCE_WORDS)
        return self.languages[best], float(1 / np.exp(tempered).sum())

    def cached(self, word: str) -> np.ndarray:
        cache = self.__dict__.setdefault("_cache", {})
        if (got := cache.get(word)) is None:
            if len(cache) >= CACHED_WORDS:
                cache.clear()
            got = cache[word] = self.unseen(word)
        return got


def fit(labelled: DataFrame, text: str, lang: str, pick: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on the ``rows_per_language`` rows of each language with the least ``pick``. Every count of these rows stays."""
    ranked = labelled.select(F.col(lang).alias("lang"), pick.alias("pick"))
    # picks are hashes: all but a share of each language a little larger than wanted is passed over before any row is ranked
    sizes = ranked.groupBy("lang").agg(F.count("*").alias("n"))
    share = (F.lit(1.5 * rows_per_language + 1000)) / F.col("n")
    ranked = ranked.join(sizes, "lang").filter((F.col("pick").cast("double") + 2.0**63) / 2.0**64 <= share).select("lang", "pick")
    cut = (ranked.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("pick")))
           .filter(F.col("place") <= rows_per_language).groupBy("lang").agg(F.max("pick").alias("cut"), F.count("*").alias("rows")))
    limits = cut.orderBy("lang").collect()
    if not limits:
        return Model([], {})
    cuts = labelled.sparkSession.createDataFrame([(r["lang"], r["cut"]) for r in limits], "l string, cut long")
    sample = labelled.select(F.col(lang).alias("l"), F.col(text).alias("text"), pick.alias("pick"))\
        .join(F.broadcast(cuts), "l").filter(F.col("pick") <= F.col("cut")).filter("text is not null")
    counts = materialise(sample.select("l", "text").mapInArrow(tidy(_count), "lang string, size int, token string, n long")
                         .groupBy("lang", "size", "token").agg(F.sum("n").alias("n")), "counts")

    def entries() -> Iterator[tuple[str, int, str, int]]:
        for size in range(LONGEST_GRAM + 1):  # columns, not row objects, and one size at a time
            found = counts.filter(F.col("size") == size).orderBy("token", "lang").toArrow()
            for batch in found.to_batches():
                yield from zip(*(batch.column(c).to_pylist() for c in ("lang", "size", "token", "n")))

    return Model(entries(), {r["lang"]: r["rows"] for r in limits})


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced), from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "struct<lang_pred:string,score:double>"

    @F.pandas_udf(schema)
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release()
        for series in texts:
            yield pd.DataFrame([shared.value.predict(x) for x in series], columns=["lang_pred", "score"])
        release()

    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("lang_pred", "score")))
    verdict, = fresh(docs, "verdict")
    return docs.withColumn(verdict, judge(F.col(text))).withColumns(
        {"lang_pred": F.col(f"{verdict}.lang_pred"), "score": F.col(f"{verdict}.score")}).drop(verdict)


def held_out(key: str) -> Column:
    """Rows kept from training: crc32 of the id as text is divisible by five (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (0 to 1). Learns from rows that are not held out and have an
    id and a language. A text that is null or has no letter is ``und`` with score 0, and so is all without training rows."""
    labelled = docs.filter(~held_out(key) & F.col(key).isNotNull() & F.col(lang).isNotNull())
    model = fit(labelled, text, lang, F.xxhash64(key))
    return predict(docs, model, text).withColumn("held_out", held_out(key))
