"""Licence scans: templates with markup, compiled to token automata.

A template becomes an automaton over words whose states are numbered along the wording: a word moves on by one state, an
optional region may be jumped over, a replaceable one takes a bounded number of any words. All places of a slice of
documents where a template can begin run through its automaton together: each state holds the (start, next word)
pairs that have reached it. Documents are never shuffled, and a text is held only as long as its slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from attesta.llm.columns import Words, slices, text_column
from attesta.llm.license_templates import PHRASES, TEMPLATES
from attesta.llm.scratch import fresh

_MARKUP = re.compile(r"<<(.*?)>>|(\S+)")


@dataclass
class Automaton:
    """States 0 .. n - 1 (the last one accepts). ``steps``: (state, words, next); ``jumps``: (state, next); ``spans``: (state,
    least, most, next) of any words. Every edge leads to a later state."""

    label: str
    base: bool
    steps: list[tuple[int, tuple[str, ...], int]] = field(default_factory=list)
    jumps: list[tuple[int, int]] = field(default_factory=list)
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)
    states: int = 1

    def words(self) -> set[str]:
        return {w for _, words, _ in self.steps for w in words}

    def first_words(self) -> set[str]:
        """The words a match can begin with."""
        reached = {0}
        for a, b in sorted(self.jumps):
            if a in reached:
                reached.add(b)
        if any(a in reached for a, _, _, _ in self.spans) or self.states - 1 in reached:
            raise ValueError(f"{self.label}: a template begins with a word that must stand")
        return {w for a, words, _ in self.steps if a in reached for w in words}


def compile_template(label: str, wording: str, base: bool = False) -> Automaton:
    """The automaton of a template. Replaceable regions at its end add nothing and are refused."""
    out, opened, last = Automaton(label, base), [], ""
    for markup, word in _MARKUP.findall(wording):
        here, last = out.states - 1, markup
        kind, _, rest = markup.partition(" ")
        if word:
            for part in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", word.lower()):
                out.steps.append((out.states - 1, (part,), out.states))
                out.states += 1
        elif kind == "optional":
            opened.append(here)
        elif kind == "end":
            if not opened:
                raise ValueError(f"{label}: a region ends that has not begun")
            out.jumps.append((opened.pop(), here))
        elif kind == "words":
            least, most = (int(x) for x in rest.split("-"))
            out.spans.append((here, least, most, here + 1))
            out.states += 1
        elif kind == "one":
            out.steps.append((here, tuple(rest.removeprefix("of ").split("|")), here + 1))
            out.states += 1
        else:
            raise ValueError(f"{label}: unknown markup {markup!r}")
    if opened:
        raise ValueError(f"{label}: a region does not end")
    if last.startswith("words"):
        raise ValueError(f"{label}: a template ends with a word")
    out.first_words()
    return out


def compile_all(templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> list[Automaton]:
    """Automata of the base phrases, then of the templates."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    return ([compile_template(label, phrase, base=True) for label, phrase in phrases.items()]
            + [compile_template(label, wording) for label, wordings in templates.items() for wording in wordings])


class Vocabulary:
    """The words of all automata as numbers from 1; 0 stands for any other word."""

    def __init__(self, automata: list[Automaton]):
        names = sorted({w for a in automata for w in a.words()})
        self.number = {w: i + 1 for i, w in enumerate(names)}
        raw = [w.encode() for w in names]
        self.length = np.array([len(w) for w in raw], dtype=np.int64)
        data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
        found = Words(data, np.array([0, len(data)]))
        self.order = np.argsort(found.key)
        self.keys = found.key[self.order]
        self.letters = np.zeros((len(raw), int(self.length.max(initial=1))), dtype=np.uint8)
        for i, w in enumerate(raw):
            self.letters[i, :len(w)] = np.frombuffer(w, dtype=np.uint8)

    def codes(self, words: Words) -> np.ndarray:
        """The number of every word; a word counts only if its letters agree, not just its hash."""
        out = np.zeros(len(words.key), dtype=np.int32)
        if not len(self.keys):
            return out
        place = np.minimum(np.searchsorted(self.keys, words.key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == words.key)
        name = self.order[place[hit]]
        length = words.end[hit] - words.start[hit]
        hit, name = hit[length == self.length[name]], name[length == self.length[name]]
        column = np.arange(self.letters.shape[1])
        inside = column < self.length[name][:, None]
        at = np.minimum(words.start[hit][:, None] + column, max(len(words.data) - 1, 0))
        same = ((words.data[at] == self.letters[name]) | ~inside).all(axis=1)
        out[hit[same]] = name[same] + 1
        return out


def accepted(automaton: Automaton, number: dict[str, int], codes: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, behind the last word) of the longest match from each word where one begins. ``past``: where the document
    of each word ends."""
    begins = np.flatnonzero(np.isin(codes, [number[w] for w in automaton.first_words()]))
    none = np.zeros(0, dtype=np.int64)
    if not len(begins):
        return none, none
    reached: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(automaton.states)]
    reached[0].append((begins, begins))
    steps, jumps, spans = ({}, {}, {})
    for table, edges in ((steps, automaton.steps), (jumps, automaton.jumps), (spans, automaton.spans)):
        for a, *edge in edges:
            table.setdefault(a, []).append(edge)
    for state in range(automaton.states):
        if not reached[state]:
            continue
        start, at = (np.concatenate(x) for x in zip(*reached[state]))
        if len(reached[state]) > 1 or state in spans:  # ways that meet are one
            both = np.unique(np.stack([start, at]), axis=1)
            start, at = both[0], both[1]
        reached[state] = []
        if not len(start):
            continue
        if state == automaton.states - 1:
            last = np.append(start[1:] != start[:-1], [True])
            return start[last], at[last]  # sorted: the last of each start is its longest
        for (on,) in jumps.get(state, []):
            reached[on].append((start, at))
        inside = at < past[start]
        for words, on in steps.get(state, []):
            fits = inside.copy()
            fits[inside] = np.isin(codes[at[inside]], [number[w] for w in words])
            reached[on].append((start[fits], at[fits] + 1))
        for least, most, on in spans.get(state, []):
            taken = np.arange(least, most + 1)
            ends = at[:, None] + taken
            row, column = np.nonzero(ends <= past[start][:, None])
            reached[on].append((start[row], ends[row, column]))
    return none, none


ADDED = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(),
         "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(),
         "places": T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
                                             T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))}
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("past", pa.int64())]))
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _PLACES]


def _row(n: int, places: list[dict]) -> tuple:
    base = [p for p in places if p["base"]]
    starts = [p["first"] for p in base]
    whole = any(not p["base"] for p in places)
    return (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({p["label"] for p in base})),
            ",".join(sorted({p["label"] for p in places})), 1.0 if whole else 0.5 if base else 0.0, places)


def _scan(text: str, names: list[str], automata: list[Automaton]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(automata)
        for batch in batches:
            rows = []
            for _, _, data, offsets in slices(text_column(batch, text)):
                words = Words(data, offsets, fold_case=True, alnum=True)
                codes = vocabulary.codes(words)
                past = words.first[1:][words.doc]
                found: dict[int, list[dict]] = {}
                for automaton in automata:
                    start, end = accepted(automaton, vocabulary.number, codes, past)
                    for doc, a, b in zip(words.doc[start].tolist(), start.tolist(), end.tolist()):
                        shift = int(words.first[doc])
                        found.setdefault(doc, []).append(
                            {"label": automaton.label, "base": automaton.base, "first": a - shift, "past": b - shift})
                rows += [_row(n, found.get(doc, [])) for doc, n in enumerate(np.diff(words.first).tolist())]
            columns = [pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [[]] * len(_KINDS), _KINDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)
    return run


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None,
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with, per row: ``n_words``, ``n_base`` (places of the base phrases), ``first_word`` and ``last_word`` (their
    smallest and largest start, null without one), ``base_labels``, ``labels`` (those of templates as well), ``score`` (1 where a
    template's mandatory wording is whole, 0.5 where only a phrase stands, else 0) and ``places`` (label, base, first word, word
    behind the last). Of matches of one template that begin at the same word the longest counts.

    Words are runs of letters and digits, A-Z lower-cased; characters beyond ASCII count as letters. A null or empty text has no
    words, empty labels and score 0. Repeated rows get the same result each, an empty table an empty one; columns whose names
    clash with those added keep theirs, the added ones get a leading underscore."""
    names = fresh(docs, *ADDED)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
                          + [T.StructField(n, t) for n, t in zip(names, ADDED.values())])
    return docs.mapInArrow(_scan(text, [*docs.columns, *names], compile_all(templates, phrases)), schema)


def template_regex(wording: str) -> str:
    """The template as a regular expression over words with a space before each and one behind the last (for SQL)."""
    out = []
    for markup, word in _MARKUP.findall(wording):
        kind, _, rest = markup.partition(" ")
        if word:
            out += [" " + part for part in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", word.lower())]
        elif kind == "words":
            out.append("(?: [^ ]+){%s,%s}" % tuple(rest.split("-")))
        else:
            out.append({"optional": "(?:", "end": ")?"}.get(kind) or f" (?:{rest.removeprefix('of ')})")
    return "".join(out) + " "
