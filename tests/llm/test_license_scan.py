"""Licence scans against a backtracking matcher over word lists."""

import random
import re

import pytest

from attesta.llm import license_scan
from attesta.llm.license_templates import PHRASES, TEMPLATES

SCHEMA = "doc_id long, text string, labels string, n_words int"


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def parse(wording):
    """Nested lists: a word, ("optional", items), ("words", m, n) or ("one", words)."""
    stack = [[]]
    for part in re.findall(r"<<.*?>>|\S+", wording):
        body = part[2:-2].split(" ", 1)
        if not part.startswith("<<"):
            stack[-1] += tokens(part)
        elif body[0] == "optional":
            stack.append([])
        elif body[0] == "end":
            items = stack.pop()
            stack[-1].append(("optional", items))
        elif body[0] == "words":
            stack[-1].append(("words", *map(int, body[1].split("-"))))
        else:
            stack[-1].append(("one", body[1].removeprefix("of ").split("|")))
    return stack[0]


def ends(items, words, at):
    """Every place behind a match of the items that begins at ``at``."""
    if not items:
        return {at}
    item, rest = items[0], items[1:]
    if isinstance(item, str) or item[0] == "one":
        fits = at < len(words) and (words[at] == item if isinstance(item, str) else words[at] in item[1])
        return ends(rest, words, at + 1) if fits else set()
    if item[0] == "optional":
        return ends(rest, words, at) | {e for m in ends(item[1], words, at) for e in ends(rest, words, m)}
    return {e for k in range(item[1], item[2] + 1) if at + k <= len(words) for e in ends(rest, words, at + k)}


def brute(text, templates, phrases):
    words, places = tokens(text), []
    for base, wordings in ((True, [(k, v) for k, v in phrases.items()]), (False, [(k, v) for k, vs in templates.items() for v in vs])):
        for label, wording in wordings:
            items = parse(wording)
            places += [(label, base, i, max(e)) for i in range(len(words)) if (e := ends(items, words, i))]
    starts = [p[2] for p in places if p[1]]
    score = 1.0 if any(not p[1] for p in places) else 0.5 if starts else 0.0
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[0] for p in places if p[1]})),
            ",".join(sorted({p[0] for p in places})), score), sorted(places)


RANDOM = {
    "x": ["a b <<optional>> c <<optional>> d <<end>> <<end>> e", "<<optional>> b <<end>> a <<words 0-3>> d"],
    "y": ["<<one of a|c>> <<words 1-2>> <<one of b|e>> <<optional>> a <<end>>", "c <<words 2-4>> c"],
    "z": ["d <<optional>> <<words 1-2>> e <<end>> a"],
}


def outcome(row):
    names = list(license_scan.ADDED)
    taken = {"labels", "n_words"}
    values = [row["_" + n if n in taken else n] for n in names]
    return tuple(values[:-1]), sorted((p.label, p.base, p.first, p.past) for p in values[-1])


def test_automata_accept_what_backtracking_does(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice("abcdeAB") for _ in range(rng.randrange(0, 40))), "l", 1) for i in range(250)]
    rows += [(900, None, "", 0), (901, "", "", 0), (None, "a b e", "", 0), (902, "À b", "", 0), rows[5], rows[5], (903, "a b e " * 20_000, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    phrases = {"p": "a b", "q": "e"}
    got = license_scan.scan_licenses(docs, templates=RANDOM, phrases=phrases)
    assert got.columns[:4] == docs.columns
    seen = {(r.doc_id, r.text): outcome(r) for r in got.collect()}
    assert got.count() == len(rows)
    for key, text, _, _ in rows:
        if key != 903:
            assert seen[(key, text)] == brute(text, RANDOM, phrases), text
    assert seen[(903, rows[-1][1])][0][:4] == (60_000, 40_000, 0, 59_999)


def fill(items, rng):
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(item.upper() if rng.random() < 0.2 else item)
        elif item[0] == "optional":
            out += fill(item[1], rng) if rng.random() < 0.5 else []
        elif item[0] == "words":
            out += [f"name{rng.randrange(9)}" for _ in range(rng.randint(item[1], item[2]))]
        else:
            out.append(rng.choice(item[1]))
    return out


def test_every_template_with_its_regions_filled_and_with_a_word_changed(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for label, wordings in TEMPLATES.items():
        for wording in wordings:
            items = parse(wording)
            for _ in range(4):
                words = ["intro", *fill(items, rng), "rest"]
                rows.append((len(rows), " -- ".join(words), "", 0))
                want[len(rows) - 1] = (label, True)
            must = [i for i, x in enumerate(items) if isinstance(x, str)]
            wrong = list(items)
            wrong[rng.choice(must)] = "otherwise"
            rows.append((len(rows), " ".join(["intro", *fill(wrong, rng)]), "", 0))
            want[len(rows) - 1] = (label, False)
    for row in license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect():
        label, whole = want[row.doc_id]
        assert (label in row._labels.split(",")) == whole, (label, row.text)
        if len(tokens(row.text)) < 60:
            assert outcome(row) == brute(row.text, TEMPLATES, PHRASES)


def test_regex_of_a_template_says_the_same():
    rng = random.Random(3)
    for _ in range(400):
        words = [rng.choice("abcde") for _ in range(rng.randrange(0, 14))]
        for wordings in RANDOM.values():
            for wording in wordings:
                found = bool(re.search(license_scan.template_regex(wording), " " + " ".join(words) + " "))
                assert found == any(ends(parse(wording), words, i) for i in range(len(words)))


@pytest.mark.parametrize("wording", ["a <<optional>> b", "a <<end>>", "a <<some>> b", "<<words 1-2>> a", "a <<words 1-2>>",
                                     "<<optional>> a <<end>>"])
def test_templates_that_cannot_be(wording):
    with pytest.raises(ValueError):
        license_scan.compile_template("x", wording)


def test_empty_table(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
