"""Language identification, pseudo-likelihood and decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import decontaminate, language, pseudo_likelihood
from attesta.llm.columns import Words

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_pred string, n int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(docs)
    got = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert got[0] > 0.97 and got[1] > 100 and 0 <= got[2] <= got[3] <= 1
    assert out.count() == docs.count()


def test_language_edges(spark):
    rows = [(i, "the cat and the dog were here " * 3, "en", "x", 0) for i in range(40)] + \
           [(100 + i, "le chat et le chien sont ici " * 3, "fr", "x", 0) for i in range(40)] + \
           [(1000, None, "en", "x", 0), (1001, "", None, "x", 0), (1002, "123 !? 456", "fr", "x", 0), (1003, "thedog", "zz", "x", 0),
            (None, "le chien", None, "x", 0), (1004, "日本", None, "x", 0), (1005, "the dog " * 50_000, None, None, None)]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0][0] == "en" and out[100][0] == "fr" and out[None][0] == "fr" and out[1005][0] == "en"
    assert [out[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert out[1004][0] in ("en", "fr", "zz")
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "word", None, None, 0)], SCHEMA)
    assert language.identify(unlabelled).first().lang_pred == "und"


def test_backoff_takes_the_longest_known_gram():
    model = language.Model([("en", 0, "cat", 5), ("fr", 0, "chat", 5), ("en", 3, "<ca", 4), ("fr", 2, "<c", 9), ("fr", 1, "z", 1)], {"en": 1, "fr": 1})
    assert model.predict("cat")[0] == "en" and model.predict("chat")[0] == "fr"
    assert model.predict("cab")[0] == "en" and model.predict("cz")[0] == "fr"


def test_likelihood_is_a_distribution_and_learns(spark):
    net = pseudo_likelihood.Network()
    rows = np.repeat(np.array([[3, 1030, 2060, 3090]]), pseudo_likelihood.CODES, axis=0)
    assert np.exp(net.log_probabilities(rows, np.arange(pseudo_likelihood.CODES))).sum() == pytest.approx(1, abs=1e-3)
    good = [(i, "a b c d e f g h " * 40, "", "", 0) for i in range(60)]
    rng = random.Random(1)
    odd = [(100, " ".join(rng.choice("abcdefgh") for _ in range(320)), "", "", 0)]
    rows = good + odd + [(200, None, "", "", 0), (201, " \n", "", "", 0), (None, "a b", "", "", 0), (202, "x", "", "", 0)]
    out = {r.doc_id: r for r in pseudo_likelihood.score(spark.createDataFrame(rows, SCHEMA), rounds=6).collect()}
    assert len(out) == len(rows)
    assert out[0].per_token > out[100].per_token + 0.3 and out[0].n_tokens == 320
    assert out[0].pseudo_log_likelihood == pytest.approx(out[0].per_token * 320, rel=1e-6)
    assert (out[200].n_tokens, out[200].pseudo_log_likelihood, out[200].per_token) == (0, 0.0, None) and out[201].n_tokens == 0
    assert pseudo_likelihood.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_count_of_the_sample_stays(spark):
    rng = random.Random(4)
    large = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40_000)]
    small = ["qzqzqyk", "zvzvqyk", "qvqvzyk"]
    rows = [(i, " ".join(large[i::80]), "aa", "", 0) for i in range(80)] + [(100 + i, " ".join(small), "zz", "", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(docs, "text", "lang", F.col("doc_id"))
    for size in range(1, language.LONGEST_GRAM + 1):
        want = {(lang, g) for lang, words in (("aa", large), ("zz", small)) for w in words for g in language.grams_of(w, size)}
        got = {(model.languages[model.counts[size].lang[j]], g) for g, i in model.counts[size].at.items()
               for j in range(model.counts[size].start[i], model.counts[size].start[i + 1])}
        assert got == want
    assert set(model.counts[0].at) == set(large) | set(small)
    # words that no row has, known by their n-grams alone
    out = language.predict(spark.createDataFrame([("zvzvqykzvzvqyk qzqzqykk " * 4,)], "text string"), model).first()
    assert out.lang_pred == "zz"


def test_long_runs_teach_their_grams(spark):
    rows = [(i, "日本語文章" * 12, "ja", "", 0) for i in range(3)] + [(10 + i, "中国話句子" * 2, "zh", "", 0) for i in range(6)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA), "text", "lang", F.col("doc_id"))
    assert "日本語文章" in model.counts[5].at and "日本語文章" * 12 not in model.counts[0].at
    assert model.predict("本語文章日本")[0] == "ja" and model.predict("国話句子中")[0] == "zh"


@pytest.mark.parametrize("broadcast", [1 << 16, 3, 0])
def test_words_of_one_code_have_probabilities_of_their_own(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pseudo_likelihood, "BROADCAST_COUNTS", broadcast)
    words = [f"r{i}" for i in range(2000)]
    key = Words(*(lambda d: (np.frombuffer(d, dtype=np.uint8), np.array([0, len(d)])))(" ".join(words).encode())).key
    code = (key % np.uint64(512)).astype(int)
    seven = next(c for c in code if (code == c).sum() >= 3)
    often, some, once = (words[i] for i in np.flatnonzero(code == seven)[:3])
    rows = [(i, " ".join(f"f{j}" for j in range(512)), "", "", 0) for i in range(60)]
    rows += [(100 + i, often, "", "", 0) for i in range(40)] + [(200, f"{some} f1 {some}", "", "", 0), (201, some, "", "", 0), (201, some, "", "", 0)]
    rows += [(300, once, "", "", 0), (None, once.upper(), "", "", 0)]
    out = pseudo_likelihood.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.pseudo_log_likelihood for r in out}
    assert got[100] - got[300] == pytest.approx(np.log(40 / 2), abs=1e-6)
    assert got[201] - got[300] == pytest.approx(np.log(4 / 2), abs=1e-6) and got[None] == pytest.approx(got[300])
    assert len([r for r in out if r.doc_id == 201 and r.pseudo_log_likelihood == pytest.approx(got[201])]) == 2
    # the three words' probabilities are the code's: its logarithm is the score less that of the share
    code_alone = [got[i] - np.log(n / 46) for i, n in ((100, 40), (201, 4), (300, 2))]
    assert max(code_alone) - min(code_alone) < 1e-6


def test_gradient():
    net = pseudo_likelihood.Network(seed=3)
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 1025, (64, 4)) + np.arange(4) * 1025
    target = rng.integers(0, 1024, 64)
    before = net.log_probabilities(rows, target).sum()
    for _ in range(20):
        net.step(rows, target, 0.1)
    assert net.log_probabilities(rows, target).sum() > before


def edits(a, b):
    """Least edits from a to any run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["the", "of", "to"] * 8 + [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 14, 20, 33, 59]))] for _ in range(25)]
    docs = []
    for i in range(240):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        item = list(rng.choice(items))
        for _ in range(rng.randrange(0, 1 + len(item) // 4)):
            at = rng.randrange(len(item))
            kind = rng.randrange(3)
            item[at:at + (kind != 0)] = [] if kind == 1 else ["zz" + str(rng.randrange(9))]
            item = item or ["x"]
        at = rng.randrange(len(words) + 1)
        if i % 2:
            words[at:at] = item
        docs.append(words)
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 == 0 else " ".join(w), "", "", 0) for i, w in enumerate(docs)]
    rows += [(900, None, "", "", 0), (901, "", "", "", 0), (None, " ".join(items[0]), "", "", 0), (1, rows[1][1], "", "", 0)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "  "), (None, "w1 w2 w3 w4 w5"), (3, " ".join(items[3]))]
    got = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=1500).collect()
    found = {(r.doc_id, r.item_id): r.edit_distance for r in got}
    assert len(found) == len(got)
    want = {}
    for i, words in enumerate(docs):
        for j, item in enumerate(items):
            if set(item) & set(words) and (n := edits(item, words)) <= len(item) // 5:
                want[i, j] = n
    assert set(found) <= set(want) and all(found[k] >= want[k] for k in found)
    assert len(set(want) & set(found)) >= 0.97 * len(want)
    exact = [k for k, n in want.items() if n == 0]
    assert exact and all(found.get(k) == 0 for k in exact)


def test_leaks_edges(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f", "", "", 0)], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.without_leaks(docs, none).count() == 1
    item = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    assert decontaminate.leaks(docs, item).collect()[0].first_word == 1
    assert decontaminate.without_leaks(docs, item).count() == 0
    assert decontaminate.leaks(docs.limit(0), item).count() == 0


def test_leaking_rows_without_an_id_go(spark):
    rows = [(None, "a b c d e f", "", "", 0), (None, "x y z", "", "", 0), (None, None, "", "", 0), (1, "a b c d", "", "", 0), (1, "x y", "", "", 0)]
    item = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    left = decontaminate.without_leaks(spark.createDataFrame(rows, SCHEMA), item)
    assert left.columns == ["doc_id", "text", "lang", "lang_pred", "n"]
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None, "x y z"), (None, None), (1, "x y")}


def test_cgk_keeps_close_rows_close():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 62, (200, 40)).astype(np.uint64)
    b = np.concatenate([a[:, 1:], rng.integers(0, 1 << 62, (200, 1)).astype(np.uint64)], axis=1)  # one deletion, one insertion
    c = rng.integers(0, 1 << 62, (200, 40)).astype(np.uint64)
    near = (decontaminate.embed(a, 1) != decontaminate.embed(b, 1)).mean()
    far = (decontaminate.embed(a, 1) != decontaminate.embed(c, 1)).mean()
    assert (a != b).mean() > 0.9 and near < 0.5 < far


def test_deep_nesting_and_closings():
    from attesta.llm import html_text

    for tags in (["div"], ["ul", "li"], ["table", "tr", "td"], ["b", "p"]):
        n = 30_000 // len(tags)
        page = "".join(f"<{t}>" for t in tags) * n + "deep" + "".join(f"</{t}>" for t in reversed(tags)) * n + "<p>after</b></i>"
        lines = [x.strip("•*- ") for x in html_text.render(html_text.build_tree(page)).split("\n") if x.strip("•*- ")]
        assert lines[-1] == "after" and lines[0].endswith("deep") and len(lines) == 2
