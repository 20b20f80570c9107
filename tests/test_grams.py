"""Pattern and key tables against one pattern at a time."""

import random

from pyspark.sql import functions as F

from attesta.functions.text import matches_patterns
from attesta.operators import grams, lineage as L


def test_pattern_table_against_single_patterns(spark):
    rng = random.Random(6)
    values = ["".join(rng.choice("abc[]x") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "", "abc", "é.b", "a\\Eb"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    for n in (1, 3, 40):
        patterns = ["".join(rng.choice(["a", "b", "c", "x", "ab", "?", "[ab]", "[!a]", "["]) for _ in range(rng.randrange(3, 6))) + rng.choice(["*", "?", ""])
                    for _ in range(n)] + rng.choice([[], ["???"], ["abc", "[a]"], ["é?b", "a\\E*"], ["[!a]*[bc]"]])
        table = spark.createDataFrame([(p,) for p in patterns + patterns[:1] + [None]], "pattern string")
        got = sorted(r["id"] for r in grams.match_pattern_table(df, "v", table).collect())
        assert got == sorted(r["id"] for r in df.filter(matches_patterns(F.col("v"), patterns)).collect()), patterns
    assert grams.match_pattern_table(df, "v", table.limit(0)).count() == 0 == grams.match_pattern_table(df.limit(0), "v", table).count()


def test_pattern_table_of_many_patterns(spark):
    df = spark.range(5000).select(F.concat(F.lit("model_"), F.col("id").cast("string")).alias("v"))
    table = spark.range(10_000).select(F.concat(F.lit("model_"), (F.col("id") * 3).cast("string"), F.when(F.col("id") % 2 == 0, "?").otherwise("")).alias("pattern"))
    want = {f"model_{i}" for i in range(5000) if i % 3 == 0 and i // 3 % 2 == 1 or i >= 10 and i // 10 % 3 == 0 and i // 30 % 2 == 0}
    assert {r["v"] for r in grams.match_pattern_table(df, "v", table).collect()} == want


def test_literal_pieces():
    assert grams.literal_pieces("a*b?[cd]ef[") == ["a", "b", "ef["] and grams.literal_pieces("*??") == []


def test_key_table_against_single_keys(spark):
    rng = random.Random(7)
    words = ["AUC", "auc", "f1-score", "f1", "x.y", "Über", "a", "a b", "!!", "b!", "(c)", "\\E", "d\\E", "model_1", " "]
    texts = [rng.choice(["", " ", "-"]).join(rng.choice([*words, " ", ", ", "zz"]) for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    keys = [*words, "missing key", "über", "a  b", "f1 auc"]
    table = spark.createDataFrame([(k,) for k in [*keys, keys[0], None, ""]], "key string")
    got = sorted(map(tuple, grams.match_key_table(docs, "id", "t", table).collect()))
    plain = docs.select("id", F.explode(L.match_keys(F.col("t"), [k for k in keys if "\\E" not in k])).alias("key")).collect()
    assert [g for g in got if "\\E" not in g[1]] == sorted(map(tuple, plain)) and len(got) > 200
    assert grams.match_key_table(docs, "id", "t", table.limit(0)).count() == 0


def test_keys_of_two_words_are_looked_up_together(spark):
    runs = spark.createDataFrame([("B, a b",), ("a",), ("",), (None,)], "t string").select(grams._tokens(F.col("t")).alias("_tokens"))
    got = [r[0] for r in runs.select(grams._windows(F.array(F.lit(1), F.lit(3)))).collect()]
    assert got[:3] == [["b", ",", " ", "a", "b, ", ", a", " a ", "a b"], ["a"], []] and not got[3]
    words = [f"w{i}" for i in range(40)]
    keys = spark.createDataFrame([(f"{a} {b}",) for a in words for b in words], "key string")
    rng = random.Random(9)
    texts = [[rng.choice(words) for _ in range(60)] for _ in range(50)]
    docs = spark.createDataFrame([(i, " ".join(t).upper()) for i, t in enumerate(texts)], "id int, t string")
    want = {(i, f"{a} {b}") for i, t in enumerate(texts) for a, b in zip(t, t[1:])}
    assert {tuple(r) for r in grams.match_key_table(docs, "id", "t", keys).collect()} == want


def test_patterns_are_looked_up_by_long_literals(spark, monkeypatch):
    asked, real = [], grams.explode_grams
    monkeypatch.setattr(grams, "explode_grams", lambda df, *a: asked.append(real(df, *a)) or asked[-1])
    df = spark.range(3000).select(F.format_string("model_%06d", "id").alias("v"))
    table = spark.range(3000).select(F.format_string("*_%06d?", "id").alias("pattern")).unionByName(
        spark.range(100).select(F.format_string("*%06d", "id").alias("pattern")))
    assert grams.match_pattern_table(df, "v", table).count() == 100
    of_globs = {r["gram"] for r in asked[0].select("gram").distinct().collect()}
    assert {"_000000", "000099"} <= of_globs and min(map(len, of_globs)) == 6  # a gram each, held by few values
