import fnmatch
import re

from pyspark.sql import functions as F

from attesta.functions.numbers import fixed, round_binary
from attesta.functions.text import matches_patterns, safe_float, safe_int
from attesta.operators import registry as G


def test_version_ten_beats_nine(spark):
    df = spark.createDataFrame([("m", "9", "a"), ("m", "10", "b"), ("m", "x", "c"), ("n", "y", "d")],
                               "name string, version string, run_id string")
    assert {r["name"]: r["version"] for r in G.latest_only(df).collect()} == {"m": "10", "n": "y"}


def test_patterns_follow_shell_rules(spark):
    names = ["churn_1", "churn_", "Churn_1", "price", "a[b", "ab", "a-b", "x.y"]
    patterns = ["churn_*", "c?urn_1", "price", "a[!x]b*", "x.?", "[ab]*-b", "a[b"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for p in patterns:
        got = {r[0] for r in df.filter(matches_patterns(F.col("name"), [p])).collect()}
        want = {n for n in names if (fnmatch.fnmatchcase(n, p) if set("*?") & set(p) else n == p)}
        assert got == want, p


def test_model_without_logged_run_is_invisible_with_patterns(spark):
    experiments = spark.createDataFrame([("1", "e", "active", {}), ("2", "gone", "deleted", {})],
                                        "experiment_id string, name string, lifecycle_stage string, tags map<string,string>")
    runs = spark.createDataFrame([("r1", "1", {"mlflow.log-model.history": "x"}), ("r2", "1", {"mlflow.log-model.history": ""}),
                                  ("r3", "2", {"mlflow.log-model.history": "x"}), ("r4", "1", {"o": "1"})],
                                 "run_id string, experiment_id string, tags map<string,string>")
    versions = spark.createDataFrame([("m1", "1", "None", "r1"), ("m2", "1", "None", "r2"), ("m3", "1", "None", "r3"), ("m4", "1", "None", "r4")],
                                     "name string, version string, current_stage string, run_id string")
    targets = G.target_experiments(experiments)

    def names(patterns):
        return {r["name"] for r in G.matching_versions(versions, runs, experiments, targets, patterns).collect()}

    assert names(["m*"]) == {"m1"} and names([]) == {"m1", "m2", "m4"}


def test_match_image_prefers_the_purpose(spark):
    images = spark.createDataFrame([("s", 1, "a/loss.png"), ("s", 2, "a/ROC.png"), ("s", 3, "a/Importance.png"), ("t", 1, "z.png")],
                                   "scope string, seq long, path string")
    blocks = spark.createDataFrame([(1, "s", "roc curve", None), (2, "s", "feature plot", "loss"), (3, "s", "nothing", None),
                                    (4, "t", "roc", ""), (5, "u", "roc", None)], "id int, scope string, purpose string, image_name string")
    got = {r["id"]: (r["path"], r["matched"]) for r in G.match_image(blocks, images).collect()}
    assert got == {1: ("a/ROC.png", True), 2: ("a/loss.png", True), 3: ("a/loss.png", False), 4: ("z.png", False), 5: (None, False)}


def test_names_are_looked_up_by_their_rarest_gram(spark):
    paths = [("s", i, f"the/other_{i}.png") for i in range(300)] + [("t", 0, "the/x.png"), (None, 0, "the/n.png"), ("t", 1, None)]
    images = spark.createDataFrame(paths, "scope string, seq long, path string")
    wanted = [("s", "other_123"), ("s", "the"), ("s", "x"), ("s", "99"), ("s", "other_7"), ("t", "other"), ("t", "x."), ("u", "the"),
              ("s", "r_299.png"), ("s", "other_300")]
    names = spark.createDataFrame(wanted, "scope string, _name string")
    got = {(r["scope"], r["_name"]): (r["gram"], r["n"]) for r in G.rarest_grams(names, images).collect()}
    assert got == {("s", "other_123"): ("123", 1), ("s", "the"): ("the", 600), ("s", "99"): ("99", 3), ("s", "other_7"): ("r_7", 11),
                   ("t", "x."): ("x.", 1), ("s", "r_299.png"): ("299", 1)}
    blocks = spark.createDataFrame([(i, s, "nothing", n.upper()) for i, (s, n) in enumerate(wanted)] + [(99, None, "x", "n")],
                                   "id int, scope string, purpose string, image_name string")
    for row in G.match_image(blocks, images.select("scope", "seq", "path")).collect():
        fits = sorted((seq, path) for scope, seq, path in paths if scope is not None and scope == row["scope"] and path and row["image_name"].lower() in path)
        if fits:
            assert (row["path"], row["matched"]) == (fits[0][1], True)
        else:
            assert not row["matched"]


def test_titles_and_aliases(spark):
    df = spark.createDataFrame([("p/roc_curve-2nd o'neil.v1.png", "")], "path string, title string")
    assert df.select(G.image_title(F.col("path"), F.col("title"))).first()[0] == "roc_curve-2nd o'neil.v1".replace("_", " ").replace("-", " ").title()
    versions = spark.createDataFrame([("m", "1", "Staging", 1), ("m", "2", "staging", 2), ("m", "3", "None", 3)],
                                     "name string, version string, current_stage string, at int")
    assert [tuple(r) for r in G.assign_aliases(versions, ["at"]).collect()] == [("m", "staging", "2")]


def test_numbers_print_like_exact_binaries(spark):
    values = [0.125, 0.135, 2.675, 1e13 + 0.3, -0.5, 0.95, 123456.785]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", fixed(F.col("v"), 2).alias("t"), round_binary(F.col("v"), 1).alias("r")).collect()
    for r in rows:
        assert r["t"] == f"{r['v']:.2f}" and r["r"] == round(r["v"], 1)


def test_number_texts(spark):
    def parsed(kind, text):
        try:
            return kind(text)
        except ValueError:
            return None

    texts = ["", " 12 ", "1_0", "1__0", "abc", "1e3", "inf", "-.5", "1d", "0x1", "٣", "5.", "+7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", safe_int(F.col("t")).alias("i"), safe_float(F.col("t")).alias("f")).collect():
        if r["t"] != "٣":  # other digit scripts are not read
            assert (r["i"], r["f"]) == (parsed(int, r["t"]), parsed(float, r["t"])), r["t"]


def test_paths_that_no_name_can_hold_go_before_any_exchange(spark):
    images = spark.range(2000).selectExpr("concat('s', id % 50) AS scope", "id AS seq", "concat('plots/roc_', id, '.png') AS path")
    names = spark.createDataFrame([("s1", "c_51."), ("s2", "_152."), ("s2", "none")], "scope string, _name string")
    found = G._first_named(names, images)
    assert {tuple(r) for r in found.select("scope", "_name", "_named.seq").collect()} == {("s1", "c_51.", 51), ("s2", "_152.", 152)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"BroadcastHashJoin \[scope#\d+\], \[scope#\d+\], LeftSemi", plan)
    assert re.search(r"BroadcastHashJoin \[scope#\d+, gram#\d+\], \[scope#\d+, gram#\d+\], LeftSemi", plan)
