import math
import random
import re

from pyspark.sql import functions as F

from attesta.functions import citations as C
from attesta.operators import lineage as L

PARSED = {
    "Code:a.py": ("code_file", "a.py", "", None, None), "Code:a.py#f": ("code_file", "a.py", "f", None, None),
    "Code:a.py#K.f:L4-L9": ("code_file", "a.py", "K.f", 4, 9), "Code:a.py:L4": ("code_file", "a.py", "", 4, None),
    "code:a.py#f#g": ("code_file", "a.py", "f#g", None, None),
}


def test_parse_code_ids(spark):
    df = spark.createDataFrame([(k,) for k in PARSED], "id string").select("id", C.parse_citation_id(F.col("id")).alias("p"))
    for r in df.collect():
        p = r["p"]
        assert (p["type"], p["code_path"], p["code_symbol"], p["start_line"], p["end_line"]) == PARSED[r["id"]]


def test_parse_run_ids(spark):
    ids = ["mlflow:run/r1/metric/auc", "mlflow:run/r1/artifact/p/q.png", "mlflow:run/r1/tag", "mlflow:run/r1", "Exp-Run-2",
           "Exp-Run:plot.png", "a:b", "plain", "E-R:x:y.png"]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", C.parse_citation_id(F.col("id")).alias("p"))
    got = {r["id"]: tuple(r["p"][f] for f in ("type", "run_id", "source_key", "artifact_path", "experiment_name", "run_name"))
           for r in df.collect()}
    assert got["mlflow:run/r1/metric/auc"] == ("mlflow_metric", "r1", "auc", None, None, None)
    assert got["mlflow:run/r1/artifact/p/q.png"] == ("mlflow_artifact", "r1", None, "p/q.png", None, None)
    assert got["mlflow:run/r1/tag"] == ("mlflow_tag", "r1", "", None, None, None)
    assert got["mlflow:run/r1"][0] == got["a:b"][0] == got["plain"][0] == "unknown"
    assert got["Exp-Run-2"] == ("mlflow_run", None, None, None, "Exp", "Run-2")
    assert got["Exp-Run:plot.png"] == ("mlflow_artifact", None, None, "plot.png", "Exp", "Run")
    assert got["E-R:x:y.png"][3:] == ("y.png", "E", "R:x")


def test_extract_and_strip(spark):
    df = spark.createDataFrame([("a [@x; @y] b  [@ z ]\n[@p,@q]",), ("",), (None,)], "t string")
    got = df.select(C.extract_citations(F.col("t")).alias("ids"), C.strip_markers(F.col("t")).alias("clean")).collect()
    assert got[0]["ids"] == ["x", "y", " z ", "p", "q"] and got[0]["clean"] == "a b"
    assert got[1]["ids"] == [] and got[2]["ids"] == []


def test_names(spark):
    df = spark.createDataFrame([("été d'or",), ("__",), ("",), (None,), ("a  b--c",)], "n string")
    assert [r[0] for r in df.select(C.sanitize_name(F.col("n"))).collect()] == ["été_d_or", "Unknown", "Unknown", "Unknown", "a_b--c"]


def test_numbers_share_a_run(spark):
    found = spark.createDataFrame([(1, 0, 0, "b"), (1, 0, 1, "m1"), (1, 2, 0, "m2"), (1, 3, 0, "c"), (1, 9, 0, "b"), (2, 0, 0, "m2")],
                                  "doc_id long, seq long, pos int, citation_id string")
    details = spark.createDataFrame([(1, "m1", "mlflow_metric", "r"), (1, "m2", "mlflow_param", "r"), (1, "c", "mlflow_artifact", "r"),
                                     (2, "m2", "mlflow_param", "r")], "doc_id long, citation_id string, type string, run_id string")
    got = {(r["doc_id"], r["citation_id"]): (r["canonical_id"], r["number"]) for r in L.number_citations(found, details).collect()}
    assert got == {(1, "b"): ("b", 1), (1, "m1"): ("m1", 2), (1, "m2"): ("m1", 2), (1, "c"): ("c", 3), (2, "m2"): ("m2", 1)}


def naive_citations(text, metrics):
    """Every form against the whole text, longest first."""
    forms = {}
    for cid, value in metrics:
        for p in (2, 3, 4, 5):
            f = 10 ** p
            for v in (value, math.ceil(value * f) / f, math.floor(value * f) / f):
                forms[f"{v:.{p}f}"] = cid
        if 0 <= value <= 1:
            for p in (1, 2):
                for tail in ("%", " %", ""):
                    forms[f"{value * 100:.{p}f}{tail}"] = cid
    cited = set()
    for form in sorted(forms, key=len, reverse=True):
        for m in reversed(list(re.finditer(re.escape(form) + r"(?!\d)", text))):
            end = m.end()
            if any(abs(end - at) < 15 for at in cited) or text[end:end + 20].startswith(("[@", " [@")):
                continue
            text = f"{text[:end]}[@{forms[form]}]{text[end:]}"
            cited.add(end)
    return text


def test_metric_citations_match_the_naive_loop(spark):
    metrics = [("E-a", 0.9523), ("E-b", 0.95), ("E-a", -1.256), ("E-c", 12345.678901), ("E-d", 0.0), ("E-e", 1.0)]
    texts = ["accuracy 0.9523 and 0.95 far away from 95.2% or 95.23 % done", "x10.95.95 y 0.952 [@E-a] 95.0", "-1.26 and 1.26 plus -1.25600",
             "value 12345.68, 12345.679 and 112345.68", "0.00 0.000 100.0% 1.00 and more 0.00% text 0.95234567", "", "nothing",
             "0.95[@old] then 0.95 [@old] then, much later in here, 0.95."]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id int, scope string, text string")
    values = spark.createDataFrame([("s", i, c, v) for i, (c, v) in enumerate(metrics)], "scope string, ord int, citation_id string, value double")
    for r in L.cite_metric_values(docs, "id", "scope", "text", values).collect():
        assert r["cited"] == naive_citations(texts[r["id"]], metrics)


def test_metric_citations_in_dense_texts(spark):
    rng, texts = random.Random(3), []
    values = [0.5, 0.05, 11.11, 1.11, -1.11, 0.9999, 95.0, 0.95, 111.11, 5.0, 0.005, 1234567.125]
    metrics = [(f"E-{i}", v) for i, v in enumerate(values)]
    spelled = [f"{v:.{d}f}" for v in values for d in (2, 3, 4, 5)] + [f"{v * 100:.{d}f}" for v in values if 0 <= v <= 1 for d in (1, 2)]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(0, 14)):
            parts.append(rng.choice(spelled) + rng.choice(["", "", "%", " %", "%7", ".11", ".11.11"]))
            parts.append(rng.choice(["", " ", " x ", "[@old]", " [@old]", " a much longer piece of text ", "7", "-", "\n", "é" * 9]))
        texts.append("".join(parts))
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)] + [(900, "other", "0.95"), (901, "s", None)],
                                 "id int, scope string, text string")
    rows = spark.createDataFrame([("s", i, c, v) for i, (c, v) in enumerate(metrics)], "scope string, ord int, citation_id string, value double")
    got = {r["id"]: r["cited"] for r in L.cite_metric_values(docs, "id", "scope", "text", rows).collect()}
    assert got.pop(900) == "0.95" and got.pop(901) is None
    assert sum(t.count("[@E-") for t in got.values()) > 200
    for i, text in enumerate(texts):
        assert got[i] == naive_citations(text, metrics)


def test_metric_citations_broadcast_nothing(spark):
    """Printed forms and chosen places are many times the rows they come from."""
    docs = spark.range(200).selectExpr("id", "id % 20 AS scope", "concat('at ', id, '.50 of 0.25') AS text")
    values = spark.range(200).selectExpr("id % 20 AS scope", "id AS ord", "concat('E-', id) AS citation_id", "id + 0.5D AS value")
    got = L.cite_metric_values(docs, "id", "scope", "text", values)
    assert sum("[@E-" in r["cited"] for r in got.collect()) == 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and plan.count("SortMergeJoin") and "Broadcast" not in plan


def test_citation_details_are_dealt_before_they_are_sorted(spark):
    """The task that joins models with artifacts holds no second sort of all its rows by id."""
    models = spark.createDataFrame([(1, i, f"r{i}", "m", "7", "E x", i != 2) for i in range(4)], "doc_id int, ord int, run_id string, "
                                   "name string, experiment_id string, experiment_name string, has_keys boolean")
    files = spark.createDataFrame([("r1", "a/p.csv"), ("r1", "b/p.csv"), ("r0", "z/p.csv")], "run_id string, path string")
    code = spark.createDataFrame([(1, 1, "t.py", "f")], "doc_id int, ord int, path string, symbol string")
    got = L.citation_details(models, files, code)
    assert sorted((r.citation_id, r.run_id, r.artifact_path) for r in got.collect()) == [
        ("Code:t.py#f", None, None), ("E_x-m", "r3", None), ("E_x-m:p.csv", "r1", "b/p.csv")]
    assert re.search(r"Aggregate [^\n]*\n[^\n]*RepartitionByExpression \[doc_id", got._jdf.queryExecution().optimizedPlan().toString())


def test_render_and_restore_round_trip(spark):
    df = spark.createDataFrame([("see [@a-b] x", ["a-b", "k", "k"])], "t string, extra array<string>")
    row = df.select(C.render_markers(F.col("t"), F.col("extra"), True).alias("r")).first()["r"]
    assert row == "see [a-b](#ref-a-b)<!-- @cite:a-b --> x [k](#ref-k)<!-- @cite:k -->"
    assert spark.createDataFrame([(row,)], "r string").select(C.restore_markers(F.col("r"))).first()[0] == "see [@a-b] x [@k]"


def test_keys_as_whole_words(spark):
    df = spark.createDataFrame([("The AUC, not aucs; f1-score",)], "t string")
    assert df.select(L.match_keys(F.col("t"), ["auc", "aucs!", "f1", "no", "T.e"])).first()[0] == ["auc", "f1"]
