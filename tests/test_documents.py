import json

from pyspark.sql import Window, functions as F

from attesta.operators import documents as D
from attesta.plans import documents as plans


def test_spec_errors(spark):
    cases = {
        "[1]": ["Spec file must be a YAML mapping (key: value pairs), not a list"],
        "null": ["Spec file must be a YAML mapping (key: value pairs), not a NoneType"],
        "1.5": ["Spec file must be a YAML mapping (key: value pairs), not a float"],
        "{": ["Invalid YAML syntax at line 1, column 2: expected the node content, but found '<stream end>'"],
        "{}": ["Missing required field: 'title'", "Missing required field: 'sections'"],
        json.dumps({"title": "t" * 501, "sections": ["a"] * 51}):
            ["'title' is too long (501 characters, max 500)", "Too many sections (51). Maximum is 50."],
        json.dumps({"title": None, "sections": {"a": 1}}): ["'title' must be a non-empty string", "'sections' must be a list"],
        json.dumps({"title": "ok", "sections": ["A", ": per_model", {"name": ""}, True], "hints": [], "formatting": {}}):
            ["Section 2: name must not be empty", "Section 3: 'name' must be a non-empty string",
             "Section 4: must be a string or mapping, got bool", "'hints' must be a mapping of section name to hint text"],
        json.dumps({"title": "ok", "sections": ["A: per_model", {"name": "B", "hint": 5}]}): [],
    }
    df = spark.createDataFrame(list(cases.items()), "body string, want array<string>")
    for r in D.validate_specs(df).collect():
        assert r["errors"] == r["want"], r["body"]


def test_yaml_bodies_are_dealt_and_read_alike(spark):
    cases = ["a: b\n- c", "title: 'x'\nsections:\n- A\n- name: B\n  per_model: yes", "x: \t|\n", "- ! ", "\n\ufeff|-\n", "- " * 600 + "x", "- " * 20 + "x",
             "a: >\n  b\n  c", "d: 2020-01-01", "k: &a [1]\nl: *a", "? a\n: b", "t: [x", "n: 0x1f\nm: 1_0", "", "é: 日", "a: 1\ra: 2"]
    fast = [D._as_json(c) for c in cases]
    known, D.yaml.__with_libyaml__ = D.yaml.__with_libyaml__, False
    try:
        assert fast == [D._as_json(c) for c in cases]
    finally:
        D.yaml.__with_libyaml__ = known
    body = "title: ok\nsections:\n- A: per_model\nhints:\n  A: " + "h" * 20
    few = spark.range(3, numPartitions=1).select(F.col("id").alias("spec_id"), F.lit("p").alias("project"), F.concat(
        F.lit("title: ok\nsections:\n- A"), F.col("id").cast("string")).alias("body"))
    sections = D.parse_sections(few)
    plan = sections._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan  # one file was one task
    assert plan.count("as_json(") == 1  # the filter for specs that have sections parsed every body a second time
    assert sorted(r["name"] for r in sections.collect()) == ["A0", "A1", "A2"]


def test_sections_without_models_stay_generic(spark):
    body = json.dumps({"title": "t", "sections": ["A", "M: per_model", {"name": "Z", "hint": "own"}], "hints": {"M": "hm", "Z": "hz"}})
    specs = D.parse_specs(spark.createDataFrame([(1, "p", body), (2, "q", body)], "spec_id int, project string, body string"))
    models = spark.createDataFrame([("p", i, f"m{i}", f"r{i}") for i in range(1, 12)], "project string, ord int, name string, run_id string")
    out = D.expand_sections(specs, models)
    p = {r["number"]: (r["name"], r["model_name"], r["hint"]) for r in out.filter("spec_id = 1").collect()}
    assert len(p) == 13 and p["2.10"] == ("M", "m10", "hm") and p["3"] == ("Z", None, "own")
    assert {r["number"] for r in out.filter("spec_id = 2").collect()} == {"1", "2", "3"}
    order = [r["number"] for r in D.section_positions(out.filter("spec_id = 1"), "spec_id").orderBy("position").collect()]
    assert order == ["1"] + [f"2.{i}" for i in range(1, 12)] + ["3"]
    assert [r["number"] for r in D.order_sections(out.filter("spec_id = 1")).collect()] == order


def test_sections_meet_models_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "MODELS_PER_ROW", 2)
    body = json.dumps({"title": "t", "sections": ["A", "B: per_model", {"name": "C", "per_model": True, "hint": "own"}], "hints": {"A": "a", "C": "c"}})
    projects = ["p", "q", "r", None, "p"]
    specs = spark.createDataFrame([(i, x, body) for i, x in enumerate(projects)] + [(9, "p", json.dumps({"title": "none"}))],
                                  "spec_id int, project string, body string")
    models = [("p", 7, "g", "run7"), ("p", 1, "a", "run1"), ("p", 5, None, "run5"), ("p", 3, "c", None), ("p", 6, "f", "run6"), ("q", 2, "b", "run2"),
              ("z", 1, "z", "runz"), (None, 1, "n", "runn")]
    out = D.expand_sections(D.parse_specs(specs), spark.createDataFrame(models, "project string, ord int, name string, run_id string"))
    want = []
    for i, x in enumerate(projects):
        of = sorted(m[1:] for m in models if x is not None and m[0] == x)
        want.append((i, "1", "A", None, None, "a"))
        for pos, name, hint in (("2", "B", None), ("3", "C", "own")):
            want += [(i, f"{pos}.{j}", name, m[1], m[2], hint) for j, m in enumerate(of, 1)] or [(i, pos, name, None, None, hint)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_many_specs_of_few_models_are_expanded_by_many_tasks(spark):
    body = json.dumps({"title": "t", "sections": ["A: per_model", "B: per_model"]})
    specs = spark.range(400, numPartitions=4).select(F.col("id").alias("spec_id"), F.lit("p").alias("project"), F.concat(
        F.lit(body), F.repeat(F.lit(" "), (F.col("id") % 2).cast("int"))).alias("body"))
    models = spark.createDataFrame([("p", 1, "m", "run")], "project string, ord int, name string, run_id string")
    out = D.expand_sections(D.parse_specs(specs), models)
    tasks = [r["count"] for r in out.filter("model_name = 'm'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 800 and max(tasks) < 400
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as_json(") == 1  # bodies are read once


def test_positions_with_ties_and_odd_numbers(spark):
    numbers = ["10", "2.10", "2.9", "2", "1.3.7", "1.0", "1", "1", "2.2000", "2.1000", "2.999"]
    df = spark.createDataFrame([(d, n) for d in ("a", "b", None) for n in numbers[:len(numbers) if d == "a" else 8]], "doc string, number string")
    for dealt in (False, True):
        out = D.section_positions(df, "doc", dealt=dealt)
        assert dict(out.dtypes)["position"] == "bigint" and out.columns == ["doc", "number", "position"]
        for d in ("a", "b", None):
            got = sorted((r["position"], [int(x) for x in [*r["number"].split("."), "0"][:2]]) for r in out.filter(F.col("doc").eqNullSafe(d)).collect())
            keys = [k for _, k in got]
            assert [p for p, _ in got] == list(range(1, len(numbers) + 1 if d == "a" else 9)) and keys == sorted(keys)


def test_expanded_sections_are_numbered_where_they_are_made(spark):
    out = plans.f04(spark, "/root/testdata/sf0.001")
    above = out._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Window" in above and "Join" not in above and "Exchange" not in above
    rows = out.select("spec_id", "position", F.count(F.lit(1)).over(Window.partitionBy("spec_id")).alias("n"))
    assert rows.agg(F.count_distinct("spec_id", "position"), F.max(F.col("position") - F.col("n"))).first()[:] == (out.count(), 0)


def test_first_number_in_json(spark):
    cases = [("1", 1.0), ("true", 1.0), ("null", None), ('"2_5"', 25.0), ('"nan x"', None), ('{"9": "x", "b": [null, "7"]}', 7.0),
             ('["a:", "8"]', 8.0), ('-1.5e2', -150.0), ('{"a\\"": 1}', 1.0), ("[]", None), ('"inf"', float("inf"))]
    df = spark.createDataFrame([(c[0],) for c in cases], "j string")
    got = {r["j"]: r["n"] for r in df.select("j", D.coerce_numeric(F.col("j")).alias("n")).collect()}
    assert got == dict(cases)


def test_series_and_placeholders(spark):
    df = spark.createDataFrame([([], ["1", '"x"', "3"]), (["a", "b"], ["5"]), (["a"], [])], "l array<string>, v array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(D.chart_series(F.col("l"), F.col("v"))).collect()]
    assert got == [[("1", 1.0), ("3", 3.0)], [("a", 5.0)], []]
    rows = spark.createDataFrame([([{"a": " N/A "}, {"b": "—"}],), ([{"a": "0"}],), ([],), (None,), ([{"a": None}],)], "r array<map<string,string>>")
    assert [r[0] for r in rows.select(D.table_has_content(F.col("r"))).collect()] == [False, True, False, False, False]


def test_notebook_sections_and_cells(spark):
    cells = [("markdown", "# Title\nAuthors: me"), ("code", "DOCUMENT_TITLE = 'T'"), ("markdown", "early"), ("markdown", "## 1. One\nbody"),
             ("markdown", ""), ("markdown", "---"), ("markdown", "1. a\n\n2. b"), ("code", "x = 1"), ("code", "# Cap\ntable_data = [{'a': 1}]"),
             ("markdown", "## 2.3. Two"), ("markdown", "- a\ntext"), ("markdown", "## References\n"), ("code", "NotebookExporter()")]
    df = spark.createDataFrame([("n", i, k, s) for i, (k, s) in enumerate(cells)], "notebook string, cell_no int, cell_type string, source string")
    got = [(r["cell_no"], r["number"], r["title"], r["block_type"], r["items"])
           for r in D.classify_cells(D.notebook_sections(df)).orderBy("cell_no").collect()]
    assert got == [(4, "1", "One", "bullet_list", []), (6, "1", "One", "numbered_list", ["a", "b"]), (7, "1", "One", None, None),
                   (8, "1", "One", "table", None), (10, "2.3", "Two", "narrative", None)]
    data = D.recover_cell_data(df.filter("cell_no IN (1, 8)")).orderBy("cell_no").collect()
    assert data[0]["doc_title"] == "T" and data[1]["caption"] == "Cap" and data[1]["rows"] == [{"a": "1"}]
