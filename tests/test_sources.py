import base64
import json

import pytest
from pyspark.sql import functions as F

from attesta import schemas
from attesta.functions.text import clip
from attesta.operators.corpus import is_binary
from attesta.session import materialise, scratch_path, shared_root
from attesta.sources import files as FS, tables as TB


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a tree"
    (root / "tests").mkdir(parents=True)
    (root / "train.py").write_text("import os\n")
    (root / "tests" / "test_train.py").write_text("x = 1\n")
    (root / "nul.py").write_bytes(b"a\x00b")
    (root / "bad.py").write_bytes(b"ok \xff\xfe end")
    (root / "model.R").write_text("x <- 1")
    (root / "model.pkl").write_bytes(b"\x80")
    (root / "README.md").write_text("# Read me")
    return root


def test_scan_by_exact_extension(spark, tree):
    found = FS.scan_source_files(spark, str(tree), "Python")
    assert {r["path"] for r in found.select("path").collect()} == {"train.py", "tests/test_train.py", "nul.py", "bad.py"}
    text = {r["path"]: r["t"] for r in found.filter(~is_binary(F.col("path"), F.col("content"))).select(
        "path", FS.utf8_text(F.col("content")).alias("t")).collect()}
    assert text["bad.py"] == "ok  end" and "nul.py" not in text
    assert {r["path"] for r in FS.scan_source_files(spark, str(tree), "r").collect()} == {"model.R"}


def test_scan_lists_in_tasks(spark, tree):
    deep = tree / "b" / "c=1" / "d" / "e f"
    deep.mkdir(parents=True)
    (deep / "deep.py").write_text("y")
    (tree / "b" / "empty.py").write_text("")
    (tree / "b" / "_metadata.py").write_text("m")
    for hidden in (".git/a.py", "_tmp/b.py", "b/_c.py", "b/.d.py"):
        (tree / hidden).parent.mkdir(exist_ok=True)
        (tree / hidden).write_text("z")
    found = FS.scan_files(spark, str(tree))
    assert "InMemoryFileIndex" not in found._jdf.queryExecution().executedPlan().toString()  # the driver listed every file
    sizes = {r["path"]: (r["size"], len(r["content"])) for r in found.collect()}
    assert sizes["b/c=1/d/e f/deep.py"] == (1, 1) and sizes["b/empty.py"] == (0, 0) and sizes["b/_metadata.py"] == (1, 1)
    assert set(sizes) == {"b/c=1/d/e f/deep.py", "b/empty.py", "b/_metadata.py", "train.py", "tests/test_train.py", "nul.py", "bad.py",
                          "model.R", "model.pkl", "README.md"}


def test_parse_artifacts(spark):
    rows = [("a.csv", b'f,v\n"x, ""y""",1\nz,2\n'), ("n.txt", "é".encode()), ("p.PNG", b"no"), ("p.jpeg", b"\x01\x02"), ("q.csv", None), ("e.csv", b"")]
    got = {r["path"]: r for r in FS.parse_artifacts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(got) == {"a.csv", "n.txt", "p.jpeg", "e.csv"}
    assert got["a.csv"]["records"] == [{"f": 'x, "y"', "v": "1"}, {"f": "z", "v": "2"}]
    assert got["n.txt"]["text"] == "é" and got["p.jpeg"]["image_format"] == "jpeg"
    assert base64.b64decode(got["p.jpeg"]["image_base64"]) == b"\x01\x02"


def test_readme_choice_and_cut(spark):
    df = spark.createDataFrame([("p", "README", "late"), ("p", "README.rst", "x" * 5001), ("q", "docs/README.md", "no")], "project string, path string, content string")
    rows = FS.pick_readme(df).collect()
    assert len(rows) == 1 and rows[0]["readme"] == "x" * 5000 + "\n... (truncated)"
    assert df.select(clip(F.lit("abc"), 3, "!")).first()[0] == "abc"


def test_listings(spark):
    df = spark.createDataFrame([("sub/a.YML", None, False, 0, 256, "t"), ("", "b.yaml", False, 128, None, None), ("c.txt", None, False, 1, None, None),
                                ("sub/dir", None, True, None, None, None)], "file_name string, label string, is_directory boolean, size long, name_size long, last_modified string")
    listed = FS.list_dataset_files(df, "sub/")
    assert {(r["file_name"], r["size_in_bytes"]) for r in listed.collect()} == {("a.YML", 256), ("b.yaml", 128), ("dir", 0)}
    assert {(r["path"], r["size_kb"]) for r in FS.list_specs(listed, "specs").collect()} == {("specs/a.YML", 0.2), ("specs/b.yaml", 0.1)}
    path = spark.range(1).select(FS.safe_spec_path(F.lit(r"..\x/../evil.yaml"), "specs")).first()[0]
    assert path.startswith("specs/") and path.endswith("_evil.yaml") and path.count("/") == 1


def test_cache_file_of_another_writer(spark, tmp_path):
    body = {"spec": {"title": "t", "authors": "a", "sections": [{"name": "s", "per_model": True, "hint": None}]},
            "results": [{"plan": {"number": "1", "name": "s", "title": "S", "content_blocks": [{"type": "table", "purpose": "p"}]},
                         "contents": [{"block_type": "chart", "content": base64.b64encode(b"\x89PNG").decode(), "content_encoding": "base64", "metadata": {"a": "1"}},
                                      {"block_type": "bullet_list", "content": ["x", "y"]}], "errors": ["e"]}]}
    (tmp_path / "c.json").write_text(json.dumps(body, indent=2))
    row = TB.load_results_cache(spark, str(tmp_path / "c.json"), multiline=True).select(
        "spec", F.col("results")[0]["contents"]["bytes"].alias("b"), F.col("results")[0]["plan"]["content_blocks"][0]["priority"].alias("p")).first()
    assert row["spec"]["citation_style"] == "numeric" and row["spec"]["hints"] == {} and bytes(row["b"][0]) == b"\x89PNG" and row["b"][1] is None
    assert row["p"] == "required"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        TB.load_results_cache(spark, str(tmp_path / "none.json"))


def test_notebook_file(spark, tmp_path):
    cells = [{"cell_type": "markdown", "source": ["# A\n", "b"], "metadata": {}}, {"cell_type": "code", "source": "x = 1", "outputs": []}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells, "nbformat": 4}, indent=1))
    got = [(r["cell_no"], r["cell_type"], r["source"]) for r in TB.read_notebooks(spark, str(tmp_path / "n.ipynb")).orderBy("cell_no").collect()]
    assert got == [(0, "markdown", "# A\nb"), (1, "code", "x = 1")]


def test_csv_schema_is_explicit(spark, tmp_path):
    row = {f.name: None for f in schemas.CHURN.fields} | {"customer_id": "c, \"1\"", "monthly_charges": 1.5, "churned": 1}
    df = spark.createDataFrame([row], schemas.CHURN)
    TB.write_csv_table(df, str(tmp_path / "t"))
    back = TB.read_csv_table(spark, str(tmp_path / "t"), schemas.CHURN)
    assert back.schema == schemas.CHURN and back.exceptAll(df).count() == 0


def test_scratch_folder_follows_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert materialise(spark.range(3), "r").count() == 3
