"""Family A: round trips through the shared folder, and listings made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from attesta import schemas
from attesta.plans import corpus as C, registry as P
from attesta.plans.catalog import bind, plain, query, table
from attesta.session import scratch_path
from attesta.sources import files as FS, tables as TB


@query("a01_scan_source_files", C.WITH + """SELECT language, path, strlen(content)::BIGINT AS size,
  len(content) - len(replace(content, chr(10), '')) + 1 AS n_lines FROM files""")
def a01(spark, sf_dir):
    root = scratch_path(spark, "tree")
    FS.write_files(C.files(spark, sf_dir), root).agg(F.sum("size")).collect()  # one number: the tree is written
    found = None
    for language in ("python", "r", "sas", "matlab"):
        part = FS.scan_source_files(spark, root, language).withColumn("language", F.lit(language))
        found = part if found is None else found.unionByName(part)
    text = FS.utf8_text(F.col("content"))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return found.select("language", "path", "size", lines.alias("n_lines"))


TABLE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                      T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("a05_read_csv_table", "SELECT event_id, event_type, value, props FROM events")
def a05(spark, sf_dir):
    path = scratch_path(spark, "csv")
    TB.write_csv_table(table(spark, sf_dir, "events").select(*TABLE.names), path)
    return TB.read_csv_table(spark, path, TABLE)


@query("a05_read_csv_multiline", "SELECT doc_id, text FROM documents")
def a05_multiline(spark, sf_dir):
    path = scratch_path(spark, "csv")
    TB.write_csv_table(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return TB.read_csv_table(spark, path, schema, multiline=True)


@query("a06_write_csv_table", """SELECT 'o_orderkey,o_orderstatus,o_totalprice' AS header, count(*) AS n_rows FROM orders""")
def a06(spark, sf_dir):
    path = scratch_path(spark, "csv")
    TB.write_csv_table(bind(spark, sf_dir, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders}"), path)
    lines = spark.read.text(path)
    is_header = F.col("value").startswith("o_")
    return lines.agg(F.max(F.when(is_header, F.col("value"))).alias("header"), F.count_if(~is_header).alias("n_rows"))


ARTIFACT_FILES = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('f', cast(l_partkey AS string), CASE l_linenumber
  WHEN 1 THEN '.csv' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' WHEN 4 THEN '.JPG' WHEN 5 THEN '.jpeg' ELSE '.bin' END) AS path,
  CASE WHEN l_linenumber > 1 OR l_orderkey % 8 > 4 THEN concat('feature,importance', chr(10), '"a,', l_returnflag, '",',
    cast(l_suppkey AS string), chr(10), 'b,2', chr(10)) WHEN l_orderkey % 8 = 0 THEN concat('feature,importance', chr(10), 'x,1,', cast(l_suppkey AS string), chr(10))
    WHEN l_orderkey % 8 = 1 THEN concat('feature,feature', chr(10), 'a,', cast(l_suppkey AS string), chr(10))
    WHEN l_orderkey % 8 = 2 THEN concat('feature,importance', chr(13), chr(10), '"p', chr(10), 'q",', chr(10), chr(10), 'r')
    WHEN l_orderkey % 8 = 3 THEN '' ELSE concat('feature,importance', chr(10), '"open,', l_returnflag) END AS body FROM {lineitem}"""


@query("a07_read_artifacts", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN 'csv' WHEN 2 THEN 'text'
    ELSE 'image' END AS kind, CASE WHEN l_linenumber = 2 THEN body END AS text,
  CASE WHEN l_linenumber = 1 THEN CASE l_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('feature=a,feature.1=', l_suppkey)
    WHEN 2 THEN concat('feature=p', chr(10), 'q,importance=?;feature=r,importance=?') WHEN 3 THEN NULL WHEN 4 THEN NULL
    ELSE concat('feature=', substr(body, 21, 3), ',importance=', l_suppkey, ';feature=b,importance=2') END END AS records,
  l_linenumber = 1 AND l_orderkey % 8 IN (0, 3, 4) AS parse_failed,
  CASE l_linenumber WHEN 3 THEN 'png' WHEN 5 THEN 'jpeg' END AS image_format,
  CASE WHEN l_linenumber IN (3, 5) THEN to_base64(encode(body)) END AS image_base64
  FROM ({plain(ARTIFACT_FILES)}) WHERE l_linenumber IN (1, 2, 3, 5)""")
def a07(spark, sf_dir):
    df = bind(spark, sf_dir, ARTIFACT_FILES).withColumn("content", F.encode("body", "UTF-8"))
    out = FS.parse_artifacts(df)
    pairs = F.transform("records", lambda r: F.array_join(F.transform(F.map_entries(r), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?")))), ","))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", "text",
                      F.array_join(pairs, ";").alias("records"), "parse_failed", "image_format", "image_base64")


@query("a08_list_artifacts", P.CTES + "SELECT run_id, path FROM artifacts WHERE NOT is_dir")
def a08(spark, sf_dir):
    return FS.list_artifacts(P.artifacts(spark, sf_dir))


LISTING = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('docs/', url, '.YAML') WHEN 1 THEN concat('docs/', url) WHEN 2 THEN ''
    ELSE concat('other/', url, '.yml') END AS file_name, concat('l', cast(page_id AS string), '.yaml') AS label, page_id % 8 = 1 AS is_directory,
  CASE WHEN page_id % 3 > 0 THEN page_id * 131 END AS size, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN page_id END AS name_size,
  CASE WHEN page_id % 5 > 0 THEN cast(page_id AS string) END AS last_modified FROM {pages}"""
_LISTED = f"""SELECT page_id, CASE WHEN starts_with(n, 'docs/') THEN substr(n, 6) ELSE n END AS file_name, is_directory,
  coalesce(nullif(size, 0), name_size, 0) AS size_in_bytes, last_modified FROM (SELECT *, coalesce(nullif(file_name, ''), label, '') AS n
  FROM ({plain(LISTING)})) WHERE is_directory OR lower(n) LIKE '%.yaml' OR lower(n) LIKE '%.yml'"""


@query("a09_list_dataset_files", f"SELECT file_name, is_directory, size_in_bytes, last_modified FROM ({_LISTED})")
def a09(spark, sf_dir):
    return FS.list_dataset_files(bind(spark, sf_dir, LISTING), "docs/")


@query("a10_list_specs", f"""SELECT file_name AS name, concat('specs/', file_name) AS path, round_even(size_in_bytes / 1024, 1) AS size_kb,
  coalesce(last_modified, '') AS created_at FROM ({_LISTED}) WHERE NOT is_directory""")
def a10(spark, sf_dir):
    return FS.list_specs(FS.list_dataset_files(bind(spark, sf_dir, LISTING), "docs"), "specs")


@query("a11_safe_spec_path", r"""SELECT page_id, concat('specs/', md5(url), '_', regexp_extract(CASE WHEN page_id % 2 = 0 THEN
  replace(url, '/', '\') ELSE url END, '[^/\\]*$')) AS path FROM pages""")
def a11(spark, sf_dir):
    name = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("/"), F.lit("\\"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", FS.safe_spec_path(name, "specs", F.md5("url")).alias("path"))


READMES = """SELECT conv_id AS project, CASE turn WHEN 0 THEN 'src/README.md' WHEN 1 THEN 'README' WHEN 2 THEN 'README.txt'
  WHEN 3 THEN 'README.rst' WHEN 4 THEN 'README.md' ELSE 'main.py' END AS path,
  concat(text, repeat('x', cast(turn * 2000 AS int))) AS content FROM {conversations}"""


@query("a12_pick_readme", f"""SELECT project, CASE WHEN length(content) > 5000 THEN substr(content, 1, 5000) || chr(10) || '... (truncated)'
  ELSE content END AS readme FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY list_position(['README.md', 'README.rst',
  'README.txt', 'README'], path)) AS rn FROM ({plain(READMES)}) WHERE path IN ('README.md', 'README.rst', 'README.txt', 'README')) WHERE rn = 1""")
def a12(spark, sf_dir):
    return FS.pick_readme(bind(spark, sf_dir, READMES))


def _cached(spark, sf_dir):
    """Every document is a one-section result whose content is text, a list, a table or bytes."""
    docs = bind(spark, sf_dir, "SELECT doc_id, lang, source, text, doc_id % 4 AS kind FROM {documents}")
    kind, none = F.col("kind"), F.lit(None).cast("string")
    value = TB.content_value(F.when(kind == 0, F.col("text")), F.when(kind == 1, F.split("text", "\n")),
                             F.when(kind == 2, F.to_json(F.struct("lang", "source"))), F.when(kind == 3, F.encode("text", "UTF-8")))
    block_type = F.when(kind == 0, "narrative").when(kind == 1, "bullet_list").when(kind == 2, "table").otherwise("image")
    content = F.struct(block_type.alias("block_type"), value.alias("content"), F.when(kind == 3, "base64").alias("content_encoding"),
                       F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    block = F.struct(block_type.alias("type"), F.concat(F.lit("about "), F.col("source")).alias("purpose"), none.alias("data_needed"),
                     F.lit(None).cast("map<string,string>").alias("specifics"), none.alias("priority"))
    plan = F.struct(F.lit("1").alias("number"), F.col("lang").alias("name"), F.col("source").alias("title"), none.alias("model_name"),
                    F.array(block).alias("content_blocks"))
    spec = F.struct(F.col("doc_id").cast("string").alias("title"), F.lit("T").alias("authors"),
                    F.array(F.struct(F.col("lang").alias("name"), F.lit(False).alias("per_model"), none.alias("hint"))).alias("sections"),
                    F.lit(None).cast("map<string,string>").alias("hints"), none.alias("citation_style"),
                    F.lit(None).cast("map<string,string>").alias("formatting"))
    results = F.array(F.struct(plan.alias("plan"), F.array(content).alias("contents"), F.lit(None).cast("array<string>").alias("errors")))
    return docs.select(spec.alias("spec"), results.alias("results"))


@query("a13_save_results_cache", """SELECT doc_id, lang AS section, CASE doc_id % 4 WHEN 0 THEN 'narrative' WHEN 1 THEN 'bullet_list'
  WHEN 2 THEN 'table' ELSE 'image' END AS block_type, CASE WHEN doc_id % 4 = 3 THEN 'base64' END AS content_encoding,
  CASE WHEN doc_id % 4 = 3 THEN to_base64(encode(text)) WHEN doc_id % 4 = 0 THEN text END AS content FROM documents""")
def a13(spark, sf_dir):
    path = scratch_path(spark, "cache")
    TB.save_results_cache(_cached(spark, sf_dir), path)
    content = "$.results[0].contents[0]"
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.spec.title").cast("bigint").alias("doc_id"),
        F.get_json_object("value", "$.spec.sections[0].name").alias("section"),
        F.get_json_object("value", f"{content}.block_type").alias("block_type"),
        F.get_json_object("value", f"{content}.content_encoding").alias("content_encoding"),
        F.get_json_object("value", f"{content}.content").alias("content")).withColumn(
        "content", F.when(F.col("block_type").isin("narrative", "image"), F.col("content")))


@query("a14_load_results_cache", """SELECT doc_id, lang AS section, 'required' AS priority, 'numeric' AS citation_style, 0::BIGINT AS n_errors,
  CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), '~') WHEN 2 THEN source ELSE text END AS value FROM documents""")
def a14(spark, sf_dir):
    path = scratch_path(spark, "cache")
    TB.save_results_cache(_cached(spark, sf_dir), path)
    loaded = TB.load_results_cache(spark, path).withColumn("r", F.col("results")[0])
    c = F.col("r.contents")[0]
    value = (F.when(c["block_type"] == "narrative", F.try_variant_get(c["content"], "$", "string"))
             .when(c["block_type"] == "bullet_list", F.array_join(F.try_variant_get(c["content"], "$", "array<string>"), "~"))
             .when(c["block_type"] == "table", F.try_variant_get(c["content"], "$.source", "string"))
             .otherwise(c["bytes"].cast("string")))
    return loaded.select(F.col("spec.title").cast("bigint").alias("doc_id"), F.col("r.plan.name").alias("section"),
                         F.col("r.plan.content_blocks")[0]["priority"].alias("priority"), "spec.citation_style",
                         F.size("r.errors").cast("bigint").alias("n_errors"), value.alias("value"))


@query("a15_read_notebooks", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cell_no, turn,
  CASE WHEN role = 'user' THEN 'markdown' ELSE 'code' END AS cell_type, concat('#', conv_id, '#', turn, chr(10), text) AS source FROM conversations""")
def a15(spark, sf_dir):
    path = scratch_path(spark, "notebooks")
    lines = F.array(F.concat(F.lit("#"), F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"), F.lit("\n")), F.col("text"))
    # a notebook per conversation, as a JSON text: sources are lists of lines and plain texts in turn
    source = F.when(F.col("turn") % 2 == 0, F.to_json(lines)).otherwise(F.to_json(F.array(F.array_join(lines, ""))))
    kind = F.when(F.col("role") == "user", "markdown").otherwise("code")
    cell = F.concat(F.lit('{"cell_type": "'), kind, F.lit('", "source": '), F.when(F.col("turn") % 2 == 0, source).otherwise(
        F.substring(source, F.lit(2), F.length(source) - 2)), F.lit("}"))
    cells = F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell"))))
    books = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(cells, lambda c: c["cell"]), ", ").alias("cells"))
    FS.write_files(books.select(F.concat(F.lit("book_"), F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), F.concat(
        F.lit('{"nbformat": 4, "cells": ['), "cells", F.lit("]}")).alias("content")), path).agg(F.sum("size")).collect()
    out = TB.read_notebooks(spark, path)
    tag = "^#([0-9]+)#([0-9]+)"
    return out.select(F.regexp_extract("notebook", "book_([0-9]+)", 1).cast("bigint").alias("conv_id"), F.col("cell_no").cast("bigint").alias("cell_no"),
                      F.regexp_extract("source", tag, 2).cast("bigint").alias("turn"), "cell_type", "source")


@query("a16_read_registry_tables", P.CTES + """SELECT 'experiments' AS name, count(*) AS n, count(DISTINCT experiment_id) AS n_keys FROM experiments
  UNION ALL SELECT 'runs', count(*), count(DISTINCT run_id) FROM runs UNION ALL SELECT 'models', count(*), count(DISTINCT c_name) FROM customer
  UNION ALL SELECT 'versions', count(*), count(DISTINCT version) FROM versions
  UNION ALL SELECT 'artifacts', count(*), count(DISTINCT path) FROM artifacts""")
def a16(spark, sf_dir):
    root = scratch_path(spark, "registry")
    TB.write_registry_tables({
        "experiments": P.experiments(spark, sf_dir), "runs": P.runs(spark, sf_dir), "versions": P.versions(spark, sf_dir),
        "artifacts": P.artifacts(spark, sf_dir), "models": bind(spark, sf_dir, "SELECT c_name AS name FROM {customer}")}, root)
    keys = {"experiments": "experiment_id", "runs": "run_id", "models": "name", "versions": "version", "artifacts": "path"}
    out = None
    for name, df in TB.read_registry_tables(spark, root).items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct(keys[name]).alias("n_keys"))
        out = row if out is None else out.unionByName(row)
    return out


# One listing per supplier; its parts are pages of two records, wrapped or flat, and page 3 is short.
PAGES = """SELECT s_suppkey AS listing, page_no, concat(chr(123), CASE WHEN s_suppkey % 2 = 0 THEN '"datasets"' ELSE '"datasets": [], "items"' END, ': [',
  CASE WHEN s_suppkey % 2 = 0 THEN concat(o, '"dataset": ', o, '"datasetId": "a', id, '", "datasetName": "', s_name, '", "snapshotIds": ["n', id, '"]', c, c)
    ELSE concat(o, '"id": "b', id, '", "name": "", "datasetName": "x", "description": "d', id, '", "readWriteSnapshotId": "w"', c) END,
  CASE WHEN page_no = 3 THEN '' ELSE concat(', ', o, '"id": "z', id, '"', c) END, ']', c) AS body
  FROM (SELECT s_suppkey, s_name, page_no, chr(123) AS o, chr(125) AS c, concat(cast(s_suppkey AS string), '-', cast(page_no AS string)) AS id
    FROM {supplier} LATERAL VIEW explode(array(1, 2, 3, 4)) t AS page_no) q"""


@query("a17_paged_listing_flatten", """WITH q AS (SELECT s_suppkey AS listing, s_name, unnest([1, 2, 3]) AS page_no FROM supplier),
  r AS (SELECT *, concat(listing, '-', page_no) AS id FROM q)
  SELECT listing, page_no, 0 AS pos, CASE WHEN listing % 2 = 0 THEN 'a' ELSE 'b' END || id AS id, CASE WHEN listing % 2 = 0 THEN s_name ELSE 'x' END
    AS name, CASE WHEN listing % 2 = 0 THEN '' ELSE 'd' || id END AS description, CASE WHEN listing % 2 = 0 THEN 'n' || id ELSE 'w' END AS snapshot_id
  FROM r UNION ALL SELECT listing, page_no, 1, 'z' || id, '', '', NULL FROM r WHERE page_no < 3""")
def a17(spark, sf_dir):
    return TB.paged_listing(bind(spark, sf_dir, PAGES), page_size=2)
