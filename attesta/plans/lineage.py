"""Family E: every line of a document is a block whose text gets a marker made from its own keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import citations as C
from attesta.operators import lineage as L
from attesta.operators.grams import match_key_table
from attesta.plans.catalog import bind, plain, query

LINES_SPARK = """SELECT doc_id, cast(pos AS bigint) AS seq, lang, source, line FROM {documents}
  LATERAL VIEW posexplode(split(text, chr(10))) t AS pos, line"""
LINES_SQL = """SELECT doc_id, unnest(range(len(l))) AS seq, lang, source, unnest(l) AS line
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)"""
MARKED = """SELECT doc_id, seq, lang, source, concat(line, CASE seq % 6
  WHEN 0 THEN concat(' see [@Code:src/', source, '.py#f', cast(seq % 4 AS string), ':L', cast(seq + 1 AS string), '-L',
    cast(seq + 9 AS string), '] end')
  WHEN 1 THEN concat(' [@', lang, '_', source, '-run_', cast(doc_id % 3 AS string), ']')
  WHEN 2 THEN concat(' [@mlflow:run/r', cast(doc_id % 10 AS string), '/metric/auc; @mlflow:run/r',
    cast(doc_id % 10 AS string), '/param/depth] x')
  WHEN 3 THEN concat(' [@', lang, '-x-run_', cast(seq % 3 AS string), ':roc plot.png]')
  WHEN 4 THEN '[@plain] and [@code:lib/a.R, @code:lib/b.R:L7] [@plain]' ELSE '' END) AS text,
  CASE seq % 5 WHEN 0 THEN 'narrative' WHEN 1 THEN 'table' WHEN 2 THEN 'chart' WHEN 3 THEN 'bullet_list' ELSE 'image' END
    AS block_type, CASE WHEN seq % 2 = 0 THEN concat('extra-', cast(seq % 4 AS string)) ELSE 'plain' END AS cite
  FROM {lines}"""
BLOCKS_SQL = MARKED.replace("{lines}", f"({LINES_SQL})")
_SPLIT = r"""CASE WHEN regexp_matches(r, '[;,] ?@') THEN list_filter(list_transform(regexp_split_to_array(r,
  '[;,]\s*@'), lambda x: trim(x)), lambda x: x <> '') ELSE [r] END"""
IDS_SQL = rf"""SELECT doc_id, seq, unnest(range(len(l))) AS pos, unnest(l) AS citation_id FROM (SELECT doc_id, seq,
  flatten(list_transform(regexp_extract_all(text, '\[@([^\]]+)\]', 1), lambda r: {_SPLIT})) AS l FROM blocks)"""
DETAIL_COLUMNS = """CASE WHEN substr(citation_id, 1, 11) = 'mlflow:run/' THEN 'mlflow_metric'
  WHEN contains(citation_id, ':roc plot.png') THEN 'mlflow_artifact' WHEN contains(citation_id, '-run_') THEN 'mlflow_summary'
  WHEN substr(citation_id, 1, 5) = 'Code:' THEN 'code_file' END AS type,
  CASE WHEN substr(citation_id, 1, 11) = 'mlflow:run/' OR (contains(citation_id, '-run_') AND NOT contains(citation_id, ':'))
    THEN concat('r', cast(doc_id % 10 AS string)) WHEN contains(citation_id, ':roc plot.png') THEN 'q7' END AS run_id,
  CASE WHEN doc_id % 4 > 0 THEN cast(doc_id % 4 AS string) END AS experiment_id"""
HAS_DETAILS = "(substr(citation_id, 1, 7) = 'mlflow:' OR substr(citation_id, 1, 5) = 'Code:' OR contains(citation_id, '-run_'))"
WITH = rf"""WITH blocks AS ({BLOCKS_SQL}), ids AS ({IDS_SQL}),
  details AS (SELECT DISTINCT doc_id, citation_id, {DETAIL_COLUMNS} FROM ids WHERE {HAS_DETAILS}) """


def blocks(spark, sf_dir):
    lines = bind(spark, sf_dir, LINES_SPARK)
    return spark.sql(MARKED, lines=lines).withColumn("citations", F.array("cite", F.lit("")))


def details(spark, sf_dir):
    found = L.occurrences(blocks(spark, sf_dir)).select("doc_id", "citation_id").distinct().where(HAS_DETAILS)
    out = found.selectExpr("doc_id", "citation_id", *[c for c in _columns(DETAIL_COLUMNS)])
    for field in L.DETAIL_FIELDS:
        if field not in out.columns:
            out = out.withColumn(field, F.lit(None).cast("string"))
    return out


def _columns(text):
    """The three CASE columns of DETAIL_COLUMNS."""
    parts = text.split("END AS ")
    names = [p.split(",")[0].strip() for p in parts[1:]]
    bodies = [parts[0]] + [p.split(",", 1)[1] for p in parts[1:-1]]
    return [f"{b} END AS {n}" for b, n in zip(bodies, names)]


NAMES = r"""SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN line WHEN 2 THEN '--__..' ELSE
  concat('été ', line) END AS name FROM {lines}"""
_SANITIZE = r"""coalesce(nullif(trim(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\-]', '_', 'g'), '_+', '_', 'g'),
  '_'), ''), 'Unknown')"""


@query("e01_sanitize_name", "SELECT doc_id, seq, " + _SANITIZE.format("name") + " AS clean FROM ("
       + NAMES.replace("{lines}", f"({LINES_SQL})") + ")")
def e01(spark, sf_dir):
    df = spark.sql(NAMES, lines=bind(spark, sf_dir, LINES_SPARK))
    return df.select("doc_id", "seq", C.sanitize_name(F.col("name")).alias("clean"))


PIECES = """SELECT l_orderkey, l_linenumber, l_partkey, concat('src/m', cast(l_partkey % 9 AS string), '.py') AS path,
  CASE l_returnflag WHEN 'A' THEN concat('K.f', cast(l_suppkey AS string)) WHEN 'N' THEN '' END AS symbol,
  CASE WHEN l_linestatus = 'O' THEN cast(l_linenumber AS int) END AS first_line,
  CASE WHEN l_quantity > 25 THEN cast(l_linenumber + 3 AS int) END AS last_line,
  CASE WHEN l_linenumber < 4 THEN concat('Exp No. ', cast(l_suppkey AS string)) END AS experiment,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('run/', l_returnflag, ' 7') END AS run,
  CASE WHEN l_linenumber <> 5 THEN md5(cast(l_orderkey AS string)) END AS run_id,
  concat('plots/', l_returnflag, '/roc ', cast(l_partkey AS string), '.png') AS file FROM {lineitem}"""
_KEY = "l_orderkey, l_linenumber, l_partkey"
_RUN_SQL = ("concat(CASE WHEN coalesce(experiment, '') <> '' THEN " + _SANITIZE.format("experiment") + " ELSE 'Experiment' END, '-', "
            "CASE WHEN coalesce(run, '') <> '' THEN " + _SANITIZE.format("run") + " ELSE coalesce(nullif(left(run_id, 8), ''), 'Run') END)")


def _pieces(spark, sf_dir, column):
    return bind(spark, sf_dir, PIECES).select("l_orderkey", "l_linenumber", "l_partkey", column.alias("citation_id"))


@query("e02_code_citation_id", f"""SELECT {_KEY}, concat('Code:', path, CASE WHEN symbol <> '' THEN '#' || symbol END,
  CASE WHEN first_line IS NOT NULL THEN concat(':L', first_line, '-L' || last_line) END) AS citation_id FROM ({plain(PIECES)})""")
def e02(spark, sf_dir):
    cid = C.code_citation_id(F.col("path"), F.col("symbol"), F.col("first_line"), F.col("last_line"))
    return _pieces(spark, sf_dir, cid)


@query("e03_run_citation_id", f"SELECT {_KEY}, {_RUN_SQL} AS citation_id FROM ({plain(PIECES)})")
def e03(spark, sf_dir):
    return _pieces(spark, sf_dir, C.run_citation_id(F.col("experiment"), F.col("run"), F.col("run_id")))


@query("e04_artifact_citation_id", f"""SELECT {_KEY}, concat({_RUN_SQL}, ':', string_split(file, '/')[-1]) AS citation_id
  FROM ({plain(PIECES)})""")
def e04(spark, sf_dir):
    return _pieces(spark, sf_dir, C.artifact_citation_id(F.col("experiment"), F.col("run"), F.col("file"), F.col("run_id")))


@query("e05_legacy_citation_id", f"""SELECT {_KEY}, concat('mlflow:run/', coalesce(run_id, 'x'), CASE l_linenumber WHEN 1
  THEN '/summary/all' ELSE '/metric/auc' END) AS citation_id FROM ({plain(PIECES)})""")
def e05(spark, sf_dir):
    rid = F.coalesce("run_id", F.lit("x"))
    return _pieces(spark, sf_dir, F.when(F.col("l_linenumber") == 1, C.summary_citation_id(rid))
                   .otherwise(C.legacy_citation_id(rid, "metric", "auc")))


_CODE = "(starts_with(citation_id, 'Code:') OR starts_with(citation_id, 'code:'))"
_RAW = r"regexp_replace(substr(citation_id, 6), ':L[0-9]+(-L[0-9]+)?$', '')"
_LEG = "(NOT is_code AND starts_with(citation_id, 'mlflow:run/') AND len(parts) >= 3)"
_ART = r"(NOT is_code AND NOT starts_with(citation_id, 'mlflow:') AND contains(citation_id, ':') AND contains(base, '-'))"
_RUN = "(NOT contains(citation_id, ':') AND contains(citation_id, '-'))"
PARSED_SQL = rf"""SELECT *, CASE WHEN is_code THEN 'code_file' WHEN {_LEG} THEN 'mlflow_' || parts[3] WHEN {_ART} THEN
    'mlflow_artifact' WHEN {_RUN} THEN 'mlflow_run' ELSE 'unknown' END AS kind,
  CASE WHEN is_code THEN string_split(raw, '#')[1] END AS code_path,
  CASE WHEN is_code THEN CASE WHEN contains(raw, '#') THEN substr(raw, instr(raw, '#') + 1) ELSE '' END END AS code_symbol,
  CASE WHEN is_code THEN TRY_CAST(regexp_extract(citation_id, ':L([0-9]+)(-L([0-9]+))?$', 1) AS INT) END AS start_line,
  CASE WHEN is_code THEN TRY_CAST(regexp_extract(citation_id, ':L([0-9]+)(-L([0-9]+))?$', 3) AS INT) END AS end_line,
  CASE WHEN {_LEG} THEN parts[2] END AS parsed_run,
  CASE WHEN {_LEG} AND parts[3] IN ('metric', 'param', 'tag') THEN array_to_string(parts[4:], '/') END AS source_key,
  CASE WHEN {_ART} THEN string_split(citation_id, ':')[-1] WHEN {_LEG} AND parts[3] = 'artifact' THEN
    array_to_string(parts[4:], '/') END AS artifact_path,
  CASE WHEN {_ART} OR {_RUN} THEN string_split(citation_id, '-')[1] END AS experiment_name,
  CASE WHEN {_ART} THEN substr(base, instr(base, '-') + 1) WHEN {_RUN} THEN substr(citation_id, instr(citation_id, '-') + 1)
    END AS run_name
  FROM (SELECT *, {_CODE} AS is_code, {_RAW} AS raw, string_split(citation_id, '/') AS parts,
    regexp_extract(citation_id, '^(.*):[^:]*$', 1) AS base FROM {{src}})"""


@query("e06_parse_citation_id", WITH + f"""SELECT doc_id, seq, pos, citation_id, kind AS type, code_path, code_symbol, start_line,
  end_line, parsed_run AS run_id, source_key, artifact_path, experiment_name, run_name FROM ({PARSED_SQL.format(src='ids')})""")
def e06(spark, sf_dir):
    return L.occurrences(blocks(spark, sf_dir)).withColumn("p", C.parse_citation_id(F.col("citation_id"))).select(
        "doc_id", "seq", "pos", "citation_id", "p.*")


@query("e07_extract_citations", WITH + "SELECT doc_id, seq, pos, citation_id FROM ids")
def e07(spark, sf_dir):
    return L.occurrences(blocks(spark, sf_dir))


_STRIP = r"trim(regexp_replace(regexp_replace({0}, '\[@([^\]]+)\]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))"
_BODIES = r"regexp_extract_all({0}, '\[@([^\]]+)\]', 1)"


@query("e08_strip_markers", WITH + f"""SELECT doc_id, seq, {_STRIP.format('text')} AS clean,
  array_to_string({_BODIES.format('text')}, '|') AS found FROM blocks""")
def e08(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "seq", C.strip_markers(F.col("text")).alias("clean"),
                                        F.array_join(C.marker_bodies(F.col("text")), "|").alias("found"))


@query("e09_strip_table_markers", WITH + f"""SELECT doc_id, seq, {_STRIP.format('text')} AS caption, concat(source, '|',
    {_STRIP.format("concat(lang, '[@c-1]')")}) AS columns, concat({_STRIP.format('text')}, '|', lang) AS cells,
  array_to_string(list_concat({_BODIES.format('text')}, ['c-1'], {_BODIES.format('text')}), '|') AS found FROM blocks""")
def e09(spark, sf_dir):
    df = blocks(spark, sf_dir)
    rows = F.array(F.create_map(F.lit("a"), F.col("text")), F.create_map(F.lit("a"), F.col("lang")))
    t = C.strip_table(F.col("text"), F.array("source", F.concat("lang", F.lit("[@c-1]"))), rows)
    return df.withColumn("t", t).select(
        "doc_id", "seq", "t.caption", F.array_join("t.columns", "|").alias("columns"),
        F.array_join(F.transform("t.rows", lambda r: r["a"]), "|").alias("cells"), F.array_join("t.found", "|").alias("found"))


def _distinct_sql(lst):
    """Distinct non-empty values of a list in order of first appearance."""
    return (f"list_filter({lst}, lambda x, i: x IS NOT NULL AND x <> '' AND list_position({lst}, x) = i)")


_MERGED = _distinct_sql(f"list_concat([cite, ''], {_BODIES.format('text')})")


@query("e10_merge_ids", WITH + f"SELECT doc_id, seq, array_to_string({_MERGED}, '|') AS merged FROM blocks")
def e10(spark, sf_dir):
    merged = C.merge_ids(F.col("citations"), C.marker_bodies(F.col("text")))
    return blocks(spark, sf_dir).select("doc_id", "seq", F.array_join(merged, "|").alias("merged"))


@query("e11_collect_table_ids", WITH + f""", l AS (SELECT doc_id, seq, list(citation_id ORDER BY pos) AS l FROM ids GROUP BY ALL)
  SELECT b.doc_id, b.seq, array_to_string(list_concat(coalesce({_distinct_sql('l')}, []), ['c-1']), '|') AS found
  FROM blocks b LEFT JOIN l USING (doc_id, seq)""")
def e11(spark, sf_dir):
    found = C.collect_table_ids(F.col("text"), F.array(F.lit("[@c-1]"), F.col("lang")),
                                F.array(F.create_map(F.lit("k"), F.col("text"))))
    return blocks(spark, sf_dir).select("doc_id", "seq", F.array_join(found, "|").alias("found"))


@query("e12_section_citations", WITH + f"""SELECT doc_id, seq, {_STRIP.format('text')} AS clean_text,
  CASE WHEN block_type IN ('narrative', 'bullet_list') THEN '' ELSE array_to_string({_MERGED}, '|') END AS block_citations,
  array_to_string({_MERGED}, '|') AS section_citations FROM blocks""")
def e12(spark, sf_dir):
    return L.section_citations(blocks(spark, sf_dir)).select(
        "doc_id", "seq", "clean_text", F.array_join("block_citations", "|").alias("block_citations"),
        F.array_join("section_citations", "|").alias("section_citations"))


@query("e12_used_details", WITH + f""", used AS (SELECT DISTINCT doc_id, unnest({_MERGED}) AS citation_id FROM blocks)
  SELECT doc_id, citation_id, type FROM details SEMI JOIN used USING (doc_id, citation_id)""")
def e12_details(spark, sf_dir):
    used = L.section_citations(blocks(spark, sf_dir)).select("doc_id", F.explode("section_citations").alias("citation_id"))
    return L.used_details(details(spark, sf_dir), used).select("doc_id", "citation_id", "type")


# A section is three blocks long.
@query("e13_normalise_section", WITH + rf""", n AS (SELECT *, CASE WHEN starts_with(kind, 'mlflow_') THEN nullif(parsed_run, '')
    END AS run FROM ({PARSED_SQL.format(src='ids')})),
  f AS (SELECT doc_id, seq // 3 AS section, CASE WHEN run IS NOT NULL THEN concat('mlflow:run/', run, '/summary/all')
    ELSE citation_id END AS citation_id, min(seq * 1000 + pos) AS pos, any_value(run) AS run FROM n GROUP BY 1, 2, 3),
  d AS (SELECT DISTINCT i.doc_id, seq // 3 AS section, d.citation_id, type, run_id, experiment_id FROM ids i
    JOIN details d USING (doc_id, citation_id)),
  e AS (SELECT doc_id, section, run_id, max(experiment_id) AS experiment_id FROM d WHERE run_id IS NOT NULL
    AND experiment_id IS NOT NULL GROUP BY ALL)
  SELECT f.doc_id, f.section, f.pos, f.citation_id, CASE WHEN f.run IS NOT NULL THEN 'mlflow_summary' ELSE d.type END AS type,
    CASE WHEN f.run IS NOT NULL THEN f.run ELSE d.run_id END AS run_id,
    CASE WHEN f.run IS NOT NULL THEN e.experiment_id ELSE d.experiment_id END AS experiment_id
  FROM f LEFT JOIN e ON e.doc_id = f.doc_id AND e.section = f.section AND e.run_id = f.run
  LEFT JOIN d ON d.doc_id = f.doc_id AND d.section = f.section AND d.citation_id = f.citation_id""")
def e13(spark, sf_dir):
    ids = L.occurrences(blocks(spark, sf_dir)).withColumn("section", F.floor(F.col("seq") / 3)).withColumn(
        "pos", F.col("seq") * 1000 + F.col("pos"))
    by_section = ids.join(details(spark, sf_dir), ["doc_id", "citation_id"]).withColumnRenamed("pos", "ord")
    return L.normalise_section(ids.select("doc_id", "section", "pos", "citation_id"), by_section)


NUMBERED = f""", o AS (SELECT i.doc_id, i.citation_id, i.seq * 1000 + i.pos AS place, CASE WHEN d.type <> 'mlflow_artifact'
    AND d.type <> 'code_file' THEN d.run_id END AS run FROM ids i LEFT JOIN details d USING (doc_id, citation_id)),
  c AS (SELECT doc_id, citation_id, place, CASE WHEN run IS NULL THEN citation_id ELSE
    first_value(citation_id) OVER (PARTITION BY doc_id, run ORDER BY place) END AS canonical_id FROM o),
  n AS (SELECT doc_id, canonical_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(place)) AS number
    FROM c GROUP BY doc_id, canonical_id),
  numbers AS (SELECT DISTINCT c.doc_id, c.citation_id, c.canonical_id, n.number FROM c JOIN n USING (doc_id, canonical_id)) """


@query("e14_number_citations", WITH + NUMBERED + "SELECT doc_id, citation_id, canonical_id, number FROM numbers")
def e14(spark, sf_dir):
    return L.number_citations(L.occurrences(blocks(spark, sf_dir)), details(spark, sf_dir))


@query("e15_render_markers", WITH + rf"""SELECT doc_id, seq, regexp_replace(text, '\[@([^\]]+)\]', '[\1]', 'g') ||
    CASE WHEN NOT list_contains({_BODIES.format('text')}, cite) THEN concat(' [', cite, ']') ELSE '' END AS plain_text,
  regexp_replace(text, '\[@([^\]]+)\]', '[\1](#ref-\1)<!-- @cite:\1 -->', 'g') || CASE WHEN NOT
    list_contains({_BODIES.format('text')}, cite) THEN concat(' [', cite, '](#ref-', cite, ')<!-- @cite:', cite, ' -->')
    ELSE '' END AS linked_text FROM blocks""")
def e15(spark, sf_dir):
    extra = F.array("cite", "cite")
    return blocks(spark, sf_dir).select("doc_id", "seq", C.render_markers(F.col("text"), extra).alias("plain_text"),
                                        C.render_markers(F.col("text"), extra, markdown=True).alias("linked_text"))


@query("e16_superscript_numbers", WITH + NUMBERED + rf""", m AS (SELECT doc_id, seq, unnest(range(len(l))) AS pos,
    unnest(l) AS citation_id FROM (SELECT doc_id, seq, {_BODIES.format('text')} AS l FROM blocks)),
  w AS (SELECT m.doc_id, m.seq, list(coalesce(n.number::VARCHAR, '') ORDER BY m.pos) AS marks FROM m
    LEFT JOIN numbers n USING (doc_id, citation_id) GROUP BY ALL),
  p AS (SELECT *, regexp_split_to_array(text, '\[@[^\]]+\]') AS pieces FROM blocks),
  j AS (SELECT p.doc_id, p.seq, array_to_string(list_transform(pieces, lambda x, i: concat(x, coalesce(marks[i], ''))), '')
      AS woven, x.number AS extra FROM p LEFT JOIN w USING (doc_id, seq)
    LEFT JOIN numbers x ON x.doc_id = p.doc_id AND x.citation_id = p.cite
      AND NOT list_contains({_BODIES.format('p.text')}, p.cite))
  SELECT doc_id, seq, concat(woven, CASE WHEN extra IS NOT NULL THEN concat(' ', extra) END) AS numbered FROM j""")
def e16(spark, sf_dir):
    df = blocks(spark, sf_dir)
    numbers = L.number_citations(L.occurrences(df), details(spark, sf_dir))
    return L.superscript_numbers(df, numbers).select("doc_id", "seq", "numbered")


ENTRY_SQL = WITH + NUMBERED + f""", u AS (SELECT DISTINCT doc_id, number, canonical_id AS citation_id FROM numbers),
  q AS (SELECT p.doc_id, p.number, p.citation_id, coalesce(d.type, p.kind) AS type, coalesce(d.run_id, p.parsed_run, '') AS rid,
    coalesce(d.experiment_id, '') AS eid, coalesce(p.experiment_name, '') AS exp, coalesce(p.run_name, '') AS run,
    coalesce(p.code_path, '') AS code_path, coalesce(p.code_symbol, '') AS code_symbol, coalesce(p.artifact_path, '') AS artifact
    FROM ({PARSED_SQL.format(src='u')}) p LEFT JOIN details d USING (doc_id, citation_id)),
  r AS (SELECT *, CASE WHEN rid = '' THEN '' WHEN eid <> '' THEN concat('http://t/#/experiments/', eid, '/runs/', rid)
    ELSE concat('http://t/#/runs/', rid) END AS run_url FROM q) """


def _entries(spark, sf_dir):
    known = details(spark, sf_dir)
    numbers = L.number_citations(L.occurrences(blocks(spark, sf_dir)), known)
    return L.entries(numbers, known, "http://t/")


@query("e17_reference_text", ENTRY_SQL + """SELECT doc_id, number, CASE
  WHEN type = 'code_file' THEN concat('Source Code', chr(10), '    File: ', coalesce(nullif(code_path, ''), 'unknown'),
    CASE WHEN code_symbol <> '' THEN concat(', Symbol: ', code_symbol, '()') END)
  WHEN type = 'mlflow_artifact' THEN concat('Artifact', chr(10), '    File: ', coalesce(nullif(string_split(artifact, '/')[-1],
    ''), 'unknown'), CASE WHEN exp <> '' THEN concat(chr(10), '    Experiment: ', exp) END,
    CASE WHEN run <> '' THEN concat(' | Run: ', run) WHEN rid <> '' THEN concat(chr(10), '    Run ID: ', rid) END)
  WHEN starts_with(type, 'mlflow_') THEN concat('Model Run', CASE WHEN exp <> '' THEN concat(chr(10), '    Experiment: ', exp) END,
    CASE WHEN run <> '' THEN concat(' | Run: ', run) END, CASE WHEN rid <> '' THEN concat(chr(10), '    Run ID: ', rid) END)
  ELSE concat('Reference: ', citation_id) END AS text FROM r""")
def e17(spark, sf_dir):
    return _entries(spark, sf_dir).select("doc_id", "number", "text")


@query("e18_run_url", ENTRY_SQL + "SELECT doc_id, number, run_url FROM r")
def e18(spark, sf_dir):
    return _entries(spark, sf_dir).select("doc_id", "number", "run_url")


@query("e19_bibliography", ENTRY_SQL + """SELECT doc_id, number, concat_ws(' | ', CASE WHEN type = 'mlflow_artifact' THEN
    concat(citation_id, ' | Artifact: ', artifact) WHEN starts_with(type, 'mlflow_') THEN concat(citation_id, ' | Model Run')
    WHEN type = 'code_file' THEN concat('Code: ', code_path, CASE WHEN code_symbol <> '' THEN '#' || code_symbol END)
    ELSE citation_id END, CASE WHEN exp <> '' THEN 'Experiment: ' || exp END, CASE WHEN run <> '' THEN 'Run: ' || run END,
  CASE WHEN run_url <> '' THEN 'Link: ' || run_url END) AS line FROM r""")
def e19(spark, sf_dir):
    return _entries(spark, sf_dir).select("doc_id", "number", "line")


@query("e20_traceability", WITH + f""", s AS (SELECT doc_id, seq // 3 AS section, citation_id, min(seq * 1000 + pos) AS pos
    FROM ids GROUP BY ALL)
  SELECT doc_id, section, pos, citation_id, CASE kind WHEN 'code_file' THEN concat(code_path, CASE WHEN code_symbol <> '' THEN
      '#' || code_symbol END, CASE WHEN start_line > 0 AND end_line > 0 THEN concat(' (lines ', start_line, '-', end_line, ')')
      WHEN start_line > 0 THEN concat(' (line ', start_line, ')') END)
    WHEN 'mlflow_artifact' THEN concat('MLflow Artifact: ', artifact_path, ' (', experiment_name, '/', run_name, ')')
    WHEN 'unknown' THEN citation_id ELSE concat('MLflow Run: ', CASE WHEN experiment_name <> '' THEN
      concat(experiment_name, '/', run_name) ELSE parsed_run END) END AS label FROM ({PARSED_SQL.format(src='s')})""")
def e20(spark, sf_dir):
    ids = L.occurrences(blocks(spark, sf_dir)).withColumn("section", F.floor(F.col("seq") / 3)).withColumn(
        "pos", F.col("seq") * 1000 + F.col("pos"))
    return L.traceability(ids)


VALUE_TEXT = """SELECT o_orderkey, o_custkey, concat('Total of ', cast(o_totalprice AS string), ' at rate ', printf('%.2f',
  o_totalprice % 1), ' i.e. ', printf('%.1f', o_totalprice % 1 * 100), '% over all.') AS text FROM {orders}"""
VALUES = """SELECT o_custkey AS scope, o_orderkey AS ord, concat('Exp-run_', cast(o_orderkey AS string)) AS citation_id,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice % 1 ELSE o_totalprice END AS value FROM {orders}"""


_FORMS = ", ".join([f"printf('%.{d}f', {step.format(d=d)})" for d in (2, 3, 4, 5) for step in (
    "value", "ceil(value * 10 ** {d}) / 10 ** {d}", "floor(value * 10 ** {d}) / 10 ** {d}")]
    + [f"CASE WHEN value BETWEEN 0 AND 1 THEN concat(printf('%.{d}f', value * 100), '{end}') END" for d in (1, 2) for end in ("%", " %", "")])
# Places are taken one by one by a fold over each text's own list; no form of these texts overlaps itself.
_CITED_SQL = f"""WITH t AS ({plain(VALUE_TEXT)}), v AS ({plain(VALUES)}),
  f AS (SELECT scope, ord, citation_id, unnest([{_FORMS}]) AS form, unnest(range(18)) AS nth FROM v),
  g AS (SELECT scope, form, min(ord * 32 + nth) AS row, concat('[@', max_by(citation_id, ord * 32 + nth), ']') AS marker
        FROM f WHERE form IS NOT NULL GROUP BY ALL),
  c AS (SELECT o_orderkey, text, form, row, marker, unnest(list_filter(range(1, len(text) + 1), lambda i:
          text[i:i + len(form) - 1] = form AND NOT regexp_matches(text[i + len(form):i + len(form)], '[0-9]'))) - 1 AS first
        FROM t JOIN g ON scope = o_custkey AND contains(text, form)),
  h AS (SELECT o_orderkey, list({{'first': first, 'past': first + len(form), 'marker': marker, 'marked': text[first + len(form) + 1:first
          + len(form) + 3] LIKE '[@%' OR text[first + len(form) + 1:first + len(form) + 3] = ' [@', 'cited': []::BIGINT[],
          'places': []::BIGINT[], 'marks': []::VARCHAR[]}} ORDER BY len(form) DESC, row, first DESC) AS hits FROM c GROUP BY ALL),
  d AS (SELECT o_orderkey, list_reduce(hits, lambda s, h: CASE WHEN h.marked OR list_contains(s.places, h.past)
      OR len(list_filter(s.places, lambda p: h.first < p AND p < h.past)) > 0
      OR len(list_filter(s.cited, lambda z: abs(h.past + coalesce(list_sum(list_transform(range(1, len(s.places) + 1), lambda i:
           CASE WHEN s.places[i] < h.past THEN len(s.marks[i]) ELSE 0 END)), 0) - z) < 15)) > 0 THEN s
      ELSE {{'first': s.first, 'past': s.past, 'marker': s.marker, 'marked': s.marked, 'cited': list_append(s.cited, (h.past + coalesce(
           list_sum(list_transform(range(1, len(s.places) + 1), lambda i: CASE WHEN s.places[i] < h.past THEN len(s.marks[i]) ELSE 0
           END)), 0))::BIGINT), 'places': list_append(s.places, h.past), 'marks': list_append(s.marks, h.marker)}} END,
      {{'first': 0::BIGINT, 'past': 0::BIGINT, 'marker': '', 'marked': false, 'cited': []::BIGINT[], 'places': []::BIGINT[],
        'marks': []::VARCHAR[]}}) AS s FROM h),
  m AS (SELECT o_orderkey, unnest(s.places) AS place, unnest(s.marks) AS mark FROM d),
  p AS (SELECT o_orderkey, place, mark, coalesce(lag(place) OVER (PARTITION BY o_orderkey ORDER BY place), 0) AS before FROM m),
  q AS (SELECT o_orderkey, string_agg(concat(text[before + 1:place], mark), '' ORDER BY place) AS head, max(place) AS last
        FROM p JOIN t USING (o_orderkey) GROUP BY ALL)
  SELECT o_orderkey, concat(head, text[coalesce(last, 0) + 1:]) AS cited FROM t LEFT JOIN q USING (o_orderkey)"""


@query("e21_cite_metric_values", _CITED_SQL)
def e21(spark, sf_dir):
    docs, values = bind(spark, sf_dir, VALUE_TEXT, dealt=True), bind(spark, sf_dir, VALUES, dealt=True)
    return L.cite_metric_values(docs, "o_orderkey", "o_custkey", "text", values).select(
        "o_orderkey", "cited")


@query("e22_restore_markers", WITH + r"""SELECT doc_id, seq, regexp_replace(concat(replace(replace(text, '[@', '[see]('),
  ']', ']'), '[7](#ref-a)  <!-- @cite:run-', seq, ' -->'), '\[([^\]]+)\]\(#ref-[^\)]+\)\s*<!--\s*@cite:([^\s\p{Z}]+)\s*-->',
  '[@\2]', 'g') AS restored FROM blocks""")
def e22(spark, sf_dir):
    shown = F.concat(F.replace("text", F.lit("[@"), F.lit("[see](")), F.lit("[7](#ref-a)  <!-- @cite:run-"),
                     F.col("seq").cast("string"), F.lit(" -->"))
    return blocks(spark, sf_dir).select("doc_id", "seq", C.restore_markers(shown).alias("restored"))


REFERENCES = """SELECT doc_id, concat(text, chr(10), '**[1]** Run | [Link](http://t/#/experiments/', cast(doc_id % 50 AS string),
  '/runs/', md5(cast(doc_id AS string)), ') <!-- @cite:exp-run -->', chr(10), 'x <!-- @cite:none -->', chr(10), '/#/experiments/3/runs/abc',
  ' @cite:exp-run', chr(10), '/#/experiments/4/runs/ff <!-- @cite:b -->') AS text FROM {documents}"""


@query("e23_parse_references", rf"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS line FROM (SELECT doc_id,
    string_split(text, chr(10)) AS s FROM ({plain(REFERENCES)}))),
  p AS (SELECT doc_id, n, regexp_extract(line, '@cite:([^\s]+)', 1) AS citation_id,
    regexp_extract(line, '/#/experiments/([0-9]+)/runs/([A-Fa-f0-9]+)', 1) AS experiment_id,
    regexp_extract(line, '/#/experiments/([0-9]+)/runs/([A-Fa-f0-9]+)', 2) AS run_id FROM l)
  SELECT doc_id, citation_id, experiment_id, run_id FROM p WHERE citation_id <> '' AND run_id <> ''
  QUALIFY row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY n DESC) = 1""")
def e23(spark, sf_dir):
    return L.parse_references(bind(spark, sf_dir, REFERENCES), "doc_id", "text")


@query("e24_collapse_metric_ids", WITH + """SELECT doc_id, seq, pos, CASE WHEN starts_with(citation_id, 'mlflow:run/') THEN
  concat('mlflow:run/', string_split(citation_id, '/')[2], '/summary/all') ELSE citation_id END AS citation_id FROM ids""")
def e24(spark, sf_dir):
    return L.occurrences(blocks(spark, sf_dir)).withColumn("citation_id", C.collapse_metric_id(F.col("citation_id")))


KEYS = ["The", "an", "la", "über", "missing key", "auf"]


@query("e25_match_keys", "SELECT doc_id, concat_ws('|', " + ", ".join(
    rf"CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_]){k.lower()}($|[^\p{{L}}\p{{N}}_])') THEN '{k}' END"
    for k in KEYS) + ") AS found FROM documents")
def e25(spark, sf_dir):
    docs = bind(spark, sf_dir, "SELECT doc_id, text FROM {documents}")
    return docs.select("doc_id", F.array_join(L.match_keys(F.col("text"), KEYS), "|").alias("found"))


# The opening words of every turn, as a table of keys.
OPENINGS = "SELECT DISTINCT regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1) AS key FROM {conversations}"


@query("e25_key_table", r"""WITH k AS (SELECT key, regexp_replace(lower(key), '([a-z]+)', '<\1>', 'g') AS marked FROM ("""
       + plain(OPENINGS) + r""") WHERE key <> ''),
  t AS (SELECT conv_id * 1000 + turn AS turn_id, regexp_replace(replace(replace(lower(text), '<', ' < '), '>', ' > '),
    '([\p{L}\p{N}_]+)', '<\1>', 'g') AS marked FROM conversations)
  SELECT turn_id, key FROM t JOIN k ON contains(t.marked, k.marked)""")
def e25_table(spark, sf_dir):
    turns = bind(spark, sf_dir, "SELECT conv_id * 1000 + turn AS turn_id, text FROM {conversations}")
    return match_key_table(turns, "turn_id", "text", bind(spark, sf_dir, OPENINGS))


EVIDENCE = """SELECT lang AS project, doc_id, concat(source, '.py') AS path, CASE WHEN doc_id % 2 = 0 THEN concat('f',
  cast(doc_id AS string)) ELSE '' END AS symbol, concat('statement ', cast(doc_id AS string)) AS statement, text AS snippet
  FROM {documents}"""


@query("e26_evidence_text", rf"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY doc_id) AS position,
    trim(regexp_replace(snippet, '[\s\p{{Z}}]+', ' ', 'g')) AS s FROM ({plain(EVIDENCE)}))
  SELECT project, position, concat('- Statement: ', statement, chr(10), '  Source: ', path, CASE WHEN symbol <> '' THEN '#' || symbol
    END, chr(10), '  Citation ID: [@Code:', path, CASE WHEN symbol <> '' THEN '#' || symbol END, ']', chr(10), '  Snippet: ',
    CASE WHEN length(s) > 180 THEN substr(s, 1, 180) || '...' ELSE s END) AS line FROM r WHERE position <= 20""")
def e26(spark, sf_dir):
    return L.evidence_text(bind(spark, sf_dir, EVIDENCE), "project", ["doc_id"])


MODELS = """SELECT c_nationkey AS doc_id, o_orderkey AS ord, concat('run', cast(o_orderkey AS string)) AS run_id, c_name AS name,
  cast(c_nationkey AS string) AS experiment_id, concat('Nation ', cast(c_nationkey AS string)) AS experiment_name,
  o_orderstatus <> 'P' AS has_keys FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
FILES = """SELECT concat('run', cast(l_orderkey AS string)) AS run_id, concat('out/', l_returnflag, '_', cast(l_linenumber AS string),
  '.csv') AS path FROM {lineitem}"""
CODE = "SELECT n_nationkey AS doc_id, n_nationkey AS ord, concat(n_name, '.py') AS path, 'train' AS symbol FROM {nation}"
_CLEAN_NAME = "replace(name, '#', '_')"


@query("e27_citation_details", f"""WITH m AS ({plain(MODELS)}), f AS (SELECT DISTINCT * FROM ({plain(FILES)})),
  a AS (SELECT doc_id, ord, concat('Nation_', experiment_id, '-', {_CLEAN_NAME}) AS citation_id, 'mlflow_summary' AS type,
      run_id, experiment_id, experiment_name, name AS run_name, NULL AS code_path, NULL AS artifact_path FROM m WHERE has_keys
    UNION ALL SELECT doc_id, ord, concat('Nation_', experiment_id, '-', {_CLEAN_NAME}, ':', string_split(path, '/')[-1]),
      'mlflow_artifact', run_id, experiment_id, experiment_name, name, NULL, path FROM m JOIN f USING (run_id))
  SELECT * EXCLUDE (ord) FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY ord DESC) = 1
  UNION ALL SELECT doc_id, concat('Code:', path, '#train'), 'code_file', NULL, NULL, NULL, NULL, path, NULL FROM ({plain(CODE)})""")
def e27(spark, sf_dir):
    out = L.citation_details(bind(spark, sf_dir, MODELS), bind(spark, sf_dir, FILES), bind(spark, sf_dir, CODE))
    return out.drop("code_symbol")
