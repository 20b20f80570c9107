"""Family F: every part carries a document spec, every conversation is a notebook."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import rules
from attesta.operators import documents as D
from attesta.plans.catalog import bind, plain, query
from attesta.plans.metrics import nice

# JSON bodies with a defect per key: the texts hold braces, so they are written with chr(123) and chr(125).
SPECS = """SELECT p_partkey AS spec_id, p_partkey % 40 AS project, CASE p_partkey % 16
  WHEN 0 THEN concat('[1, "', p_name, '"]') WHEN 1 THEN concat('"', p_name, '"') WHEN 2 THEN concat('title: [', p_name)
  WHEN 3 THEN concat(o, '"sections": ["A"], "title": " "', c) WHEN 4 THEN concat(o, '"title": "', repeat('t', 480 + p_size), '", "sections": "x"', c)
  WHEN 5 THEN concat(o, '"sections": []', c) WHEN 6 THEN concat(o, '"title": 5, "sections": [', repeat('"s", ', 40 + p_size), '"z"], "hints": [1]', c)
  WHEN 7 THEN concat(o, '"title": "', p_name, '", "sections": ["', repeat('n', 180 + p_size), '", " ", 7, ["x"], null, ', o, '"hint": "h"', c, ', ',
    o, '"name": 3, "zeta": 1, "alpha": 2', c, ', ', o, '"name": "ok", "hint": "', repeat('h', 980 + p_size), '"', c, '], "formatting": 3', c)
  ELSE concat(o, '"title": "', p_name, '", "sections": ["Intro ', p_brand, '", "Models: per_model", ', o, '"name": "Deep", "per_model": true, "hint": "',
    CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END, '"', c, ', ', o, '"name": "End"', c, '], "hints": ', o, '"Deep": "dig", "End": "stop"', c,
    CASE WHEN p_partkey % 2 = 0 THEN ', "authors": "Team B"' ELSE '' END, c) END AS body
  FROM (SELECT *, chr(123) AS o, chr(125) AS c FROM {part}) p"""
MODELS = """SELECT s_suppkey % 45 AS project, s_suppkey AS ord, s_name AS name, concat('run', cast(s_suppkey AS string)) AS run_id
  FROM {supplier}"""
# The same without defects, for every part.
GOOD = "SELECT p_partkey AS spec_id, p_partkey % 40 AS project, " + SPECS.split("  ELSE ", 1)[1].split(" END AS body")[0] + \
    " AS body" + SPECS.split(" END AS body")[1]
WITH = f"WITH specs AS ({plain(SPECS)}), models AS ({plain(MODELS)}), good AS ({plain(GOOD)}) "


def specs(spark, sf_dir):
    return bind(spark, sf_dir, SPECS)


def good(spark, sf_dir):
    return bind(spark, sf_dir, GOOD)


_SECTIONS = """sections AS (SELECT spec_id, project, unnest([1, 2, 3, 4]) AS pos, unnest([json_extract_string(body, '$.sections[0]'), 'Models', 'Deep',
    'End']) AS name, unnest([false, true, true, false]) AS per_model, unnest([NULL, NULL, json_extract_string(body, '$.sections[2].hint'), NULL]) AS hint
  FROM good)"""


@query("f01_parse_sections", WITH + f", {_SECTIONS} SELECT spec_id, pos, name, per_model, hint FROM sections")
def f01(spark, sf_dir):
    return D.parse_sections(good(spark, sf_dir))


# The same specs in block style.
YAML_SPECS = """SELECT p_partkey AS spec_id, p_partkey % 40 AS project, concat('# spec', chr(10), 'title: "', p_name, '"', chr(10), 'sections:', chr(10),
  '  - Intro ', p_brand, chr(10), '  - "Models: per_model"', chr(10), '  - name: Deep', chr(10), '    per_model: yes', chr(10), '    hint: "',
  CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END, '"', chr(10), '  - name: End  # last', chr(10), 'hints:', chr(10), '  Deep: dig', chr(10),
  '  End: stop', chr(10), CASE WHEN p_partkey % 2 = 0 THEN concat('authors: >', chr(10), '  Team', chr(10), '  B') ELSE '' END) AS body FROM {part}"""


@query("f01_parse_yaml_sections", WITH + f", {_SECTIONS} SELECT spec_id, pos, name, per_model, hint FROM sections")
def f01_yaml(spark, sf_dir):
    return D.parse_sections(bind(spark, sf_dir, YAML_SPECS))


@query("f01_yaml_defaults", WITH + """SELECT spec_id, json_extract_string(body, '$.title') AS title,
  coalesce(json_extract_string(body, '$.authors'), 'Data Science Team') AS authors, 'numeric' AS citation_style FROM good""")
def f01_yaml_defaults(spark, sf_dir):
    return D.parse_specs(bind(spark, sf_dir, YAML_SPECS)).select("spec_id", "title", "authors", "citation_style")


@query("f01_spec_defaults", WITH + """SELECT spec_id, json_extract_string(body, '$.title') AS title,
  coalesce(json_extract_string(body, '$.authors'), 'Data Science Team') AS authors, 'numeric' AS citation_style FROM good""")
def f01_defaults(spark, sf_dir):
    return D.parse_specs(good(spark, sf_dir)).select("spec_id", "title", "authors", "citation_style")


@query("f02_validate_specs", WITH + f"""SELECT spec_id, concat_ws('; ', CASE spec_id % 16
    WHEN 0 THEN 'Spec file must be a YAML mapping (key: value pairs), not a list'
    WHEN 1 THEN 'Spec file must be a YAML mapping (key: value pairs), not a str' WHEN 2 THEN concat('Invalid YAML syntax at line 1, column ', 9 + length(p_name), ': expected '','' or '']'', but got ''<stream end>''')
    WHEN 3 THEN '''title'' must be a non-empty string'
    WHEN 4 THEN concat_ws('; ', CASE WHEN p_size > 20 THEN concat('''title'' is too long (', 480 + p_size, ' characters, max 500)') END,
      '''sections'' must be a list')
    WHEN 5 THEN 'Missing required field: ''title''; ''sections'' must contain at least 1 section'
    WHEN 6 THEN concat_ws('; ', '''title'' must be a non-empty string', CASE WHEN p_size > 9 THEN concat('Too many sections (', 41 + p_size,
      '). Maximum is 50.') END, '''hints'' must be a mapping of section name to hint text')
    WHEN 7 THEN concat_ws('; ', CASE WHEN p_size > 20 THEN concat('Section 1 (''', repeat('n', 30), '...''): name too long (', 180 + p_size,
      ' chars, max 200)') END, 'Section 2: name must not be empty', 'Section 3: must be a string or mapping, got int',
      'Section 4: must be a string or mapping, got list', 'Section 5: must be a string or mapping, got NoneType',
      'Section 6: missing required key ''name''', 'Section 7: ''name'' must be a non-empty string',
      'Section 7: unexpected keys [''alpha'', ''zeta'']', CASE WHEN p_size > 20 THEN concat('Section 8: hint too long (', 980 + p_size,
      ' chars, max 1000)') END, '''formatting'' must be a mapping') END) AS errors FROM specs JOIN part ON p_partkey = spec_id""")
def f02(spark, sf_dir):
    return D.validate_specs(specs(spark, sf_dir)).select("spec_id", F.array_join("errors", "; ").alias("errors"))


_EXPANDED = f"""{_SECTIONS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ord) AS j FROM models),
  expanded AS (SELECT s.spec_id, CASE WHEN per_model AND n.j IS NOT NULL THEN concat(pos, '.', n.j) ELSE pos::VARCHAR END AS number,
    s.name, n.name AS model_name, n.run_id, coalesce(nullif(hint, ''), CASE s.name WHEN 'Deep' THEN 'dig' WHEN 'End' THEN 'stop' END) AS hint
  FROM sections s LEFT JOIN numbered n ON s.per_model AND n.project = s.project)"""


def _expanded(spark, sf_dir):
    return D.expand_sections(D.parse_specs(good(spark, sf_dir)), bind(spark, sf_dir, MODELS))


@query("f03_expand_sections", WITH + f", {_EXPANDED} SELECT spec_id, number, name, model_name, run_id, hint FROM expanded")
def f03(spark, sf_dir):
    return _expanded(spark, sf_dir)


@query("f04_order_sections", WITH + f""", {_EXPANDED} SELECT spec_id, number, row_number() OVER (PARTITION BY spec_id ORDER BY
  string_split(number, '.')[1]::INT, coalesce(TRY_CAST(string_split(number, '.')[2] AS INT), 0)) AS position FROM expanded""")
def f04(spark, sf_dir):
    return D.section_positions(_expanded(spark, sf_dir), "spec_id", dealt=True).select("spec_id", "number", "position")


PLANS = """SELECT l_orderkey, l_partkey, l_linenumber, concat('Part ', cast(l_partkey AS string)) AS name,
  CASE l_linenumber % 3 WHEN 0 THEN concat('About M', cast(l_suppkey AS string), ' now') WHEN 1 THEN 'Overview' END AS title,
  CASE WHEN l_returnflag <> 'R' THEN concat('M', cast(l_suppkey AS string)) END AS model_name, l_quantity > 45 AS failed,
  CASE l_linenumber WHEN 1 THEN 'table' WHEN 2 THEN 'chart' WHEN 3 THEN 'poem' WHEN 4 THEN 'image' ELSE 'narrative' END AS block_type,
  CASE WHEN l_tax > 0.02 THEN concat('Show ', l_returnflag, ' Confusion') END AS purpose, l_linestatus AS data_needed FROM {lineitem}"""
_PK = "l_orderkey, l_partkey, l_linenumber"


@query("f05_plan_normalise", f"""SELECT {_PK}, CASE WHEN failed THEN name || coalesce(' - ' || model_name, '')
    WHEN model_name IS NOT NULL AND NOT contains(coalesce(title, name), model_name) THEN coalesce(title, name) || ' - ' || model_name
    ELSE coalesce(title, name) END AS title, CASE WHEN failed OR block_type = 'poem' THEN 'narrative' ELSE block_type END AS block_type,
  CASE WHEN failed THEN 'Describe ' || name ELSE coalesce(purpose, '') END AS purpose,
  CASE WHEN failed THEN 'Available context' ELSE data_needed END AS data_needed FROM ({plain(PLANS)})""")
def f05(spark, sf_dir):
    return D.plan_normalise(bind(spark, sf_dir, PLANS)).select("l_orderkey", "l_partkey", "l_linenumber", "title", "block_type",
                                                               "purpose", "data_needed")


@query("f06_split_ok_errors", """SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END, 'end')
  AS contents, CASE WHEN o_orderstatus = 'F' THEN concat('table: failed ', o_orderkey) ELSE '' END AS errors FROM orders""")
def f06(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM {orders}")
    none = F.lit(None).cast("string")

    def result(ok, kind, content, message):
        return F.struct(ok.alias("ok"), F.lit(kind).alias("type"), content.alias("content"), message.alias("message"))

    results = F.array(
        result(F.col("o_orderstatus") != "F", "table", F.col("o_orderpriority"), F.concat(F.lit("failed "), F.col("o_orderkey").cast("string"))),
        result(F.lit(True), "image", none, none), result(F.lit(True), "narrative", F.lit("end"), none))
    out = D.split_ok_errors(df.withColumn("results", results))
    return out.select("o_orderkey", F.array_join("contents", "|").alias("contents"), F.array_join("errors", "|").alias("errors"))


@query("f07_is_metrics_table", f"""SELECT {_PK}, regexp_matches(lower(concat(coalesce(purpose, 'x'), ' ', name)),
  '{"|".join(rules.METRIC_WORDS)}') AS is_metrics FROM ({plain(PLANS)})""")
def f07(spark, sf_dir):
    flag = D.is_metrics_table(F.coalesce("purpose", F.lit("x")), F.col("name"))
    return bind(spark, sf_dir, PLANS).select("l_orderkey", "l_partkey", "l_linenumber", flag.alias("is_metrics"))


@query("f08_table_has_content", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE
  c_mktsegment <> 'BUILDING' END AS has_content FROM customer""")
def f08(spark, sf_dir):
    df = bind(spark, sf_dir, """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN array(map('a', ' N/A ', 'b', '—'))
      WHEN 1 THEN array(map('a', 'none'), map('a', cast(c_custkey AS string))) WHEN 2 THEN cast(array() AS array<map<string,string>>)
      ELSE array(map('a', CASE WHEN c_mktsegment = 'BUILDING' THEN 'No Data' ELSE c_mktsegment END, 'b', cast(NULL AS string))) END AS cells
      FROM {customer}""")
    return df.select("c_custkey", D.table_has_content(F.col("cells")).alias("has_content"))


SERIES = """SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'a' ELSE '' END AS mode FROM {orders}"""


@query("f09_chart_series_clean", """SELECT o_orderkey, label, round(value, 6) AS value FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'p' ELSE '1' END AS label, o_totalprice AS value FROM orders
  UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'r' ELSE '3' END, o_custkey + 0.5 FROM orders
  UNION ALL SELECT o_orderkey, '4', 9.0 FROM orders WHERE o_orderstatus <> 'F')""")
def f09(spark, sf_dir):
    labels = F.when(F.col("mode") == "a", F.array(F.lit("p"), F.lit("q"), F.lit("r"))).otherwise(F.array().cast("array<string>"))
    values = F.array(F.col("o_totalprice").cast("string"), F.lit('"n/a"'),
                     F.concat(F.lit('["x", {"k": "'), F.col("o_custkey").cast("string"), F.lit('.5"}]')), F.lit("9"))
    out = bind(spark, sf_dir, SERIES).select("o_orderkey", F.explode(D.chart_series(labels, values)).alias("p"))
    return nice(out.select("o_orderkey", "p.label", "p.value"), 6)


JSON_VALUES = """SELECT event_id, CASE event_type WHEN 'click' THEN cast(user_id AS string) WHEN 'view' THEN concat('" ', cast(user_id AS string), '_0 "')
  WHEN 'error' THEN '"bad"' WHEN 'signup' THEN concat('[null, "z", [', cast(user_id AS string), 'e1, 4]]')
  ELSE concat(chr(123), '"12": "x", "b": true', chr(125)) END AS raw FROM {events}"""


@query("f10_coerce_numeric", """SELECT event_id, CASE event_type WHEN 'click' THEN user_id::DOUBLE WHEN 'view' THEN user_id * 10.0
  WHEN 'error' THEN NULL WHEN 'signup' THEN user_id * 10.0 ELSE 1.0 END::DOUBLE AS number FROM events""")
def f10(spark, sf_dir):
    return bind(spark, sf_dir, JSON_VALUES).select("event_id", D.coerce_numeric(F.col("raw")).alias("number"))


@query("f11_toc_entries", r"""SELECT doc_id, concat(doc_id % 30 + 1, '. ', text) AS heading,
  regexp_replace(replace(lower(concat(doc_id % 30 + 1, '. ', text)), ' ', '-'), '[^\p{L}\p{N}_\-]', '', 'g') AS anchor
  FROM documents""")
def f11(spark, sf_dir):
    df = bind(spark, sf_dir, "SELECT doc_id, doc_id % 30 + 1 AS number, text AS title FROM {documents}")
    return D.toc_entries(df).select("doc_id", "heading", "anchor")


CELLS = """SELECT conv_id AS notebook, turn AS cell_no, CASE WHEN turn % 7 IN (3, 4, 5) THEN 'code' ELSE 'markdown' END AS cell_type,
  CASE turn % 7 WHEN 0 THEN CASE WHEN conv_id % 3 = 0 THEN '# Title Authors: x' ELSE concat('## ', cast(turn + 1 AS string), '. Part ', role, chr(10), text) END
    WHEN 1 THEN concat('- ', replace(text, chr(10), concat(chr(10), '- '))) WHEN 2 THEN concat(chr(10), '## 2.5. Late ', role, chr(10))
    WHEN 3 THEN replace(concat('# Fig', chr(10), 'chart_data = ', chr(123), '^title^: ^T', cast(conv_id AS string), '^, ^labels^: [^a^], ^values^: [',
      cast(turn AS string), ', 2.5]', chr(125), chr(10), 'plt.show(); ax.plot(x)'), '^', chr(39))
    WHEN 4 THEN concat('#  Caption ', role, chr(10), 'columns = ["k", "v"]', chr(10), 'table_data = [', chr(123), '"k": "', role, '"', chr(125), ']')
    WHEN 5 THEN 'DOCUMENT_TITLE = "Doc"' ELSE concat('1. one', chr(10), '2. ', role) END AS source FROM {conversations}"""
_SECTIONED = f"""c AS ({plain(CELLS)}), h AS (SELECT *, CASE WHEN cell_type = 'markdown' AND cell_no % 7 = 0 AND notebook % 3 <> 0
    THEN concat(cell_no + 1, '|Part ', split_part(split_part(source, ' Part ', 2), chr(10), 1))
    WHEN cell_no % 7 = 2 THEN concat('2.5|', 'Late ', split_part(split_part(source, 'Late ', 2), chr(10), 1)) END AS opened FROM c),
  f AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY notebook ORDER BY cell_no) AS cur FROM h),
  content AS (SELECT notebook, cell_no, cell_type, source, split_part(cur, '|', 1) AS number, split_part(cur, '|', 2) AS title FROM f
    WHERE opened IS NULL AND cur IS NOT NULL AND cell_no % 7 <> 5 AND NOT (cell_no % 7 = 0 AND notebook % 3 = 0))"""


def cells(spark, sf_dir):
    return bind(spark, sf_dir, CELLS)


@query("f12_notebook_sections", f"WITH {_SECTIONED} SELECT notebook, cell_no, number, title FROM content")
def f12(spark, sf_dir):
    return D.notebook_sections(cells(spark, sf_dir)).select("notebook", "cell_no", "number", "title")


@query("f13_classify_cells", f"""WITH {_SECTIONED} SELECT notebook, cell_no, CASE cell_no % 7 WHEN 0 THEN 'narrative' WHEN 1 THEN 'bullet_list'
    WHEN 3 THEN 'chart' WHEN 4 THEN 'table' WHEN 6 THEN 'numbered_list' WHEN 2 THEN 'narrative' END AS block_type,
  CASE cell_no % 7 WHEN 1 THEN len(list_filter(string_split(source, chr(10)), lambda x: trim(x) <> '')) WHEN 6 THEN 2 END AS n_items FROM c""")
def f13(spark, sf_dir):
    out = D.classify_cells(cells(spark, sf_dir))
    return out.select("notebook", "cell_no", "block_type",
                      F.when(F.col("items").isNotNull(), F.size("items").cast("bigint")).alias("n_items"))


@query("f14_recover_cell_data", f"""WITH {_SECTIONED} SELECT notebook, cell_no, CASE WHEN cell_no % 7 = 3 THEN concat('T', notebook) END AS chart_title,
  CASE WHEN cell_no % 7 = 3 THEN cell_no::DOUBLE END AS first_value, CASE WHEN cell_no % 7 = 3 THEN 'line' ELSE 'bar' END AS chart_type,
  CASE WHEN cell_no % 7 = 4 THEN concat('k|v|', split_part(split_part(source, 'Caption ', 2), chr(10), 1)) ELSE '' END AS table_text,
  CASE WHEN cell_no % 7 = 3 THEN 'Fig' WHEN cell_no % 7 = 4 THEN concat('Caption ', split_part(split_part(source, 'Caption ', 2), chr(10), 1))
    ELSE 'Table' END AS caption, CASE WHEN cell_no % 7 = 5 THEN 'Doc' END AS doc_title FROM c WHERE cell_type = 'code'""")
def f14(spark, sf_dir):
    out = D.recover_cell_data(cells(spark, sf_dir).filter("cell_type = 'code'"))
    return out.select("notebook", "cell_no", F.col("chart.title").alias("chart_title"), F.col("chart.values")[0].alias("first_value"),
                      "chart_type", F.concat_ws("|", F.array_join("columns", "|"), F.col("rows")[0]["k"]).alias("table_text"),
                      "caption", "doc_title")


@query("f15_planning_preview", """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Unknown' ELSE array_to_string(string_split(text, ' ')[1:20], ', ')
  || CASE WHEN len(string_split(text, ' ')) > 20 THEN concat(' (+', len(string_split(text, ' ')) - 20, ' more)') ELSE '' END END AS preview
  FROM documents""")
def f15(spark, sf_dir):
    df = bind(spark, sf_dir, """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN cast(array() AS array<string>) ELSE split(text, ' ') END AS features
      FROM {documents}""")
    return df.select("doc_id", D.planning_preview(F.col("features")).alias("preview"))


ASKED = "SELECT o_orderkey AS request_id, concat('run', cast(o_orderkey AS string)) AS run_id FROM {orders}"
RUN_FILES = """SELECT concat('run', cast(l_orderkey AS string)) AS run_id, concat('out/', cast(l_partkey AS string)) AS path,
  CASE l_returnflag WHEN 'A' THEN 'image' ELSE 'data' END AS kind, l_linestatus AS content FROM {lineitem}"""


@query("f16_artifact_prompt_rows", f"""SELECT request_id, path, CASE kind WHEN 'image' THEN concat('## ', path, ': [Image Available]') ELSE
  concat('## ', path, ':', chr(10), content) END AS line FROM ({plain(ASKED)}) JOIN ({plain(RUN_FILES)}) USING (run_id)""")
def f16(spark, sf_dir):
    out = D.artifact_prompt_rows(bind(spark, sf_dir, ASKED), bind(spark, sf_dir, RUN_FILES))
    return out.select("request_id", "path", "line")
