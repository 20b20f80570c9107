"""Family C and the path rules of A: each document becomes a source file in the language its text is assigned."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import rules
from attesta.operators import corpus as S
from attesta.plans.catalog import ORACLES, bind, plain, query, table
from attesta.plans.redaction import KEYWORD_STEPS, PATTERN_STEPS, fold_sql

FILES = """SELECT doc_id, source AS project, language, concat(CASE doc_id % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/'
    WHEN 2 THEN 'venv/lib/' ELSE '' END, CASE doc_id % 5 WHEN 0 THEN 'train_model_' WHEN 1 THEN 'utils_' WHEN 2 THEN 'predict_'
    WHEN 3 THEN 'DATA_proc_' ELSE 'main_' END, cast(doc_id AS string), CASE language WHEN 'python' THEN '.py' WHEN 'r' THEN
    CASE WHEN doc_id % 2 = 0 THEN '.R' ELSE '.rmd' END WHEN 'sas' THEN '.sas' ELSE '.m' END) AS path, n_chars AS size,
  CASE language
  WHEN 'python' THEN concat('\"\"\"Doc ', cast(doc_id AS string), ' of ', source, '.\"\"\"', chr(10), 'import numpy as np, os',
    chr(10), 'from ', source, '.core import run', chr(10), chr(10), 'def top_', cast(doc_id AS string), '(x):', chr(10),
    '    import json', chr(10), '    # ', replace(text, chr(10), concat(chr(10), '    # ')), chr(10), '    return x', chr(10),
    chr(10), 'class K', cast(doc_id % 7 AS string), ':', chr(10), '    def fit(self):', chr(10), '        return ',
    cast(doc_id AS string), chr(10), chr(10), 'async def tail(a):', chr(10), '    return a', chr(10),
    CASE WHEN doc_id % 9 = 0 THEN 'def broken(:' ELSE '' END)
  WHEN 'r' THEN concat(chr(10), '# ', replace(text, chr(10), concat(chr(10), '  ## ')), chr(10), 'library(', source, ')', chr(10),
    'require( "ggplot2" )', chr(10), 'fit_', cast(doc_id AS string), ' <- function(x) {{', chr(10), '  x', chr(10), '}} # end')
  WHEN 'sas' THEN concat('%INCLUDE "/lib/', source, '.sas";', chr(10), 'LIBNAME lib', cast(doc_id AS string), ' base;', chr(10),
    '%macro m', cast(doc_id % 3 AS string), '(a);', chr(10), '/* ', text, ' */', chr(10), 'PROC SORT data=a; run;', chr(10),
    'proc Means;')
  ELSE concat('%% ', replace(text, chr(10), concat(chr(10), '% ')), chr(10), 'function [a, b] = run_', cast(doc_id AS string),
    '(x)', chr(10), 'function helper (y)') END AS content
  FROM (SELECT *, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'r' WHEN 'de' THEN 'sas' ELSE 'matlab' END AS language
        FROM {documents}) d""".replace('\\"', '"')
WITH = f"WITH files AS ({plain(FILES)}) "


def files(spark, sf_dir):
    return bind(spark, sf_dir, FILES, dealt=True)


# Page addresses serve as file paths for the path rules.
@query("a02_is_binary", "SELECT page_id, regexp_matches(lower(concat(url, CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN "
       "'.py' ELSE '' END)), '[^/](" + "|".join(e.replace(".", "\\.") for e in rules.BINARY_EXTENSIONS)
       + ")$') OR (page_id % 3 = 0) AS is_binary FROM pages")
def a02(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat("url", F.expr("CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.py' ELSE '' END")).alias("path"),
        F.encode("html", "UTF-8").alias("raw"))
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(b"ab\x00"), F.col("raw"))).otherwise(F.col("raw"))
    return pages.select("page_id", S.is_binary(F.col("path"), head).alias("is_binary"))


@query("a03_exclude_paths", "SELECT doc_id, path FROM (" + plain(FILES) + ") WHERE NOT (" + " OR ".join(
    f"contains(path, '{p}')" for p in [*rules.LANGUAGES["python"]["exclude"], *rules.CONFIG_EXCLUDES]) + ")")
def a03(spark, sf_dir):
    patterns = [*rules.LANGUAGES["python"]["exclude"], *rules.CONFIG_EXCLUDES]
    return S.exclude_paths(files(spark, sf_dir).select("doc_id", "path"), patterns)


_SCORE = " + ".join(f"contains(lower(string_split(path, '/')[-1]), '{k}')::INT" for k in rules.LANGUAGES["python"]["priority"])


@query("a04_priority_topk", WITH + f"""SELECT path, {_SCORE} AS score FROM files ORDER BY score DESC,
  string_split(path, '/')[-1], path LIMIT 100""")
def a04(spark, sf_dir):
    return S.priority_topk(files(spark, sf_dir).select("path"), rules.LANGUAGES["python"]["priority"])


_TOP_SQL = f"""tops AS (SELECT project, path, {_SCORE} AS score, row_number() OVER (PARTITION BY project ORDER BY {_SCORE} DESC,
  string_split(path, '/')[-1], path) AS rank FROM files QUALIFY rank <= 50)"""


@query("a04_priority_topk_by_project", WITH + f", {_TOP_SQL} SELECT project, path, score, rank FROM tops")
def a04_by_project(spark, sf_dir):
    return S.priority_topk(files(spark, sf_dir).select("project", "path"), rules.LANGUAGES["python"]["priority"], 50, ["project"])


# Discovery in each project's own language, with one rule set per language.
_BEST = """c AS (SELECT project, count(*) FILTER (path LIKE '%.py') AS python,
    count(*) FILTER (path LIKE '%.R' OR path LIKE '%.r' OR path LIKE '%.Rmd' OR path LIKE '%.rmd') AS r,
    count(*) FILTER (path LIKE '%.sas' OR path LIKE '%.SAS') AS sas, count(*) FILTER (path LIKE '%.m') AS matlab FROM files GROUP BY project),
  best AS (SELECT project, CASE greatest(python, r, sas, matlab) WHEN python THEN 'python' WHEN r THEN 'r' WHEN sas THEN 'sas' ELSE 'matlab' END
    AS own FROM c)"""


def _by_language(expression) -> str:
    return "CASE own " + " ".join(f"WHEN '{n}' THEN ({expression(p)})" for n, p in rules.LANGUAGES.items()) + " END"


_KEPT = _by_language(lambda p: "(" + " OR ".join(f"ends_with(path, '{e}')" for e in p["extensions"]) + ") AND NOT (" + " OR ".join(
    f"contains(path, '{x}')" for x in [*p["exclude"], *rules.CONFIG_EXCLUDES]) + ")")
_OWN_SCORE = _by_language(lambda p: " + ".join(f"contains(lower(string_split(path, '/')[-1]), '{k}')::INT" for k in p["priority"]))


@query("a18_discover_files", WITH + f""", {_BEST} SELECT project, own AS language, path, {_OWN_SCORE} AS score,
  row_number() OVER (PARTITION BY project ORDER BY {_OWN_SCORE} DESC, string_split(path, '/')[-1], path)::INT AS rank
  FROM files JOIN best USING (project) WHERE doc_id % 11 > 0 AND {_KEPT} QUALIFY rank <= 20""")
def a18(spark, sf_dir):
    found = files(spark, sf_dir).withColumn("head", F.encode(F.when(F.col("doc_id") % 11 == 0, F.lit("a\x00b")).otherwise(F.col("content")), "UTF-8"))
    return S.discover_files(found.select("project", "path", "head"), max_files=20).select("project", "language", "path", "score", "rank")


@query("c01_detect_language", WITH + """, c AS (SELECT project, count(*) FILTER (path LIKE '%.py') AS python,
    count(*) FILTER (path LIKE '%.R' OR path LIKE '%.r' OR path LIKE '%.Rmd' OR path LIKE '%.rmd') AS r,
    count(*) FILTER (path LIKE '%.sas' OR path LIKE '%.SAS') AS sas, count(*) FILTER (path LIKE '%.m') AS matlab
    FROM files GROUP BY project)
  SELECT project, CASE greatest(python, r, sas, matlab) WHEN 0 THEN NULL WHEN python THEN 'python' WHEN r THEN 'r'
    WHEN sas THEN 'sas' ELSE 'matlab' END AS language, greatest(python, r, sas, matlab) AS n_files FROM c""")
def c01(spark, sf_dir):
    return S.detect_language(files(spark, sf_dir).select("project", "path"))


_BODY = r"""concat('def top_', doc_id, '(x):', chr(10), '    import json', chr(10), '    # ',
  replace(text, chr(10), concat(chr(10), '    # ')), chr(10), '    return x')"""
_CLASS = "concat('class K', doc_id % 7, ':', chr(10), '    def fit(self):', chr(10), '        return ', doc_id)"
_TAIL = "concat('async def tail(a):', chr(10), '    return a')"
_CUT = "CASE WHEN length({0}) > 500 THEN substr({0}, 1, 500) || chr(10) || '...' ELSE {0} END"
PY_SQL = WITH + f""", py AS (SELECT f.*, d.text, f.doc_id % 9 <> 0 AS parse_ok FROM files f JOIN documents d USING (doc_id)
  WHERE language = 'python') """


def _index(spark, sf_dir):
    return S.index_python(files(spark, sf_dir).filter("language = 'python'"), ["project", "path", "doc_id"])


@query("c02_index_python", PY_SQL + """SELECT path, CASE WHEN parse_ok THEN concat('numpy|os|', project, '.core|json') ELSE '' END AS imports,
  CASE WHEN parse_ok THEN concat('def top_', doc_id, '|class K', doc_id % 7, '|def tail') ELSE '' END AS symbols,
  CASE WHEN parse_ok THEN concat('Doc ', doc_id, ' of ', project, '.') ELSE '' END AS docstring FROM py""")
def c02(spark, sf_dir):
    return _index(spark, sf_dir).select("path", F.array_join("imports", "|").alias("imports"),
                                        F.array_join("symbols", "|").alias("symbols"), "docstring")


@query("c02_import_table", PY_SQL + """SELECT path, unnest(['numpy', 'os', project || '.core', 'json']) AS module, unnest([0, 1, 2, 3]) AS position
  FROM py WHERE parse_ok""")
def c02_imports(spark, sf_dir):
    return S.import_table(_index(spark, sf_dir), ["path"])


@query("c02_symbol_table", PY_SQL + """SELECT path, unnest(['def', 'class', 'def']) AS kind, unnest(['top_' || doc_id, 'K' || doc_id % 7, 'tail']) AS name,
  unnest([0, 1, 2]) AS position FROM py WHERE parse_ok""")
def c02_symbols(spark, sf_dir):
    return S.symbol_table(_index(spark, sf_dir), ["path"])


@query("c02_module_counts", PY_SQL + """SELECT module, count(*) AS n_files FROM (SELECT DISTINCT path, unnest(['numpy', 'os', project || '.core', 'json'])
  AS module FROM py WHERE parse_ok) GROUP BY module""")
def c02_modules(spark, sf_dir):
    return S.module_counts(_index(spark, sf_dir), ["path"])


@query("c03_sample_snippets", PY_SQL + f""", b AS (SELECT path, unnest([{_BODY}, {_CLASS}, {_TAIL}]) AS body,
    unnest([1, 2, 3]) AS place FROM py WHERE parse_ok),
  r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(body) DESC, place) - 1 AS nth FROM b)
  SELECT path, nth, {_CUT.format('body')} AS snippet FROM r
  UNION ALL SELECT path, 0, regexp_replace(substr(content, 1, 500), '\\s+$', '') FROM py WHERE NOT parse_ok""")
def c03(spark, sf_dir):
    return _index(spark, sf_dir).select("path", F.posexplode("snippets").alias("nth", "snippet"))


_COMMENT = r"""substr(array_to_string(list_transform(list_filter(string_split({text}, chr(10)), lambda x: true),
  lambda x, i: regexp_replace(concat(CASE WHEN i = 1 THEN '{first}' ELSE '{rest}' END, regexp_replace(x, '[\s\p{{Z}}]+$', '')),
  '^[{mark} \t]+', '')), ' '), 1, 300)"""


@query("c04_index_r", WITH + f"""SELECT path, concat(project, '|ggplot2') AS imports, concat('def fit_', doc_id) AS symbols,
  {_COMMENT.format(text='d.text', first='# ', rest='## ', mark='#')} AS docstring, substr(content, 1, 500) AS snippet
  FROM files f JOIN documents d USING (doc_id) WHERE language = 'r'""")
def c04(spark, sf_dir):
    return _native(spark, sf_dir, "r")


def _native(spark, sf_dir, language):
    card = {"r": S.r_card, "sas": S.sas_card, "matlab": S.matlab_card}[language]
    df = files(spark, sf_dir).filter(F.col("language") == language).withColumn("c", card(F.col("content")))
    return df.select("path", F.array_join("c.imports", "|").alias("imports"), F.array_join("c.symbols", "|").alias("symbols"),
                     "c.docstring", F.col("c.snippets")[0].alias("snippet"))


@query("c05_index_sas", WITH + r"""SELECT path, array_to_string(list_concat(regexp_extract_all(content, '(?i)%include\s+["'']?([^"'';\s]+)', 1),
    regexp_extract_all(content, '(?i)libname\s+([\p{L}\p{N}_]+)', 1)), '|') AS imports,
  array_to_string(list_concat(list_transform(regexp_extract_all(content, '(?i)%macro\s+([\p{L}\p{N}_]+)', 1), lambda m: 'macro ' || m),
    list_transform(regexp_extract_all(content, '(?i)proc\s+([\p{L}\p{N}_]+)', 1), lambda m: 'proc ' || m)), '|') AS symbols,
  '' AS docstring, substr(content, 1, 500) AS snippet FROM files WHERE language = 'sas'""")
def c05(spark, sf_dir):
    return _native(spark, sf_dir, "sas")


@query("c06_index_matlab", WITH + f"""SELECT path, '' AS imports, concat('def run_', doc_id, '|def helper') AS symbols,
  {_COMMENT.format(text='d.text', first='%% ', rest='% ', mark='%')} AS docstring, substr(content, 1, 500) AS snippet
  FROM files f JOIN documents d USING (doc_id) WHERE language = 'matlab'""")
def c06(spark, sf_dir):
    return _native(spark, sf_dir, "matlab")


@query("c07_card_fallback", WITH + r"""SELECT path, CASE WHEN doc_id % 11 = 0 THEN true ELSE NOT (language = 'python' AND doc_id % 9 = 0) END
    AS parse_ok, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN language = 'python' AND doc_id % 9 <> 0 THEN 3 ELSE 1 END AS n_snippets,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN language = 'python' AND doc_id % 9 <> 0 THEN 'parsed' WHEN language = 'python' THEN
    regexp_replace(substr(content, 1, 500), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') ELSE substr(content, 1, 500) END AS first_snippet
  FROM files""")
def c07(spark, sf_dir):
    df = files(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 11 != 0, F.col("content")))
    cards = S.file_cards(df, ["path", "doc_id"])
    first = F.when(F.size("snippets") == 0, "").when(F.size("snippets") == 3, "parsed").otherwise(F.col("snippets")[0])
    return cards.select("path", "parse_ok", F.size("snippets").alias("n_snippets"), first.alias("first_snippet"))


_NATIVE_SQL = " UNION ALL ".join(f"SELECT * FROM ({ORACLES[name]})" for name in ("c04_index_r", "c05_index_sas", "c06_index_matlab"))
_SHORT = "array_to_string(string_split(nullif({}, ''), '|')[1:20], ', ')"


@query("c08_card_text", WITH + f""", n AS ({_NATIVE_SQL}), i AS (SELECT path, imports, symbols, docstring FROM n UNION ALL
    SELECT * FROM ({ORACLES['c02_index_python']})),
  s AS (SELECT path, nth, snippet FROM ({ORACLES['c03_sample_snippets']}) UNION ALL SELECT path, 0, snippet FROM n),
  t AS (SELECT path, string_agg(concat('Snippet ', nth + 1, ':', chr(10), snippet), chr(10) ORDER BY nth) AS numbered FROM s
        WHERE nth < 3 AND regexp_matches(snippet, '[^\\s\\p{{Z}}]') GROUP BY path)
  SELECT path, concat_ws(chr(10), concat('### ', path, ' (', size, ' bytes, ', language, ')'), 'Imports: ' || {_SHORT.format('imports')},
    'Symbols: ' || {_SHORT.format('symbols')}, 'Docstring: ' || substr(nullif(docstring, ''), 1, 300), numbered) AS card
  FROM files JOIN i USING (path) LEFT JOIN t USING (path)""")
def c08(spark, sf_dir):
    names = ("path", "size", "language", "imports", "symbols", "docstring", "snippets")
    return S.file_cards(files(spark, sf_dir)).select("path", S.card_text(*[F.col(n) for n in names]).alias("card"))


_SECRET = "concat(text, chr(10), 'password = ', md5(cast(doc_id AS string)))"


@query("c09_sanitise_snippets", f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '[FILE CONTENTS REDACTED: conf/.env]' ELSE
    {fold_sql(_SECRET, PATTERN_STEPS + KEYWORD_STEPS)} END AS first_snippet, CASE WHEN doc_id % 5 = 0 THEN
    '[FILE CONTENTS REDACTED: conf/.env]' ELSE source END AS second_snippet FROM documents""")
def c09(spark, sf_dir):
    df = bind(spark, sf_dir, f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'conf/.env' ELSE 'src/a.py' END AS path,
      array({_SECRET}, source) AS snippets FROM {{documents}}""")
    clean = df.withColumn("s", S.sanitise_snippets(F.col("path"), F.col("snippets")))
    return clean.select("doc_id", F.col("s")[0].alias("first_snippet"), F.col("s")[1].alias("second_snippet"))


# A ranking that names files, some unknown; projects src2 and src3 get no valid entry.
RANKING = """SELECT source AS project, doc_id AS pos, CASE WHEN source IN ('src2', 'src3') OR doc_id % 3 = 0 THEN 'none.py' ELSE path END
  AS path, CASE WHEN doc_id % 2 = 0 THEN 'training' END AS role FROM {documents} JOIN {files} USING (doc_id)"""
RANKED_SQL = WITH + f""", {_TOP_SQL}, ranking AS ({plain(RANKING)}), valid AS (SELECT project, pos, path, coalesce(role, 'unknown') AS role
    FROM ranking SEMI JOIN tops USING (project, path)),
  chosen AS (SELECT project, pos, path, role FROM valid UNION ALL SELECT project, rank, path, NULL FROM tops
    WHERE project NOT IN (SELECT project FROM valid)),
  batched AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY pos, path) AS rn FROM chosen) """


def _ranking(spark, sf_dir):
    cards = files(spark, sf_dir).select("doc_id", "project", "path")
    ranking = spark.sql(RANKING, documents=table(spark, sf_dir, "documents"), files=cards.select("doc_id", "path"))
    tops = S.priority_topk(cards, rules.LANGUAGES["python"]["priority"], 50, ["project"])
    return S.validate_ranking(ranking, tops)


@query("c10_validate_ranking", RANKED_SQL + "SELECT project, pos, path, role FROM chosen")
def c10(spark, sf_dir):
    return _ranking(spark, sf_dir)


@query("c11_select_and_batch", RANKED_SQL + "SELECT project, path, rn, (rn - 1) // 4 AS batch_id FROM batched WHERE rn <= 15")
def c11(spark, sf_dir):
    return S.select_and_batch(_ranking(spark, sf_dir)).select("project", "path", "rn", "batch_id")


_NL = "length({0}) - length(replace({0}, chr(10), ''))"
_SPANS = f"""spans AS (SELECT project, path, doc_id, unnest(['top_' || doc_id, 'K' || doc_id % 7, 'fit', 'tail']) AS name,
    unnest([5, n + 10, n + 11, n + 14]) AS start_line, unnest([n + 8, n + 12, n + 12, n + 15]) AS end_line
    FROM (SELECT *, {_NL.format('text')} AS n FROM py WHERE parse_ok))"""


@query("c12_symbol_span", PY_SQL + f", {_SPANS} SELECT path, name, start_line, end_line FROM spans")
def c12(spark, sf_dir):
    return S.symbol_spans(_index(spark, sf_dir)).select("path", "name", "start_line", "end_line")


EVIDENCE = """SELECT doc_id, source AS project, path, CASE doc_id % 4 WHEN 0 THEN 'K.fit' WHEN 1 THEN concat('top_', cast(doc_id AS string))
    WHEN 2 THEN 'missing' END AS symbol,
  CASE doc_id % 5 WHEN 0 THEN substr(text, 5, 60) WHEN 1 THEN '   return a' WHEN 2 THEN 'nowhere at all' WHEN 3 THEN '' ELSE
    concat('  import json', chr(10), '    # ', substr(text, 1, 3)) END AS snippet FROM {documents} JOIN {files} USING (doc_id)"""
_TRIMMED = r"regexp_replace(snippet, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


@query("c13_snippet_lines", PY_SQL + f""", {_SPANS}, e AS (SELECT *, {_TRIMMED} AS s FROM ({plain(EVIDENCE)})),
  j AS (SELECT e.doc_id, sp.start_line AS s0, sp.end_line AS e0, s, content, CASE WHEN snippet <> '' THEN nullif(instr(content, s), 0)
      END AS spot FROM e JOIN files f ON f.project = e.project AND f.path = e.path
    LEFT JOIN spans sp ON sp.path = e.path AND sp.name = string_split(e.symbol, '.')[-1]),
  k AS (SELECT *, {_NL.format('left(content, spot - 1)')} + 1 AS line1 FROM j)
  SELECT doc_id, coalesce(s0, line1)::INT AS start_line, coalesce(line1 + {_NL.format('s')}, e0)::INT AS end_line FROM k""")
def c13(spark, sf_dir):
    fs = files(spark, sf_dir)
    evidence = spark.sql(EVIDENCE, documents=table(spark, sf_dir, "documents"), files=fs.select("doc_id", "path"))
    spans = S.symbol_spans(_index(spark, sf_dir))
    return S.snippet_lines(evidence, fs, spans).select("doc_id", "start_line", "end_line")


# A conversation is a project, a turn a batch, its words the batch's findings.
BATCHES_SPARK = """SELECT conv_id AS project, turn AS batch_id, split(text, ' ') AS features,
  array(role, concat('m', cast(turn % 2 AS string))) AS model_classes, array(role) AS data_sources,
  array(concat('t', cast(turn AS string))) AS transformations, array(concat('e', cast(turn AS string)), role) AS evidence,
  map(role, cast(turn AS string), 'seed', concat('s', cast(turn AS string))) AS hyperparameters,
  CASE WHEN turn % 2 = 1 THEN role ELSE '' END AS target, CASE WHEN turn > 0 THEN concat('task', cast(turn AS string)) END AS task,
  CASE WHEN turn <> 1 THEN concat('note ', cast(turn AS string)) ELSE '' END AS insight FROM {conversations}"""
RANKS = """SELECT conv_id AS project, turn AS batch_id, concat('f', cast((turn * 3 + conv_id) % 4 AS string)) AS path FROM {conversations}"""
FILE_RANKS = """SELECT DISTINCT conv_id AS project, concat('f', cast(conv_id % 3 AS string)) AS path, 0 AS rank FROM {conversations}
  UNION ALL SELECT DISTINCT conv_id, concat('f', cast((conv_id + 1) % 3 AS string)), 1 FROM {conversations}"""


@query("c14_merge_batches", f"""WITH r AS (SELECT q.project, q.batch_id, min(coalesce(f.rank, 999)) AS rk FROM ({plain(RANKS)}) q
    LEFT JOIN ({plain(FILE_RANKS)}) f USING (project, path) GROUP BY ALL),
  b AS (SELECT conv_id AS project, turn, role, text, rk, count(*) OVER (PARTITION BY conv_id) AS n
    FROM conversations JOIN r ON r.project = conv_id AND r.batch_id = turn),
  l AS (SELECT project, 'features' AS field, unnest(string_split(text, ' ')) AS value, rk, turn, unnest(range(len(string_split(text, ' ')))) AS p, n FROM b
    UNION ALL SELECT project, 'model_classes', role, rk, turn, 0, n FROM b
    UNION ALL SELECT project, 'model_classes', 'm' || turn % 2, rk, turn, 1, n FROM b),
  first AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY project, field, value, CASE WHEN n = 1 THEN p END ORDER BY rk, turn, p) = 1),
  one AS (SELECT project, 'target' AS field, role AS value, rk, turn, 0 AS p FROM b WHERE turn % 2 = 1 AND role <> ''
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY rk, turn) = 1),
  two AS (SELECT project, 'task', 'task' || turn, rk, turn, 0 FROM b WHERE turn > 0 QUALIFY row_number() OVER (PARTITION BY project ORDER BY rk, turn) = 1)
  SELECT project, field, NULL::VARCHAR AS key, value, rk::INT AS batch_rank, turn AS batch_id, p::INT AS position FROM (
    SELECT project, field, value, rk, turn, p FROM first UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two
    UNION ALL SELECT project, 'transformations', 't' || turn, rk, turn, 0 FROM b
    UNION ALL SELECT project, 'insight', 'note ' || turn, rk, turn, 0 FROM b WHERE turn <> 1)
  UNION ALL SELECT project, 'hyperparameters', 'seed', 's' || turn, rk::INT, turn, 0 FROM b
    QUALIFY row_number() OVER (PARTITION BY project ORDER BY rk, turn) = 1""")
def c14(spark, sf_dir):
    ranks = S.batch_ranks(bind(spark, sf_dir, RANKS), bind(spark, sf_dir, FILE_RANKS))
    out = S.merge_batches(bind(spark, sf_dir, BATCHES_SPARK), ranks)
    wanted = ("features", "model_classes", "target", "task", "transformations", "insight", "hyperparameters")
    return out.filter(F.col("field").isin(*wanted) & ((F.col("field") != "hyperparameters") | (F.col("key") == "seed")))


SCANNED = """SELECT conv_id AS project, turn AS batch_id, concat('a', cast(turn AS string)) AS p1, concat('b', cast(turn AS string)) AS p2,
  role = 'user' AS failed FROM {conversations}"""


@query("c15_scan_completeness", f"""SELECT project, 2 * count(*) FILTER (failed) AS n_skipped, bool_or(failed) AS scan_incomplete,
  bool_and(failed) AS all_failed FROM ({plain(SCANNED)}) GROUP BY project""")
def c15(spark, sf_dir):
    return S.scan_completeness(bind(spark, sf_dir, SCANNED).withColumn("paths", F.array("p1", "p2")))


@query("c15_skipped_files", f"""SELECT project, batch_id, unnest([0, 1]) AS position, unnest([p1, p2]) AS path
  FROM ({plain(SCANNED)}) WHERE failed""")
def c15_files(spark, sf_dir):
    return S.skipped_files(bind(spark, sf_dir, SCANNED).withColumn("paths", F.array("p1", "p2")))


@query("c16_clip_file_content", """SELECT doc_id, CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || chr(10) || '... (truncated)'
  ELSE text END AS clipped FROM documents""")
def c16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.clip_file_content(F.col("text"), 1500).alias("clipped"))


@query("c17_language_profile_lookup", "SELECT doc_id, CASE lang " + " ".join(
    f"WHEN '{lang}' THEN '{'|'.join(rules.LANGUAGES[name]['libraries'])}'" for lang, name in (
        ("en", "python"), ("fr", "r"), ("de", "sas"), ("es", "matlab"))) + " END AS libraries FROM documents")
def c17(spark, sf_dir):
    df = bind(spark, sf_dir, """SELECT doc_id, CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'R' WHEN 'de' THEN 'SAS'
      ELSE 'MatLab' END AS language FROM {documents}""")
    return df.select("doc_id", F.array_join(S.profile(F.col("language"), "libraries"), "|").alias("libraries"))
