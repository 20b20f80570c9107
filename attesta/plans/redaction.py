"""Family B on ``documents`` and ``conversations``.

Most rules never fire on the given texts, so every text gets one more line, made from its own key, that one rule
recognises.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import rules
from attesta.operators import redact as R
from attesta.plans.catalog import bind, plain, query, spread, table

KEY = "md5(cast(doc_id AS string))"
SEEDED = f"""SELECT doc_id, lang, concat(text, chr(10), CASE doc_id % 14
  WHEN 0 THEN concat('api_key = "', {KEY}, '"') WHEN 1 THEN concat('Token: ', {KEY})
  WHEN 2 THEN concat('password=', substr({KEY}, 1, 10)) WHEN 3 THEN concat('aws_access_key_id = ', substr({KEY}, 1, 12))
  WHEN 4 THEN concat('AKIA', upper(substr({KEY}, 1, 16))) WHEN 5 THEN concat('postgres://u:p@h/', {KEY}, ' end')
  WHEN 6 THEN '-----BEGIN RSA PRIVATE KEY-----'
  WHEN 7 THEN concat('hosts 10.', cast(doc_id % 250 AS string), '.1.42 and 172.20.0.9 and 8.8.8.8')
  WHEN 8 THEN concat('ghp_', {KEY}, {KEY}) WHEN 9 THEN concat('xoxb-', {KEY}) WHEN 10 THEN concat('sk-ant-', {KEY})
  WHEN 11 THEN concat('sk-', {KEY}) WHEN 12 THEN concat('my_credit_card : ', cast(doc_id AS string), ' ssn=1 SSN = 2')
  ELSE concat('db_credentials = x auth_token="', substr({KEY}, 1, 8), '" private_note: n') END) AS text FROM {{documents}}"""
PATHS = """concat(CASE doc_id % 5 WHEN 0 THEN 'conf/.ENV' WHEN 1 THEN 'src/a.py' WHEN 2 THEN 'certs/x.pem'
  WHEN 3 THEN 'Secrets/notes.txt' ELSE 'home/.Renviron' END, '/', source)"""

_W, _S = r"\p{L}\p{N}_", r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"


def _re2(pattern: str) -> str:
    """The rule as the oracle engine spells it (there \\b stays ASCII)."""
    for plain_class, body in ((r"[\w\-]", f"[{_W}\\-]"), (r"[^\s\"']", f"[^{_S}\"']"), (r"[^\s]", f"[^{_S}]"),
                              (r"\s", f"[{_S}]"), (r"\w", f"[{_W}]"), (r"\d", r"\p{Nd}")):
        pattern = pattern.replace(plain_class, body)
    return pattern.replace("'", "''")


def _keyword_re2(kw: str) -> str:
    return f"(?i)[{_W}]*{kw}[{_W}]*[{_S}]*[=:][{_S}]*[\"'']?[^\"''{_S}]+[\"'']?"


PATTERN_STEPS = [(_re2(p), "[REDACTED]") for p in rules.SECRET_PATTERNS]
KEYWORD_STEPS = [(_keyword_re2(k), f"[{k.upper()}_REDACTED]") for k in rules.SENSITIVE_KEYWORDS]


WHOLE = R.RedactionRules(max_length=None)


def fold_sql(expr: str, steps) -> str:
    for pattern, mark in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{mark}', 'g')"
    return expr


def truncate_sql(expr: str, limit: int) -> str:
    return (f"CASE WHEN length({expr}) > {limit} THEN concat(substr({expr}, 1, {limit}), chr(10), chr(10), "
            f"'... [TRUNCATED: ', length({expr}) - {limit}, ' characters removed]') ELSE {expr} END")


def _counted_sql(source: str, key: str, extra=()) -> str:
    """CTEs that apply one rule each and count its matches on that stage's text."""
    steps = PATTERN_STEPS + list(extra) + KEYWORD_STEPS
    ctes = [f"s0 AS (SELECT {key}, text AS t FROM ({source}))"]
    for i, (pattern, mark) in enumerate(steps):
        once = "MATERIALIZED " if i + 1 == len(steps) else ""
        ctes.append(f"s{i + 1} AS {once}(SELECT * EXCLUDE (t), len(regexp_extract_all(t, '{pattern}')) AS n{i}, "
                    f"regexp_replace(t, '{pattern}', '{mark}', 'g') AS t FROM s{i})")
    return "WITH " + ", ".join(ctes)


@query("b01_redact_patterns", f"SELECT doc_id, {fold_sql('text', PATTERN_STEPS)} AS sanitized FROM ({plain(SEEDED)})")
def b01(spark, sf_dir):
    return R.redact(bind(spark, sf_dir, SEEDED), ruleset=R.RedactionRules(keywords=(), max_length=None)).select("doc_id", "sanitized")


@query("b02_redact_keywords", f"""SELECT doc_id, {fold_sql('text', PATTERN_STEPS + KEYWORD_STEPS)} AS sanitized
  FROM ({plain(SEEDED)})""")
def b02(spark, sf_dir):
    return R.redact(bind(spark, sf_dir, SEEDED, dealt=True), ruleset=WHOLE).select("doc_id", "sanitized")


@query("b02_redact_conversations", f"""SELECT conv_id, turn, {fold_sql('text', PATTERN_STEPS + KEYWORD_STEPS)} AS sanitized
  FROM conversations""")
def b02_conversations(spark, sf_dir):
    return R.redact(table(spark, sf_dir, "conversations"), ruleset=WHOLE).select("conv_id", "turn", "sanitized")


@query("b03_truncate_text", f"SELECT doc_id, {truncate_sql('text', 2000)} AS clipped FROM documents")
def b03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.truncate_text(F.col("text"), 2000).alias("clipped"))


@query("b04_redact_sensitive_files", f"""WITH f AS (SELECT doc_id, {PATHS} AS path, text FROM documents),
  c AS (SELECT *, {fold_sql('text', PATTERN_STEPS + KEYWORD_STEPS)} AS clean FROM f)
  SELECT doc_id, path, CASE WHEN contains(lower(path), '.env') OR contains(lower(path), '.pem')
    OR contains(lower(path), '.key') OR contains(lower(path), 'credentials') OR contains(lower(path), 'secrets')
    OR contains(lower(path), '.renviron') THEN concat('[FILE CONTENTS REDACTED: ', path, ']')
    ELSE clean END AS sanitized FROM c""")
def b04(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATHS} AS path", "text")
    out = R.redact(docs, path="path", ruleset=R.RedactionRules(extra_files=(".Renviron",)))
    return out.select("doc_id", "path", "sanitized")


_N = len(PATTERN_STEPS)
_LOG_SQL = "concat_ws('; ', " + ", ".join(
    [f"CASE WHEN n{i} > 0 THEN concat('Pattern {i + 1}: ', n{i}, ' match(es) redacted') END" for i in range(_N)]
    + [f"CASE WHEN n{_N + i} > 0 THEN 'Keyword ''{k}'' redacted' END" for i, k in enumerate(rules.SENSITIVE_KEYWORDS)]
    + ["CASE WHEN length(t) > 5000 THEN concat('Truncated from ', length(t), ' to 5000 characters') END"]) + ")"


@query("b05_redaction_log", _counted_sql(plain(SEEDED), "doc_id") + f"""
  SELECT doc_id, {_LOG_SQL} AS log, {_LOG_SQL} <> '' AS was_modified FROM s{len(PATTERN_STEPS + KEYWORD_STEPS)}""")
def b05(spark, sf_dir):
    out = R.redact_with_log(bind(spark, sf_dir, SEEDED), ruleset=R.RedactionRules(max_length=5000))
    return out.select("doc_id", F.array_join("redactions", "; ").alias("log"), "was_modified")


LANGUAGE_TEXT = """SELECT doc_id, CASE lang WHEN 'en' THEN 'sas' WHEN 'fr' THEN 'r' WHEN 'de' THEN 'matlab' ELSE 'python' END
    AS language, CASE WHEN doc_id % 3 = 0 THEN 'proj/.Rprofile' ELSE 'proj/code' END AS path,
  concat(text, chr(10), '%let Password = ', source, ';', chr(10), 'libname lib oracle user = ', source) AS text
  FROM {documents}"""
_SAS = [(_re2(p), "[REDACTED]") for p in rules.LANGUAGES["sas"]["secrets"]]


@query("b06_language_secret_rules", f"""WITH f AS ({plain(LANGUAGE_TEXT)}), p AS (SELECT *,
    {fold_sql('text', PATTERN_STEPS)} AS t0 FROM f),
  e AS (SELECT *, CASE WHEN language = 'sas' THEN {fold_sql('t0', _SAS)} ELSE t0 END AS t1 FROM p),
  k AS (SELECT *, {fold_sql('t1', KEYWORD_STEPS)} AS t2 FROM e)
  SELECT doc_id, language, CASE WHEN language = 'r' AND contains(lower(path), '.rprofile')
    THEN concat('[FILE CONTENTS REDACTED: ', path, ']') ELSE t2 END AS sanitized FROM k""")
def b06(spark, sf_dir):
    out = R.redact_by_language(bind(spark, sf_dir, LANGUAGE_TEXT), "text", "language", "path")
    return out.select("doc_id", "language", "sanitized")


def _report_sql(source: str, key: str) -> str:
    steps = PATTERN_STEPS + KEYWORD_STEPS
    rows = " UNION ALL ".join(
        f"SELECT '{name.replace(chr(39), chr(39) * 2)}' AS rule, coalesce(sum(n{i}), 0)::BIGINT AS hits, "
        f"count(*) FILTER (n{i} > 0) AS files, count(*) FILTER (n{i} > 0) / count(*) AS share FROM s{len(steps)}"
        for i, name in enumerate(R.rule_names()))
    return _counted_sql(source, key) + rows


@query("b07_redaction_report", _report_sql("SELECT doc_id, text FROM documents", "doc_id"))
def b07(spark, sf_dir):
    return R.redaction_report(spread(table(spark, sf_dir, "documents")))


@query("b07_redaction_report_seeded", _report_sql(plain(SEEDED), "doc_id"))
def b07_seeded(spark, sf_dir):
    return R.redaction_report(bind(spark, sf_dir, SEEDED, dealt=True))


EMOJI_TEXT = """SELECT conv_id, turn, role, concat(CASE turn % 3 WHEN 0 THEN '😀🚀 ok ' WHEN 1 THEN '⚠ 中文 done☀ ' ELSE '' END,
  text, CASE WHEN role = 'user' THEN ' 🧪' ELSE '' END) AS text FROM {conversations}"""


@query("b08_strip_emoji", f"SELECT conv_id, turn, regexp_replace(text, '{R.EMOJI}', '', 'g') AS clean FROM ({plain(EMOJI_TEXT)})")
def b08(spark, sf_dir):
    return bind(spark, sf_dir, EMOJI_TEXT).select("conv_id", "turn", R.strip_emoji(F.col("text")).alias("clean"))


@query("b09_strip_emoji_nested", f"""SELECT conv_id, turn, 7 AS kept, regexp_replace(text, '{R.EMOJI}', '', 'g') AS value,
  concat(role, '|', regexp_replace(concat(role, '☀'), '{R.EMOJI}', '', 'g'), '|😀') AS inner_text FROM ({plain(EMOJI_TEXT)})""")
def b09(spark, sf_dir):
    df = bind(spark, sf_dir, EMOJI_TEXT).select("conv_id", "turn", F.struct(
        F.col("text").alias("value"), F.lit(7).alias("kept"),
        F.array(F.create_map(F.lit("😀"), F.concat("role", F.lit("☀"))),
                F.create_map(F.lit("r"), F.col("role"))).alias("cells")).alias("nested"))
    clean = R.strip_emoji_nested(F.col("nested"), df.schema["nested"].dataType)
    return df.withColumn("nested", clean).select(
        "conv_id", "turn", "nested.value", "nested.kept",
        F.concat_ws("|", F.col("nested.cells")[1]["r"], F.map_values(F.col("nested.cells")[0])[0],
                    F.map_keys(F.col("nested.cells")[0])[0]).alias("inner_text"))
