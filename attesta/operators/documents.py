"""Document-plan tables: spec parsing and validation, section expansion, content checks, notebook cells.

specs(spec_id, project, body) hold YAML or JSON text; notebook cells are (notebook, cell_no, cell_type, source).
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from attesta import rules
from attesta.functions import citations as C
from attesta.functions.text import contains_any, is_blank, safe_float, strip, WORD
from attesta.operators.scans import dealt_by, ranked, running_totals
from attesta.session import materialise

try:
    import yaml
except ImportError:  # specs are then read as JSON only
    yaml = None

# --- fixed values: defaults and limits of a spec ---
AUTHORS, CITATION_STYLE, PER_MODEL = "Data Science Team", "numeric", ": per_model"
MAX_TITLE, MAX_SECTIONS, MAX_NAME, MAX_HINT = 500, 50, 200, 1000
SECTION_KEYS = ("name", "per_model", "hint")
SYNTAX = "Invalid YAML syntax"
MODELS_PER_ROW = 256  # of a project, in one row that meets a spec

_VARIANTS = "array<variant>"


def _get(variant: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(variant, path, dtype)


def _kind(variant: Column) -> Column:
    """str, list, dict, bool, int, float or NoneType; null where the value is absent."""
    schema = F.schema_of_variant(variant)
    return (F.when(variant.isNull(), F.lit(None).cast("string")).when(schema == "STRING", "str")
            .when(F.startswith(schema, F.lit("ARRAY")), "list").when(F.startswith(schema, F.lit("OBJECT")), "dict")
            .when(schema == "BOOLEAN", "bool").when(schema == "BIGINT", "int").when(schema == "VOID", "NoneType")
            .otherwise("float"))


def _keys(variant: Column) -> Column:
    return F.coalesce(F.map_keys(_get(variant, "$", "map<string,variant>")), F.array().cast("array<string>"))


def _plain_name(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit(PER_MODEL)), F.replace(text, F.lit(PER_MODEL), F.lit(""))).otherwise(text)


#: What libyaml may read otherwise than the parser written in Python (tags, anchors, escapes, tabs, flow style, odd line ends), and
#: lines that can open blocks deep enough for the latter's recursion limit.
_READ_APART = re.compile("[!&*%?\\\\\t\r\x85\u2028\u2029\ufeff\\[\\]{}]|^[ :-]{64}", re.M)


def _as_json(body: str | None) -> tuple[str | None, str | None]:
    """A YAML text as JSON, or what is wrong with it. libyaml, where it is there, reads the texts that both parsers read alike;
    what it refuses is read again, for the message."""
    if body is None or yaml is None:
        return None, SYNTAX
    if yaml.__with_libyaml__ and not _READ_APART.search(body):
        try:
            return json.dumps(yaml.load(body, Loader=yaml.CSafeLoader), default=str, ensure_ascii=False), None
        except (yaml.YAMLError, ValueError):
            pass
    try:
        return json.dumps(yaml.safe_load(body), default=str, ensure_ascii=False), None
    except yaml.MarkedYAMLError as e:
        at = f" at line {e.problem_mark.line + 1}, column {e.problem_mark.column + 1}" if e.problem_mark else ""
        return None, f"{SYNTAX}{at}: {e.problem}"
    except (yaml.YAMLError, ValueError, RecursionError):
        return None, SYNTAX


def with_body(specs: DataFrame) -> DataFrame:
    """Add ``v``, the parsed body (null where it is neither JSON nor YAML), and ``syntax``, what is wrong with it then.
    Only bodies that are no JSON leave the JVM; rows are dealt over tasks first, in however few files they come."""
    @F.pandas_udf("struct<json:string,error:string>")
    def as_json(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_as_json(b) for b in bodies], columns=["json", "error"])

    direct = F.try_parse_json("body")
    read = specs.hint("rebalance").withColumn("_yaml", as_json(F.when(direct.isNull(), F.col("body"))))
    return read.withColumns({"v": F.coalesce(direct, F.try_parse_json("_yaml.json")), "syntax": F.col("_yaml.error")}).drop("_yaml")


def parse_specs(specs: DataFrame) -> DataFrame:
    """Title, authors, style, hints and the ordered ``sections`` array of every spec, defaults filled in."""
    s = with_body(specs)

    def section(x: Column, i: Column) -> Column:
        text, is_text = _get(x, "$", "string"), _kind(x) == "str"
        return F.struct((i + 1).alias("pos"),
                        F.when(is_text, _plain_name(text)).otherwise(_get(x, "$.name", "string")).alias("name"),
                        F.when(is_text, F.endswith(text, F.lit(PER_MODEL)))
                        .otherwise(F.coalesce(_get(x, "$.per_model", "boolean"), F.lit(False))).alias("per_model"),
                        F.when(~is_text, _get(x, "$.hint", "string")).alias("hint"))

    usable = F.filter(F.coalesce(_get(F.col("v"), "$.sections", _VARIANTS), F.array().cast(_VARIANTS)),
                      lambda x: _kind(x).isin("str", "dict"))
    return s.withColumns({
        "title": _get(F.col("v"), "$.title", "string"),
        "authors": F.coalesce(_get(F.col("v"), "$.authors", "string"), F.lit(AUTHORS)),
        "citation_style": F.coalesce(_get(F.col("v"), "$.citation_style", "string"), F.lit(CITATION_STYLE)),
        "hints": _get(F.col("v"), "$.hints", "map<string,string>"),
        "sections": F.transform(usable, section)}).drop("v", "syntax", "body")


def _exploded(specs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and a row ``s`` per section. The outer form: for the plain one, Spark adds a filter for specs that have sections,
    moves it to the scan and so parses every body twice, the first time in one task per file."""
    return specs.select(*columns, F.explode_outer("sections").alias("s")).filter(F.col("s").isNotNull())


def parse_sections(specs: DataFrame) -> DataFrame:
    """One row per section."""
    return _exploded(parse_specs(specs), "spec_id").select("spec_id", "s.*")


def _section_errors(x: Column, i: Column) -> Column:
    head = F.concat(F.lit("Section "), (i + 1).cast("string"))
    kind = _kind(x)
    text = _get(x, "$", "string")
    bare = _plain_name(text)
    name, hint = _get(x, "$.name", "string"), _get(x, "$.hint", "string")
    name_is_text = _kind(F.variant_get(x, "$.name", "variant")) == "str"
    unknown = F.array_sort(F.array_except(_keys(x), F.array(*[F.lit(k) for k in SECTION_KEYS])))

    def too_long(value: Column) -> Column:
        return F.concat(head, F.lit(" ('"), F.substring(value, 1, 30), F.lit("...'): name too long ("),
                        F.length(value).cast("string"), F.lit(f" chars, max {MAX_NAME})"))

    of_text = F.when(is_blank(bare), F.concat(head, F.lit(": name must not be empty"))).when(
        F.length(bare) > MAX_NAME, too_long(bare))
    of_dict = (F.when(~F.array_contains(_keys(x), "name"), F.concat(head, F.lit(": missing required key 'name'")))
               .when(~F.coalesce(name_is_text, F.lit(False)) | is_blank(name), F.concat(head, F.lit(": 'name' must be a non-empty string")))
               .when(F.length(name) > MAX_NAME, too_long(name)))
    of_hint = F.when((_kind(F.variant_get(x, "$.hint", "variant")) == "str") & (F.length(hint) > MAX_HINT), F.concat(
        head, F.lit(": hint too long ("), F.length(hint).cast("string"), F.lit(f" chars, max {MAX_HINT})")))
    of_keys = F.when(F.size(unknown) > 0, F.concat(head, F.lit(": unexpected keys ['"), F.array_join(unknown, "', '"), F.lit("']")))
    other = F.concat(head, F.lit(": must be a string or mapping, got "), kind)
    return (F.when(kind == "str", F.array(of_text)).when(kind == "dict", F.array(of_dict, of_hint, of_keys))
            .otherwise(F.array(other)))


def validate_specs(specs: DataFrame) -> DataFrame:
    """Add ``errors``, all problems of a spec in a fixed order; empty means valid. Sections are checked in the row:
    a spec that passes the count check has at most fifty."""
    s = with_body(specs)
    v, kind = F.col("v"), _kind(F.col("v"))
    keys = _keys(v)
    title, sections = _get(v, "$.title", "string"), _get(v, "$.sections", _VARIANTS)

    def part(name: str) -> Column:
        return _kind(F.try_variant_get(v, f"$.{name}", "variant"))

    no_map = F.concat(F.lit("Spec file must be a YAML mapping (key: value pairs), not a "), kind)
    title_error = (F.when(~F.array_contains(keys, "title"), "Missing required field: 'title'")
                   .when((part("title") != "str") | is_blank(title), "'title' must be a non-empty string")
                   .when(F.length(title) > MAX_TITLE, F.concat(F.lit("'title' is too long ("), F.length(title).cast("string"),
                                                              F.lit(f" characters, max {MAX_TITLE})"))))
    n = F.size(sections)
    listing = (F.when(~F.array_contains(keys, "sections"), "Missing required field: 'sections'")
               .when(part("sections") != "list", "'sections' must be a list")
               .when(n == 0, "'sections' must contain at least 1 section")
               .when(n > MAX_SECTIONS, F.concat(F.lit("Too many sections ("), n.cast("string"), F.lit(f"). Maximum is {MAX_SECTIONS}."))))
    per_section = F.when(listing.isNull(), F.flatten(F.transform(sections, _section_errors)))

    def must_map(name: str, message: str) -> Column:
        return F.when(F.array_contains(keys, name) & (part(name) != "dict"), message)

    rest = F.concat(F.array(title_error, listing), F.coalesce(per_section, F.array().cast("array<string>")),
                    F.array(must_map("hints", "'hints' must be a mapping of section name to hint text"),
                            must_map("formatting", "'formatting' must be a mapping")))
    errors = (F.when(v.isNull(), F.array(F.col("syntax"))).when(kind != "dict", F.array(no_map)).otherwise(rest))
    return s.withColumn("errors", F.array_compact(errors)).drop("v", "syntax")


# --- sections ------------------------------------------------------------------------------------

def expand_sections(specs: DataFrame, models: DataFrame) -> DataFrame:
    """parse_specs output x models(project, ord, name, run_id): per-model sections once per model of the project,
    numbered i.j; others, and per-model ones without models, once, numbered i.

    The result is many times either table, which no estimate knows, so specs are dealt over a fixed number of tasks by id, and stay
    there where Spark broadcasts the models: these come in arrays of MODELS_PER_ROW, and a left join never broadcasts the specs.
    """
    numbered = ranked(models, ["project"], ["ord"], "j").withColumn("_block", F.floor((F.col("j") - 1) / MODELS_PER_ROW))
    one = F.struct("j", F.concat(F.lit("."), F.col("j").cast("string")).alias("tail"), "name", "run_id")
    packed = materialise(numbered.groupBy("project", "_block").agg(F.array_sort(F.collect_list(one)).alias("_models")), "models")
    blocks = packed.groupBy("project").agg(F.max("_block").alias("_last"))
    done = F.transform("sections", lambda s: F.struct(
        s["pos"].cast("string").alias("pos"), s["name"].alias("name"), s["per_model"].alias("per_model"),
        F.coalesce(C.text_or_null(s["hint"]), F.try_element_at("hints", s["name"])).alias("hint")))
    rows = dealt_by(specs.select("spec_id", "project", done.alias("sections")), "spec_id").join(blocks, "project", "left")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_last", F.lit(0).cast("bigint")))))
    flat = _exploded(rows.join(packed, ["project", "_block"], "left"), "spec_id", "_block", "_models")
    each = flat.filter(F.col("s.per_model") | (F.col("_block") == 0)).select(
        "spec_id", "s", F.explode_outer(F.when(F.col("s.per_model"), F.col("_models"))).alias("m"))
    number = F.concat(F.col("s.pos"), F.coalesce(F.col("m.tail"), F.lit("")))
    return each.select("spec_id", number.alias("number"), F.col("s.name").alias("name"), F.col("m.name").alias("model_name"), "m.run_id",
                       F.col("s.hint").alias("hint"))


def number_key(number: Column) -> Column:
    """Sort key of a section number: its integer parts."""
    return F.transform(F.split(number, r"\."), lambda p: p.cast("int"))


def order_sections(sections: DataFrame) -> DataFrame:
    return sections.orderBy(number_key(F.col("number")))


def section_positions(sections: DataFrame, document: str, dealt: bool = False) -> DataFrame:
    """Add ``position``, the 1-based place of each section in its document.

    Documents of any length are cut into ranges. ``dealt``: the rows of a document are made by one task anyway, as those of
    :func:`expand_sections`; they are numbered there, without moving, where that task has not given them away in a join.
    """
    number = F.col("number")
    second = F.substring_index(F.substring_index(number, ".", 2), ".", -1).cast("int")  # number_key(), without an array per row
    parts = sections.withColumns({"_major": F.substring_index(number, ".", 1).cast("int"),
                                  "_minor": F.when(F.contains(number, F.lit(".")), second).otherwise(0)})
    if dealt:
        place = F.row_number().over(Window.partitionBy(document).orderBy("_major", "_minor")).cast("bigint")
        return parts.withColumn("position", place).drop("_major", "_minor")
    bucket = F.col("_major").cast("bigint") * 1_000_000 + F.floor(F.col("_minor") / 1000)
    return ranked(parts, [document], ["_major", "_minor"], "position", bucket=bucket).drop("_major", "_minor")


def normalise_block_type(kind: Column) -> Column:
    return F.when(kind.isin(*rules.BLOCK_TYPES), kind).otherwise("narrative")


def plan_title(title: Column, name: Column, model: Column) -> Column:
    """The planned title, or the section name; the model's name is appended unless it is there already."""
    base = F.coalesce(title, name)
    missing = C.text_or_null(model).isNotNull() & ~F.contains(base, model)
    return F.when(missing, F.concat(base, F.lit(" - "), model)).otherwise(base)


def plan_normalise(plans: DataFrame) -> DataFrame:
    """plans(name, title, model_name, failed, block_type, purpose, data_needed): known block types only, model in the
    title; a failed plan becomes one narrative block."""
    failed, name, model = F.col("failed"), F.col("name"), F.col("model_name")
    fallback = F.when(C.text_or_null(model).isNull(), name).otherwise(F.concat(name, F.lit(" - "), model))
    return plans.withColumns({
        "title": F.when(failed, fallback).otherwise(plan_title(F.col("title"), name, model)),
        "block_type": F.when(failed, "narrative").otherwise(normalise_block_type(F.col("block_type"))),
        "purpose": F.when(failed, F.concat(F.lit("Describe "), name)).otherwise(F.coalesce("purpose", F.lit(""))),
        "data_needed": F.when(failed, "Available context").otherwise(F.coalesce("data_needed", F.lit("")))})


def split_ok_errors(sections: DataFrame, results: str = "results") -> DataFrame:
    """A section's block results array<struct<ok, type, content, message>> -> ``contents`` and ``errors`` in order."""
    good = F.filter(results, lambda r: r["ok"] & r["content"].isNotNull())
    bad = F.filter(results, lambda r: ~r["ok"])
    return sections.withColumns({
        "contents": F.transform(good, lambda r: r["content"]),
        "errors": F.transform(bad, lambda r: F.concat(r["type"], F.lit(": "), r["message"]))})


# --- content checks ------------------------------------------------------------------------------

def is_metrics_table(purpose: Column, data_needed: Column) -> Column:
    both = F.concat(F.lower(purpose), F.lit(" "), F.lower(F.coalesce(data_needed, F.lit(""))))
    return contains_any(both, rules.METRIC_WORDS)


def table_has_content(rows: Column) -> Column:
    """Any cell of array<map<string,string>> that is no placeholder."""
    def real(cell: Column) -> Column:
        return cell.isNotNull() & ~F.lower(strip(cell)).isin(*rules.PLACEHOLDERS)

    return F.coalesce(F.exists(rows, lambda r: F.exists(F.map_values(r), real)), F.lit(False))


_TOKEN = r'"(?:[^"\\]|\\.)*+"\s*+:?|-?[0-9]++(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null'


def coerce_numeric(json_text: Column) -> Column:
    """First number inside a JSON value, depth first: numbers, booleans, number-like strings, else null."""
    def value(token: Column) -> Column:
        quoted = F.startswith(token, F.lit('"'))
        return (F.when(quoted, safe_float(F.substring(token, F.lit(2), F.length(token) - 2)))
                .when(token == "true", 1.0).when(token == "false", 0.0).otherwise(token.try_cast("double")))

    tokens = F.filter(F.regexp_extract_all(json_text, F.lit(_TOKEN), F.lit(0)), lambda t: ~F.endswith(t, F.lit(":")))
    numbers = F.filter(F.transform(tokens, value), lambda x: x.isNotNull())
    return F.try_element_at(numbers, F.lit(1))


def chart_series(labels: Column, values: Column) -> Column:
    """Array of (label, value): missing labels are counted up, the longer side is cut, non-numeric pairs dropped.

    ``values`` are JSON texts.
    """
    counted = F.transform(values, lambda _, i: (i + 1).cast("string"))
    names = F.when(F.size(labels) == 0, counted).otherwise(labels)
    n = F.least(F.size(names), F.size(values))
    pairs = F.zip_with(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n),
                       lambda a, b: F.struct(a.alias("label"), coerce_numeric(b).alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def toc_anchor(title: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")), rf"[^{WORD}\-]", "")


def toc_entries(sections: DataFrame) -> DataFrame:
    heading = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("title"))
    return sections.withColumns({"heading": heading, "anchor": toc_anchor(heading)})


def planning_preview(features: Column, limit: int = 20) -> Column:
    more = F.when(F.size(features) > limit, F.concat(F.lit(" (+"), (F.size(features) - limit).cast("string"), F.lit(" more)")))
    text = F.coalesce(C.text_or_null(F.array_join(F.slice(features, 1, limit), ", ")), F.lit("Unknown"))
    return F.concat(text, F.coalesce(more, F.lit("")))


def listing_or(values: Column, default: str) -> Column:
    return F.coalesce(C.text_or_null(F.array_join(values, ", ")), F.lit(default))


def artifact_prompt_rows(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """requests(.., run_id) x the run's artifacts(run_id, path, kind, content): data as text, images only announced."""
    shown = F.when(F.col("kind") == "image", F.concat(F.lit("## "), F.col("path"), F.lit(": [Image Available]"))).otherwise(
        F.concat(F.lit("## "), F.col("path"), F.lit(":\n"), F.coalesce("content", F.lit(""))))
    return requests.join(artifacts, "run_id").withColumn("line", shown)


# --- notebooks -----------------------------------------------------------------------------------

_HEADER = rf"^##\s+([\p{{Nd}}.]+)\.\s+([^\n]+)"


def notebook_sections(cells: DataFrame) -> DataFrame:
    """Content cells with the section they belong to: (notebook, cell_no, cell_type, source, number, title).

    A cell's section is the number of headers up to it, an exact running count that splits long notebooks over tasks.
    Cells before the first header and layout cells are dropped.
    """
    source, body = F.col("source"), strip(F.col("source"))
    markdown, code = F.col("cell_type") == "markdown", F.col("cell_type") == "code"
    setup = code & F.contains(source, F.lit("DOCUMENT_TITLE"))
    header = markdown & body.rlike(_HEADER)
    layout = markdown & ((F.startswith(source, F.lit("# ")) & F.contains(source, F.lit("Authors:")))
                         | F.startswith(body, F.lit("## References")) | F.contains(source, F.lit("Export to Word Document"))
                         | (F.contains(source, F.lit("---")) & (F.length(body) < 10)))
    exporter = code & F.contains(source, F.lit("NotebookExporter"))
    kind = F.when(setup, "skip").when(header, "header").when(layout | exporter, "skip").otherwise("content")
    marked = cells.select("notebook", "cell_no", "cell_type", "source", kind.alias("_kind"),
                          (kind == "header").cast("bigint").alias("_header"))
    counted = running_totals(marked, ["notebook"], ["cell_no"], {"_section": "_header"}, source=cells.select("cell_no"))
    opened = counted.filter(F.col("_kind") == "header").select(
        "notebook", "_section", F.regexp_extract(body, _HEADER, 1).alias("number"), F.regexp_extract(body, _HEADER, 2).alias("title"))
    return (counted.filter(F.col("_kind") == "content").join(opened, ["notebook", "_section"])
            .select("notebook", "cell_no", "cell_type", "source", "number", "title"))


def _filled_lines(source: Column) -> Column:
    lines = F.transform(F.split(strip(source), "\n"), strip)
    return F.filter(lines, lambda x: x != "")


def classify_cells(cells: DataFrame) -> DataFrame:
    """Add ``block_type`` and list ``items``; cells that are no content get a null type."""
    text = C.restore_markers(F.col("source"))
    lines = _filled_lines(text)
    numbered = r"^[\p{Nd}]+\.[\s]"
    bullets = F.forall(lines, lambda x: F.startswith(x, F.lit("- ")))
    counted = F.forall(lines, lambda x: x.rlike(numbered))
    markdown, code, source = F.col("cell_type") == "markdown", F.col("cell_type") == "code", F.col("source")
    chart = F.contains(source, F.lit("chart_data")) & F.contains(source, F.lit("plt."))
    table = F.contains(source, F.lit("pd.DataFrame")) | F.contains(source, F.lit("table_data"))
    kind = (F.when(markdown & bullets, "bullet_list").when(markdown & counted, "numbered_list").when(markdown, "narrative")
            .when(code & chart, "chart").when(code & table, "table"))
    items = (F.when(F.col("block_type") == "bullet_list", F.transform(lines, lambda x: F.substring(x, 3, 1 << 30)))
             .when(F.col("block_type") == "numbered_list", F.transform(lines, lambda x: F.regexp_replace(x, r"^[\p{Nd}]+\.\s+", ""))))
    return cells.withColumn("block_type", kind).withColumn("items", items)


CHART = T.StructType([T.StructField("title", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())),
                      T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("xlabel", T.StringType()),
                      T.StructField("ylabel", T.StringType())])


def _literal(source: Column, pattern: str, schema) -> Column:
    found = F.regexp_extract(source, pattern, 1)
    return F.from_json(F.nullif(found, F.lit("")), schema, {"allowSingleQuotes": "true"})


def recover_cell_data(cells: DataFrame) -> DataFrame:
    """Data written into code cells: chart, table rows, columns, caption, chart type, title and authors."""
    source = F.col("source")
    first = F.split(strip(source), "\n")[0]
    return cells.withColumns({
        "chart": _literal(source, r"chart_data\s*=\s*(\{[^}]+\})", CHART),
        "chart_type": F.when(F.contains(source, F.lit("ax.plot(")), "line")
        .when(F.contains(source, F.lit("ax.scatter(")), "scatter").otherwise("bar"),
        "rows": _literal(source, r"table_data\s*=\s*(\[[^\]]+\])", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        "columns": _literal(source, r"columns\s*=\s*(\[[^\]]+\])", T.ArrayType(T.StringType())),
        "caption": F.when(F.startswith(first, F.lit("#")), strip(F.substring(first, 2, 1 << 30))).otherwise("Table"),
        "doc_title": F.nullif(F.regexp_extract(source, r"""DOCUMENT_TITLE\s*=\s*["'](.+?)["']""", 1), F.lit("")),
        "doc_authors": F.nullif(F.regexp_extract(source, r"""DOCUMENT_AUTHORS\s*=\s*["'](.+?)["']""", 1), F.lit(""))})
