"""Citation ids and ``[@id]`` markers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attesta.functions.text import SPACE, WORD, basename, squeeze

# --- fixed values: id and marker formats ---
MARKER = r"\[@([^\]]+)\]"
RUN_TYPES = ("mlflow_run", "mlflow_metric", "mlflow_param", "mlflow_tag", "mlflow_summary")
CONSOLIDATED_TYPES = ("mlflow_metric", "mlflow_param", "mlflow_tag", "mlflow_summary")


def text_or_null(col: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(col, F.lit(""))


def sanitize_name(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, rf"[^{WORD}\-]", "_"), "_+", "_")
    return F.coalesce(text_or_null(F.regexp_replace(clean, "^_+|_+$", "")), F.lit("Unknown"))


def code_citation_id(path: Column, symbol: Column | None = None, start: Column | None = None,
                     end: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    start, end = (none if start is None else start), (none if end is None else end)
    mark = F.lit("") if symbol is None else F.coalesce(F.concat(F.lit("#"), text_or_null(symbol)), F.lit(""))
    first = F.concat(F.lit(":L"), start.cast("string"))
    lines = F.coalesce(F.concat(first, F.lit("-L"), end.cast("string")), first, F.lit(""))
    return F.concat(F.lit("Code:"), path, mark, lines)


def run_citation_id(experiment: Column, run: Column, run_id: Column) -> Column:
    exp = F.when(text_or_null(experiment).isNotNull(), sanitize_name(experiment)).otherwise(F.lit("Experiment"))
    name = F.when(text_or_null(run).isNotNull(), sanitize_name(run)).otherwise(
        F.coalesce(text_or_null(F.substring(run_id, 1, 8)), F.lit("Run")))
    return F.concat(exp, F.lit("-"), name)


def artifact_citation_id(experiment: Column, run: Column, path: Column, run_id: Column) -> Column:
    return F.concat(run_citation_id(experiment, run, run_id), F.lit(":"), basename(path))


def legacy_citation_id(run_id: Column, kind: Column | str, key: Column | str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    key = F.lit(key) if isinstance(key, str) else key
    return F.concat(F.lit("mlflow:run/"), run_id, F.lit("/"), kind, F.lit("/"), key)


def summary_citation_id(run_id: Column) -> Column:
    return legacy_citation_id(run_id, "summary", "all")


def parse_citation_id(cid: Column) -> Column:
    """Struct (type, code_path, code_symbol, start_line, end_line, run_id, source_key, artifact_path,
    experiment_name, run_name); the first rule that fits decides, fields a rule does not set are null."""
    is_code = cid.startswith("Code:") | cid.startswith("code:")
    raw = F.regexp_replace(F.substring(cid, 6, 1 << 30), r":L[0-9]+(?:-L[0-9]+)?$", "")
    lines = r":L([0-9]+)(?:-L([0-9]+))?$"

    legacy = r"(?s)^mlflow:run/([^/]*)/([^/]*)(?:/(.*))?$"
    is_legacy = cid.rlike(legacy)
    kind, key = F.regexp_extract(cid, legacy, 2), F.regexp_extract(cid, legacy, 3)

    base, has_colon = F.regexp_extract(cid, r"(?s)^(.*):[^:]*$", 1), F.contains(cid, F.lit(":"))
    is_artifact = has_colon & ~cid.startswith("mlflow:") & F.contains(base, F.lit("-"))
    is_run = ~has_colon & F.contains(cid, F.lit("-"))
    named = F.when(is_artifact, base).when(is_run, cid)

    def legacy_key(*kinds: str) -> Column:
        return F.when(~is_code & is_legacy & kind.isin(*kinds), key)

    return F.struct(
        F.when(is_code, "code_file").when(is_legacy, F.concat(F.lit("mlflow_"), kind))
        .when(is_artifact, "mlflow_artifact").when(is_run, "mlflow_run").otherwise("unknown").alias("type"),
        F.when(is_code, F.substring_index(raw, "#", 1)).alias("code_path"),
        F.when(is_code, F.regexp_extract(raw, r"(?s)^[^#]*#(.*)$", 1)).alias("code_symbol"),
        F.when(is_code, F.regexp_extract(cid, lines, 1).try_cast("int")).alias("start_line"),
        F.when(is_code, F.regexp_extract(cid, lines, 2).try_cast("int")).alias("end_line"),
        F.when(~is_code & is_legacy, F.regexp_extract(cid, legacy, 1)).alias("run_id"),
        legacy_key("metric", "param", "tag").alias("source_key"),
        F.when(~is_code & ~is_legacy & is_artifact, F.substring_index(cid, ":", -1))
        .otherwise(legacy_key("artifact")).alias("artifact_path"),
        F.when(~is_code & ~is_legacy, F.substring_index(named, "-", 1)).alias("experiment_name"),
        F.when(~is_code & ~is_legacy, F.regexp_extract(named, r"(?s)^[^-]*-(.*)$", 1)).alias("run_name"))


def marker_bodies(text: Column) -> Column:
    """Marker contents in order, combined ones not split; no text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), F.array().cast("array<string>"))


def extract_citations(text: Column) -> Column:
    """All ids in order; ``[@a; @b]`` and ``[@a, @b]`` count as two ids."""
    def split(body: Column) -> Column:
        parts = F.transform(F.split(body, rf"[;,][{SPACE}]*@"),
                            lambda p: F.regexp_replace(p, f"^[{SPACE}]+|[{SPACE}]+$", ""))
        return F.when(body.rlike("[;,] ?@"), F.filter(parts, lambda p: p != "")).otherwise(F.array(body))

    return F.flatten(F.transform(marker_bodies(text), split))


def strip_markers(text: Column) -> Column:
    """Text without markers, whitespace collapsed."""
    return squeeze(F.regexp_replace(text, MARKER, ""))


def strip_table(caption: Column, columns: Column, rows: Column) -> Column:
    """Struct (caption, columns, rows, found): markers removed from a table's texts and listed in reading order."""
    empty = F.array().cast("array<string>")
    in_columns = F.flatten(F.transform(columns, marker_bodies))
    in_rows = F.flatten(F.transform(rows, lambda r: F.flatten(F.transform(F.map_values(r), marker_bodies))))
    return F.struct(strip_markers(caption).alias("caption"), F.transform(columns, strip_markers).alias("columns"),
                    F.transform(rows, lambda r: F.transform_values(r, lambda _, v: strip_markers(v))).alias("rows"),
                    F.concat(marker_bodies(caption), F.coalesce(in_columns, empty), F.coalesce(in_rows, empty))
                    .alias("found"))


def merge_ids(first: Column, second: Column) -> Column:
    """Ordered union; empty ids dropped, the first occurrence stays."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(first, empty), F.coalesce(second, empty))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))


def collect_ids(*parts: Column) -> Column:
    """Distinct ids of several texts or text arrays, read as one text."""
    return F.array_distinct(extract_citations(F.concat_ws(" ", *parts)))


def collect_table_ids(caption: Column, columns: Column, rows: Column) -> Column:
    return collect_ids(text_or_null(caption), columns, F.flatten(F.transform(rows, F.map_values)))


def render_markers(text: Column, extra: Column | None = None, markdown: bool = False) -> Column:
    """Markers as ``[id]`` or as a link with a hidden id; unused extra ids are appended."""
    shape = "[{0}](#ref-{0})<!-- @cite:{0} -->" if markdown else "[{0}]"
    out = F.regexp_replace(F.coalesce(text, F.lit("")), MARKER, shape.format("$1"))
    if extra is None:
        return out
    fresh = F.array_distinct(F.array_except(F.coalesce(extra, F.array().cast("array<string>")), marker_bodies(text)))
    pieces = shape.split("{0}")
    marks = F.transform(fresh, lambda i: F.concat(F.lit(" "), F.lit(pieces[0]),
                                                  *[x for p in pieces[1:] for x in (i, F.lit(p))]))
    return F.concat(out, F.array_join(marks, ""))


def restore_markers(text: Column) -> Column:
    """Rendered links with a hidden id back to markers."""
    link = rf"\[([^\]]+)\]\(#ref-[^\)]+\)[{SPACE}]*<!--[{SPACE}]*@cite:([^{SPACE}]+)[{SPACE}]*-->"
    return F.regexp_replace(F.coalesce(text, F.lit("")), link, r"[@$2]")


def collapse_metric_id(cid: Column) -> Column:
    """Metric, param and tag ids become the summary id of their run."""
    parsed = parse_citation_id(cid)
    single = parsed["type"].isin("mlflow_metric", "mlflow_param", "mlflow_tag") & text_or_null(parsed["run_id"]).isNotNull()
    return F.when(single, summary_citation_id(parsed["run_id"])).otherwise(cid)


def run_url(base: Column, experiment_id: Column, run_id: Column) -> Column:
    root = F.regexp_replace(base, "/+$", "")
    with_exp = F.concat(root, F.lit("/#/experiments/"), text_or_null(experiment_id), F.lit("/runs/"), run_id)
    plain = F.concat(root, F.lit("/#/runs/"), run_id)
    return F.when(text_or_null(base).isNull(), F.lit("")).otherwise(F.coalesce(with_exp, plain))


def reference_text(entry: Column) -> Column:
    """Display text of a resolved entry struct (id, type, run_id, experiment_name, run_name, code_path, code_symbol,
    artifact_path)."""
    def part(prefix: str, value: Column, suffix: str = "") -> Column:
        return F.coalesce(F.concat(F.lit(prefix), text_or_null(value), F.lit(suffix)), F.lit(""))

    exp, run, rid = entry["experiment_name"], entry["run_name"], entry["run_id"]
    code = F.concat(F.lit("Source Code\n    File: "), F.coalesce(text_or_null(entry["code_path"]), F.lit("unknown")),
                    part(", Symbol: ", entry["code_symbol"], "()"))
    by_run = F.when(text_or_null(run).isNotNull(), part(" | Run: ", run)).otherwise(part("\n    Run ID: ", rid))
    artifact = F.concat(F.lit("Artifact\n    File: "),
                        F.coalesce(text_or_null(basename(entry["artifact_path"])), F.lit("unknown")),
                        part("\n    Experiment: ", exp), by_run)
    model = F.concat(F.lit("Model Run"), part("\n    Experiment: ", exp), part(" | Run: ", run), part("\n    Run ID: ", rid))
    return (F.when(entry["type"] == "code_file", code).when(entry["type"] == "mlflow_artifact", artifact)
            .when(entry["type"].isin(*RUN_TYPES), model).otherwise(F.concat(F.lit("Reference: "), entry["id"])))


def bibliography_line(entry: Column) -> Column:
    """One-line reference of a resolved entry, parts joined by a bar."""
    def without(col: Column, *names: str) -> Column:
        for name in names:
            col = F.replace(col, F.lit(name), F.lit(""))
        return col

    cid, kind = entry["id"], entry["type"]
    joined = F.regexp_replace(F.regexp_replace(cid, rf",[{SPACE}]*@?Code:", ", "), rf";[{SPACE}]*@?Code:", "; ")
    symbol = without(F.coalesce(entry["code_symbol"], F.lit("")), ".__init__", ".__call__", ".__new__")
    path = text_or_null(entry["code_path"])
    code = F.coalesce(F.concat(F.lit("Code: "), path, F.coalesce(F.concat(F.lit("#"), text_or_null(symbol)), F.lit(""))),
                      without(joined, ".__init__", ".__call__", ".__new__"))
    head = (F.when(kind == "mlflow_artifact", F.concat(cid, F.lit(" | Artifact: "), F.coalesce(entry["artifact_path"], F.lit(""))))
            .when(kind.isin(*RUN_TYPES), F.concat(cid, F.lit(" | Model Run")))
            .when(kind == "code_file", code).otherwise(without(joined, ".__init__")))
    return F.concat_ws(" | ", head, F.concat(F.lit("Experiment: "), text_or_null(entry["experiment_name"])),
                       F.concat(F.lit("Run: "), text_or_null(entry["run_name"])),
                       F.concat(F.lit("Link: "), text_or_null(entry["run_url"])))


def trace_label(cid: Column) -> Column:
    """How a source is listed in the traceability table."""
    p = parse_citation_id(cid)
    start, end = F.nullif(p["start_line"], F.lit(0)), F.nullif(p["end_line"], F.lit(0))
    lines = F.coalesce(F.concat(F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")")),
                       F.concat(F.lit(" (line "), start.cast("string"), F.lit(")")), F.lit(""))
    code = F.concat(p["code_path"], F.coalesce(F.concat(F.lit("#"), text_or_null(p["code_symbol"])), F.lit("")), lines)
    pair = F.concat(F.coalesce(p["experiment_name"], F.lit("")), F.lit("/"), F.coalesce(p["run_name"], F.lit("")))
    artifact = F.concat(F.lit("MLflow Artifact: "), p["artifact_path"], F.lit(" ("), pair, F.lit(")"))
    run = F.concat(F.lit("MLflow Run: "), F.when(text_or_null(p["experiment_name"]).isNotNull(), pair)
                   .otherwise(F.coalesce(p["run_id"], F.lit(""))))
    return (F.when(p["type"] == "code_file", code)
            .when(p["type"] == "mlflow_artifact", F.coalesce(artifact, F.lit("MLflow Artifact:  (/)")))
            .when(p["type"].startswith("mlflow_"), run).otherwise(cid))
