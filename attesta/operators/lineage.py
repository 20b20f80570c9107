"""Citation lineage over blocks and details: sections, numbering, bibliography, traceability, metric citations.

An occurrence table has (doc_id, seq, pos, citation_id): ``seq`` orders the blocks of a document (bigint), ``pos`` the
ids inside a block. details(doc_id, citation_id, type, run_id, experiment_id, experiment_name, run_name, code_path,
code_symbol, artifact_path) has one row per id of a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions import citations as C
from attesta.functions.numbers import fixed
from attesta.functions.text import SPACE, squeeze, unicode_regex
from attesta.operators.scans import ranked
from attesta.session import materialise

BLOCKS_PER_RANGE = 1024
DETAIL_FIELDS = ("type", "run_id", "experiment_id", "experiment_name", "run_name", "code_path", "code_symbol",
                 "artifact_path")


def occurrences(blocks: DataFrame, text: str = "text") -> DataFrame:
    """One row per id mentioned in a block's text."""
    return (blocks.select("doc_id", "seq", F.posexplode(C.extract_citations(F.col(text))).alias("pos", "citation_id")))


def section_citations(blocks: DataFrame) -> DataFrame:
    """blocks(.., block_type, text, citations) + ``clean_text``, ``block_citations`` and ``section_citations``:
    text and lists hand their ids to the section, tables, charts and images also keep them."""
    merged = C.merge_ids(F.col("citations"), C.marker_bodies(F.col("text")))
    moves_up = F.col("block_type").isin("narrative", "bullet_list", "numbered_list")
    return blocks.withColumns({
        "clean_text": C.strip_markers(F.col("text")), "section_citations": merged,
        "block_citations": F.when(moves_up, F.array().cast("array<string>")).otherwise(merged)})


def used_details(details: DataFrame, used: DataFrame) -> DataFrame:
    """The details whose id occurs in the document's used ids."""
    return details.join(used.select("doc_id", "citation_id"), ["doc_id", "citation_id"], "left_semi")


def normalise_section(ids: DataFrame, details: DataFrame) -> DataFrame:
    """ids(doc_id, section, pos, citation_id), details(doc_id, section, citation_id, ord, run_id, experiment_id, type):
    run ids of any kind become their run's summary id; the first position of each id stays."""
    parsed = C.parse_citation_id(F.col("citation_id"))
    run_id = F.when(parsed["type"].startswith("mlflow_"), C.text_or_null(parsed["run_id"]))
    firsts = (ids.withColumn("_run", run_id)
              .withColumn("citation_id", F.coalesce(C.summary_citation_id(F.col("_run")), F.col("citation_id")))
              .groupBy("doc_id", "section", "citation_id").agg(F.min("pos").alias("pos"), F.first("_run").alias("run")))
    known = details.filter(C.text_or_null(F.col("run_id")).isNotNull() & C.text_or_null(F.col("experiment_id")).isNotNull())
    by_run = known.groupBy("doc_id", "section", F.col("run_id").alias("run")).agg(
        F.max_by("experiment_id", "ord").alias("_exp"))
    own = details.groupBy("doc_id", "section", "citation_id").agg(
        F.max_by(F.struct("type", "run_id", "experiment_id"), "ord").alias("_own"))
    joined = (firsts.join(by_run, ["doc_id", "section", "run"], "left")
              .join(own, ["doc_id", "section", "citation_id"], "left"))
    summary = F.col("run").isNotNull()
    return joined.select("doc_id", "section", "pos", "citation_id",
                         F.when(summary, "mlflow_summary").otherwise(F.col("_own.type")).alias("type"),
                         F.when(summary, F.col("run")).otherwise(F.col("_own.run_id")).alias("run_id"),
                         F.when(summary, F.col("_exp")).otherwise(F.col("_own.experiment_id")).alias("experiment_id"))


def number_citations(found: DataFrame, details: DataFrame) -> DataFrame:
    """(doc_id, citation_id, canonical_id, number): numbers follow first appearance; ids that stand for the same run
    (metric, param, tag, summary) share the run's first id. Only distinct ids are ordered, in ranges of blocks."""
    shares = F.col("type").isin(*C.CONSOLIDATED_TYPES) & C.text_or_null(F.col("run_id")).isNotNull()
    runs = details.filter(shares).groupBy("doc_id", "citation_id").agg(F.min("run_id").alias("run"))
    ids = (found.groupBy("doc_id", "citation_id").agg(F.min(F.struct("seq", "pos")).alias("first"))
           .join(runs, ["doc_id", "citation_id"], "left"))
    ids = materialise(ids, "citation-ids")  # read four times below; without it each read would parse the texts again
    run_first = (ids.filter(F.col("run").isNotNull()).groupBy("doc_id", "run")
                 .agg(F.min(F.struct("first", "citation_id")).alias("f"))
                 .select("doc_id", "run", F.col("f.citation_id").alias("_canonical")))
    named = (ids.join(run_first, ["doc_id", "run"], "left")
             .withColumn("canonical_id", F.coalesce("_canonical", "citation_id")))
    entries = named.groupBy("doc_id", "canonical_id").agg(F.min("first").alias("first"))
    numbered = ranked(entries.select("doc_id", "canonical_id", "first.seq", "first.pos"), ["doc_id"], ["seq", "pos"],
                      "number", bucket=F.floor(F.col("seq") / BLOCKS_PER_RANGE))
    return (named.select("doc_id", "citation_id", "canonical_id")
            .join(numbered.select("doc_id", "canonical_id", "number"), ["doc_id", "canonical_id"]))


def superscript_numbers(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Add ``numbered``: markers become numbers, and the block's other citations follow, sorted, after a space."""
    mention = blocks.select("doc_id", "seq", F.posexplode(C.marker_bodies(F.col("text"))).alias("pos", "citation_id"))
    others = F.array_except(C.merge_ids(F.col("citations"), F.lit(None)), C.marker_bodies(F.col("text")))
    extra = blocks.select("doc_id", "seq", F.lit(-1).alias("pos"), F.explode(others).alias("citation_id"))
    looked_up = mention.unionByName(extra).join(numbers.select("doc_id", "citation_id", "number"),
                                                ["doc_id", "citation_id"], "left")
    # Grouped by block: a list is never longer than the markers of one text.
    inline = F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", F.coalesce(
        F.col("number").cast("string"), F.lit("")).alias("n")))))
    tail = F.array_sort(F.collect_list(F.when(F.col("pos") < 0, F.col("number"))))
    per_block = looked_up.groupBy("doc_id", "seq").agg(inline.alias("inline"), tail.alias("tail"))
    pieces = F.split("text", r"\[@[^\]]+\]", -1)
    marks = F.concat(F.transform("inline", lambda s: s["n"]), F.array(F.lit("")))
    woven = F.array_join(F.zip_with(pieces, marks, lambda p, n: F.concat(p, n)), "")
    listed = F.when(F.size("tail") > 0, F.concat(F.lit(" "), F.array_join(F.transform("tail", lambda n: n.cast("string")), ",")))
    return (blocks.join(per_block, ["doc_id", "seq"], "left")
            .withColumn("numbered", F.concat(F.coalesce(woven, F.col("text")), F.coalesce(listed, F.lit(""))))
            .drop("inline", "tail"))


def entries(numbers: DataFrame, details: DataFrame, tracking_url: str | None = None) -> DataFrame:
    """The numbered entries of every document with resolved fields, reference text and bibliography line."""
    first = numbers.select("doc_id", "number", F.col("canonical_id").alias("citation_id")).distinct()
    joined = first.join(details.select("doc_id", "citation_id", F.struct(*DETAIL_FIELDS).alias("d")),
                        ["doc_id", "citation_id"], "left")
    p = C.parse_citation_id(F.col("citation_id"))

    def either(field: str) -> Column:
        parsed = p[field] if field != "experiment_id" else F.lit(None).cast("string")
        return F.coalesce(C.text_or_null(F.col("d")[field]), parsed, F.lit("")).alias(field)

    fields = joined.select("doc_id", "number", "citation_id", F.struct(
        F.col("citation_id").alias("id"), *[either(f) for f in DETAIL_FIELDS]).alias("e"))
    url = F.when(F.col("e.run_id") != "", C.run_url(F.lit(tracking_url).cast("string"), F.col("e.experiment_id"),
                                                    F.col("e.run_id"))).otherwise(F.lit(""))
    fields = fields.withColumn("e", F.col("e").withField("run_url", F.coalesce(url, F.lit(""))))
    return fields.select("doc_id", "number", "citation_id", F.col("e.type").alias("type"), F.col("e.run_url").alias("run_url"),
                         C.reference_text(F.col("e")).alias("text"), C.bibliography_line(F.col("e")).alias("line"))


def traceability(found: DataFrame) -> DataFrame:
    """found(doc_id, section, pos, citation_id): each section's distinct sources with their labels."""
    return (found.groupBy("doc_id", "section", "citation_id").agg(F.min("pos").alias("pos"))
            .withColumn("label", C.trace_label(F.col("citation_id"))))


def parse_references(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Reference lines with a hidden id and a run address -> (doc, citation_id, experiment_id, run_id); last line wins."""
    lines = df.select(doc, F.posexplode(F.split(text, "\r\n|[\n\r]")).alias("line_no", "line"))
    url = r"/#/experiments/([0-9]+)/runs/([A-Fa-f0-9]+)"
    rows = lines.select(doc, "line_no", F.regexp_extract("line", rf"@cite:([^{SPACE}]+)", 1).alias("citation_id"),
                        F.regexp_extract("line", url, 1).alias("experiment_id"),
                        F.regexp_extract("line", url, 2).alias("run_id"))
    rows = rows.filter((F.col("citation_id") != "") & (F.col("run_id") != ""))
    return (rows.groupBy(doc, "citation_id").agg(F.max(F.struct("line_no", "experiment_id", "run_id")).alias("r"))
            .select(doc, "citation_id", "r.experiment_id", "r.run_id"))


def match_keys(text: Column, keys: Sequence[str]) -> Column:
    """The keys that occur in the text as whole words, case ignored, in the given order."""
    low = F.lower(text)
    edge = unicode_regex(r"\b")
    return F.array_compact(F.array(*[F.when(low.rlike(f"{edge}\\Q{k.lower()}\\E{edge}"), F.lit(k)) for k in keys if k]))


def evidence_text(evidence: DataFrame, project: str, order: Sequence[str], limit: int = 20) -> DataFrame:
    """The first evidence rows of each project as prompt lines."""
    window = Window.partitionBy(project).orderBy(*order)
    first = evidence.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= limit)
    snippet = squeeze(F.col("snippet"))
    short = F.when(F.length(snippet) > 180, F.concat(F.substring(snippet, 1, 180), F.lit("..."))).otherwise(snippet)
    where = F.concat(F.col("path"), F.coalesce(F.concat(F.lit("#"), C.text_or_null(F.col("symbol"))), F.lit("")))
    line = F.concat(F.lit("- Statement: "), F.col("statement"), F.lit("\n  Source: "), where, F.lit("\n  Citation ID: [@"),
                    C.code_citation_id(F.col("path"), F.col("symbol")), F.lit("]\n  Snippet: "), short)
    return first.select(project, "position", line.alias("line"))


def citation_details(models: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Lookup (doc_id, citation_id, ...) from models(doc_id, ord, run_id, name, experiment_id, experiment_name, has_keys),
    artifacts(run_id, path) and evidence(doc_id, ord, path, symbol); code beats registry, later rows beat earlier."""
    none = F.lit(None).cast("string")
    exp, name, rid = F.col("experiment_name"), F.col("name"), F.col("run_id")

    def shape(df: DataFrame, rank: int, cid: Column, kind: str, **fields: Column) -> DataFrame:
        values = {f: fields.get(f, none) for f in DETAIL_FIELDS if f != "type"}
        return df.select("doc_id", F.struct(F.lit(rank).alias("rank"), F.col("ord").cast("bigint").alias("ord")).alias("_o"),
                         cid.alias("citation_id"), F.lit(kind).alias("type"), *[v.alias(k) for k, v in values.items()])

    run = dict(run_id=rid, experiment_id=F.col("experiment_id"), experiment_name=exp, run_name=name)
    runs = shape(models.filter("has_keys"), 0, C.run_citation_id(exp, name, rid), "mlflow_summary", **run)
    files = shape(models.join(artifacts.select("run_id", "path"), "run_id"), 0,
                  C.artifact_citation_id(exp, name, F.col("path"), rid), "mlflow_artifact", artifact_path=F.col("path"), **run)
    code = shape(evidence, 1, C.code_citation_id(F.col("path"), F.col("symbol")), "code_file", code_path=F.col("path"),
                 code_symbol=F.col("symbol"))
    rows = runs.unionByName(files).unionByName(code)
    last = F.max_by(F.struct(*DETAIL_FIELDS), F.struct("_o", "artifact_path"))
    # Dealt before they are grouped: rows of one id seldom meet before, and a task would sort for the join and for the ids at once.
    return rows.repartition("doc_id", "citation_id").groupBy("doc_id", "citation_id").agg(last.alias("d")).select("doc_id", "citation_id", "d.*")


FORMS_PER_VALUE = 32  # more than the printed forms of one value


def metric_forms(metrics: DataFrame) -> DataFrame:
    """metrics(scope, ord, citation_id, value) -> every printed form of every value: (scope, form, first, citation_id).

    ``ord`` numbers the metric rows of a scope; ``first`` is a place, ord * FORMS_PER_VALUE + form number, and the citation is that
    of the last row that prints the form.
    """
    v = F.col("value").cast("double")

    def stepped(step, digits: int) -> Column:
        scaled = v * 10 ** digits
        whole = F.when(F.abs(scaled) >= 2.0 ** 53, scaled).otherwise(step(scaled).cast("double"))
        return fixed(whole / 10 ** digits, digits)

    forms = []
    for digits in (2, 3, 4, 5):
        forms += [fixed(v, digits), stepped(F.ceil, digits), stepped(F.floor, digits)]
    share = (v >= 0) & (v <= 1)
    for digits in (1, 2):
        text = fixed(v * 100, digits)
        forms += [F.when(share, F.concat(text, F.lit(s))) for s in ("%", " %", "")]
    finite = metrics.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = finite.select("scope", "ord", "citation_id", F.posexplode(F.array(*forms)).alias("nth", "form")).filter(F.col("form").isNotNull())
    place = F.col("ord").cast("bigint") * FORMS_PER_VALUE + F.col("nth")
    return rows.groupBy("scope", "form").agg(F.min(place).alias("first"), F.max_by("citation_id", place).alias("citation_id"))


#: A decimal number up to its point; what follows can be the decimals of a printed form.
NUMBER = r"-?[0-9]+(?=\.[0-9]{1,5}(?!\p{Nd}))"
LONGEST_HEAD = 310  # no double prints with more integer digits
CITED_APART = 15


def _number_texts(docs: DataFrame, key: str, scope: str, text: str) -> DataFrame:
    """Every text at the end of a decimal number that a form could equal, as in 12.345, -1.20, 9.5% or 9.5 %: (key, scope, form,
    first, past, marked), places counted from 0 in letters; ``marked``: a marker stands behind it already."""
    t = F.col(text)
    heads = F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1))
    after = F.regexp_extract_all(t, F.lit(NUMBER + r"(?=(\.[0-9]+(?s:.{0,6})))"), F.lit(1))  # decimals, per cent, three letters more
    numbered = docs.select(key, scope, F.split(t, NUMBER, -1).alias("gaps"), heads.alias("heads"), after.alias("after"))
    steps = F.zip_with("heads", F.slice("gaps", F.lit(1), F.size("heads")), lambda h, g: (F.length(h) + F.length(g)).cast("bigint"))
    ends = F.aggregate(steps, F.array(F.lit(0).cast("bigint")), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
    tokens = numbered.select(key, scope, F.explode(F.arrays_zip(F.col("heads").alias("head"), F.col("after").alias("after"),
                                                                F.slice(ends, F.lit(2), F.size("heads")).alias("at"))).alias("n"))
    tokens = tokens.select(key, scope, "n.head", "n.at", "n.after", F.regexp_extract("n.after", r"^\.[0-9]+", 0).alias("tail"))
    tokens = tokens.withColumn("rest", F.substring(F.col("after"), F.length("tail") + 1, F.lit(6)))
    percent = F.regexp_extract("rest", r"^ ?%(?!\p{Nd})", 0)
    tokens = tokens.withColumn("end", F.explode(F.array_distinct(F.array(F.lit(""), percent))))
    behind = F.substring(F.col("rest"), F.length("end") + 1, F.lit(3))
    size = F.length("head")
    tokens = tokens.withColumn("marked", behind.startswith("[@") | behind.startswith(" [@")).withColumn(
        "s", F.explode(F.sequence(F.greatest(F.lit(1), size - LONGEST_HEAD), size)))
    form = F.concat(F.substring(F.col("head"), F.col("s"), size), F.col("tail"), F.col("end"))
    return tokens.select(F.col(key).alias("key"), F.col(scope).alias("scope"), form.alias("form"), (F.col("at") - size + F.col("s") - 1).alias("first"),
                         (F.col("at") + F.length("tail") + F.length("end")).alias("past"), "marked")


def _chosen_places(forms: Column) -> Column:
    """Where markers go into one text: array of (place, marker). Forms are taken in their order, the places of each from
    the right. A place is passed over if a marker is behind it, or if it stands, in the text as it is by then, within CITED_APART
    letters of where one was put. A marker inside a number parts it."""
    place = "array<struct<place:bigint,marker:string>>"

    def put(state: Column, hit: Column, marker: Column) -> Column:
        shift = F.aggregate(state["put"], F.lit(0).cast("bigint"),
                            lambda n, p: n + F.when(p["place"] < hit["past"], F.length(p["marker"])).otherwise(0))
        now = hit["past"] + shift
        refused = (hit["marked"] | F.exists(state["put"], lambda p: p["place"] == hit["past"])
                   | F.exists(state["cited"], lambda at: F.abs(now - at) < CITED_APART))
        more = F.struct(F.concat(state["cited"], F.array(now)).alias("cited"),
                        F.concat(state["put"], F.array(F.struct(hit["past"].alias("place"), marker.alias("marker")))).alias("put"))
        return F.when(refused, state).otherwise(more)

    def whole(state: Column, form: Column) -> Column:
        """The form's places in the text as it is: from the left, none inside another, none with a marker inside."""
        left = F.filter(form["places"], lambda h: ~F.exists(state["put"], lambda p: (h["first"] < p["place"]) & (p["place"] < h["past"])))
        apart = F.aggregate(left, F.slice(left, 1, 0), lambda kept, h: F.when(
            (F.size(kept) == 0) | (h["first"] >= F.element_at(kept, -1)["past"]), F.concat(kept, F.array(h))).otherwise(kept))
        return F.reverse(F.when(F.size(left) > 1, apart).otherwise(left))

    start = F.struct(F.array().cast("array<bigint>").alias("cited"), F.array().cast(place).alias("put"))
    return F.aggregate(forms, start, lambda state, form: F.aggregate(
        whole(state, form), state, lambda s, hit: put(s, hit, form["marker"])), lambda state: F.array_sort(state["put"]))


def cite_metric_values(docs: DataFrame, key: str, scope: str, text: str, metrics: DataFrame) -> DataFrame:
    """Add ``cited``: a marker after numbers of the text that print a metric of the text's scope.

    metrics(scope, ord, citation_id, value), ``ord`` unique in its scope; a form's citation is the one of its last row. Longer
    forms are cited first, then those of earlier rows. Which forms occur in which text, and where, is an equality join;
    the choice among them is a fold over each text's own places. Markers are never put inside markers. Texts of one
    key must be one row; a null text stays null. Forms and chosen places are many times the rows they come from, which Spark's
    estimates miss, so both joins are merges and nothing is broadcast.
    """
    hits = _number_texts(docs, key, scope, text).join(
        metric_forms(metrics).withColumnRenamed("first", "row").hint("merge"), ["scope", "form"]).repartition("key")
    per_form = hits.groupBy("key", "form", "row", "citation_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "past", "marked"))).alias("places"))
    form = F.struct((-F.length("form")).alias("size"), "row", F.concat(F.lit("[@"), "citation_id", F.lit("]")).alias("marker"), "places")
    per_doc = per_form.groupBy("key").agg(F.array_sort(F.collect_list(form)).alias("forms"))
    put = per_doc.select(F.col("key").alias("_key"), _chosen_places(F.col("forms")).alias("_put"))
    joined = docs.join(put.hint("merge"), F.col(key) == F.col("_key"), "left")
    n = F.size("_put")
    begin = lambda i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.try_element_at("_put", i)["place"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(
        F.when(i == 0, F.lit("")).otherwise(F.try_element_at("_put", i)["marker"]),
        F.substring(F.col(text), (begin(i) + 1).cast("int"),
                    F.coalesce(F.try_element_at("_put", i + 1)["place"] - begin(i), F.length(text)).cast("int"))))
    return joined.withColumn("cited", F.when(n > 0, F.array_join(pieces, "")).otherwise(F.col(text))).drop("_key", "_put")
