"""CSV tables, registry exports, result caches, notebooks and paged listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from attesta import rules, schemas
from attesta.functions.text import base64_text


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """A CSV table with a header. ``multiline`` allows line breaks in cells, at the price of unsplit files."""
    return (spark.read.schema(schema).option("header", "true").option("escape", '"').option("multiLine", str(multiline).lower())
            .csv(path))


def write_csv_table(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("escape", '"').csv(path)


def read_registry_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Exports of a tracking store: one folder per table."""
    return {name: spark.read.schema(schema).format(fmt).load(f"{root}/{name}") for name, schema in schemas.REGISTRY.items()}


def write_registry_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.REGISTRY[name].fields]).write.format(fmt).save(
            f"{root}/{name}")


def content_value(text: Column, items: Column, table_json: Column, raw: Column) -> Column:
    """One open-typed value: text, list, table or base64 bytes."""
    return F.coalesce(text.cast("variant"), items.cast("variant"), F.try_parse_json(table_json), base64_text(raw).cast("variant"))


def save_results_cache(results: DataFrame, path: str) -> None:
    """(spec, results) rows as JSON lines; bytes in contents are base64 text tagged with their encoding."""
    results.select("spec", "results").write.option("ignoreNullFields", "false").json(path)


def load_results_cache(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Cached results with optional fields filled in; contents gain ``bytes`` where tagged as base64. A missing cache
    is an error, as is an unknown block type."""
    raw = spark.read.schema(schemas.CACHE).option("multiLine", str(multiline).lower()).json(path)

    def checked(kind: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit("unknown block type: "), F.coalesce(kind, F.lit("null"))))
        return F.when(kind.isin(*rules.BLOCK_TYPES), kind).otherwise(bad.cast("string"))

    def content(c: Column) -> Column:
        return F.struct(checked(c["block_type"]).alias("block_type"), c["content"].alias("content"),
                        F.when(c["content_encoding"] == "base64", F.unbase64(F.try_variant_get(c["content"], "$", "string"))).alias("bytes"),
                        F.coalesce(c["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"))

    def block(b: Column) -> Column:
        return F.struct(checked(b["type"]).alias("type"), b["purpose"].alias("purpose"),
                        F.coalesce(b["data_needed"], F.lit("")).alias("data_needed"),
                        F.coalesce(b["specifics"], F.create_map().cast("map<string,string>")).alias("specifics"),
                        F.coalesce(b["priority"], F.lit("required")).alias("priority"))

    def plan(p: Column) -> Column:
        blocks = F.coalesce(p["content_blocks"], F.array().cast(schemas.PLAN["content_blocks"].dataType))
        return F.struct(p["number"].alias("number"), p["name"].alias("name"), p["title"].alias("title"),
                        p["model_name"].alias("model_name"), F.transform(blocks, block).alias("content_blocks"))

    spec = F.col("spec")
    spec = spec.withField("hints", F.coalesce(spec["hints"], F.create_map().cast("map<string,string>"))) \
        .withField("citation_style", F.coalesce(spec["citation_style"], F.lit("numeric"))) \
        .withField("formatting", F.coalesce(spec["formatting"], F.create_map().cast("map<string,string>")))
    results = F.transform("results", lambda r: F.struct(
        plan(r["plan"]).alias("plan"), F.transform(r["contents"], content).alias("contents"),
        F.coalesce(r["errors"], F.array().cast("array<string>")).alias("errors")))
    return raw.select(spec.alias("spec"), results.alias("results"))


def cell_source(source: Column) -> Column:
    """A notebook cell's text, stored as one string or as a list of lines."""
    lines = F.try_variant_get(source, "$", "array<string>")
    return F.coalesce(F.array_join(lines, ""), F.try_variant_get(source, "$", "string"), F.lit(""))


def read_notebooks(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Notebook files as cells in order: (notebook, cell_no, cell_type, source)."""
    raw = spark.read.schema(schemas.NOTEBOOK).option("multiLine", str(multiline).lower()).json(path)
    return (raw.select(F.input_file_name().alias("notebook"), F.posexplode("cells").alias("cell_no", "c"))
            .select("notebook", "cell_no", "c.cell_type", cell_source(F.col("c.source")).alias("source")))


def paged_listing(pages: DataFrame, page_size: int = 50) -> DataFrame:
    """pages(listing, page_no, body JSON) -> one row per record; pages after the first short page are not read."""
    page = F.from_json("body", schemas.LISTING_PAGE)
    items = F.when(F.size(page["datasets"]) > 0, page["datasets"]).otherwise(page["items"])
    parsed = pages.select("listing", "page_no", F.coalesce(items, F.array().cast(
        schemas.LISTING_PAGE["items"].dataType)).alias("items"))
    last = parsed.filter(F.size("items") < page_size).groupBy("listing").agg(F.min("page_no").alias("last_page"))
    read = parsed.join(last, "listing", "left").filter(F.coalesce(F.col("page_no") <= F.col("last_page"), F.lit(True)))
    rows = read.select("listing", "page_no", F.posexplode("items").alias("pos", "item"))

    def field(*names: str) -> Column:
        wrapped = F.coalesce(*[F.nullif(F.col("item.dataset")[n], F.lit("")) for n in names], F.lit(""))
        flat = F.coalesce(*[F.nullif(F.col("item")[n], F.lit("")) for n in names], F.lit(""))
        return F.when(F.col("item.dataset").isNotNull(), wrapped).otherwise(flat)

    snapshot = F.when(F.col("item.dataset").isNotNull(), F.try_element_at("item.dataset.snapshotIds", F.lit(1))).otherwise(
        F.try_element_at("item.snapshotIds", F.lit(1)))
    return rows.select("listing", "page_no", "pos", field("datasetId", "id").alias("id"),
                       field("datasetName", "name").alias("name"), field("description").alias("description"),
                       F.coalesce(F.nullif(field("readWriteSnapshotId"), F.lit("")), snapshot).alias("snapshot_id"))
