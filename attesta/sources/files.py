"""File trees as DataFrames: scanning, artifact parsing, listings, upload names, readme choice."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta import rules
from attesta.functions.numbers import round_binary
from attesta.functions.text import base64_text, clip
from attesta.operators.corpus import has_extension


def utf8_text(content: Column) -> Column:
    """Bytes as text; bytes that are no UTF-8 are dropped."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")))


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``, whatever scheme prefix the file system adds."""
    bare = root.split("://")[-1].removeprefix("file:").rstrip("/")
    return F.regexp_replace(path, r"^.*?\Q" + bare + r"\E/+", "")


#: Levels of folders whose entries are dealt over tasks; deeper ones are walked by the task that found them.
LISTED_APART = 3
#: Rows of a listing and bytes of content that a task hands on at once.
LISTED_AT_ONCE, READ_AT_ONCE = 10_000, 8 << 20


def _passed_over(name: str) -> bool:
    """Names that Spark's readers do not list."""
    return (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
            and not name.startswith(("_metadata", "_common_metadata")))


def _list_folders(root: str, deep: bool):
    """Rows (path, size) of files as they come; a row without a size is a folder, its entries take its place."""
    def run(batches):
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            folders = [p for p, s in zip(paths, sizes) if s is None]
            kept = batch.filter(batch.column(1).is_valid())
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["path", "size"])
            while folders:
                folder = folders.pop()
                found = [e for e in store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"))) if not _passed_over(e.base_name)]
                for at in range(0, len(found), LISTED_AT_ONCE):
                    some = [(f"{folder}/{e.base_name}".lstrip("/"), e.type == fs.FileType.Directory, e.size) for e in found[at:at + LISTED_AT_ONCE]]
                    if deep:
                        folders += [path for path, is_folder, _ in some if is_folder]
                        some = [row for row in some if not row[1]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.string()),
                                                      pa.array([None if r[1] else r[2] for r in some], pa.int64())], names=["path", "size"])
    return run


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file below ``root``: tasks list the folders, so that no list of all files is in the driver."""
    rows = spark.range(1, numPartitions=1).select(F.lit("").alias("path"), F.lit(None).cast("bigint").alias("size"))
    for level in range(LISTED_APART):
        rows = rows.mapInArrow(_list_folders(root, level == LISTED_APART - 1), "path string, size long").repartition("path")
    return rows


def _read_files(root: str):
    def run(batches):
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths, contents, start = batch.column(0).to_pylist(), [], 0
            held = 0
            for at, path in enumerate(paths):
                with store.open_input_stream(f"{top}/{path}", compression=None) as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= READ_AT_ONCE or at + 1 == len(paths):
                    part = batch.slice(start, len(contents))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(contents, pa.binary())], names=["path", "size", "content"])
                    contents, start, held = [], at + 1, 0
    return run


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """(path, size, content bytes) of every file below ``root``. Tasks list and read it; for file systems that only Spark knows,
    Spark's reader does, which lists the files in the driver."""
    try:
        fs.FileSystem.from_uri(root)
    except pa.ArrowInvalid:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        files = files.select(relative_path(F.col("path"), root).alias("path"), F.col("length").alias("size"), "content")
        return files if extensions is None else files.filter(has_extension(F.col("path"), extensions))
    files = list_files(spark, root)
    files = files if extensions is None else files.filter(has_extension(F.col("path"), extensions))
    return files.mapInArrow(_read_files(root), "path string, size long, content binary")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write files(path, content) below ``root``, a file per row, and return (path, size) as written. A path written twice,
    by a repeated task, say, is replaced; content is text (as UTF-8) or bytes, null is an empty file."""
    def write(batches):
        store, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{top}/{path}".rsplit("/", 1)[0])
                with store.open_output_stream(f"{top}/{path}", compression=None) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(write, "path string, size long")


def scan_source_files(spark: SparkSession, root: str, language: str) -> DataFrame:
    """The language's files below ``root`` by their exact extensions."""
    return scan_files(spark, root, rules.LANGUAGES[language.lower()]["extensions"])


# --- fixed values: cell texts that mean "no value" in a CSV table
NO_VALUE = frozenset(["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                      "NULL", "NaN", "None", "n/a", "nan", "null"])


def _table_rows(text: str | None) -> dict | None:
    """Records of one CSV text. Blank lines are skipped, short rows padded, repeated names numbered; a text without a
    header, with a row longer than it or with an open quote is no table."""
    if text is None:
        return None
    failed = {"records": None, "failed": True}
    try:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), strict=True) if r]
    except csv.Error:
        return failed
    if not rows or any(len(r) > len(rows[0]) for r in rows):
        return failed
    header: list[str] = []
    for i, name in enumerate(rows[0]):
        name, n = name or f"Unnamed: {i}", 0
        while (full := f"{name}.{n}" if n else name) in header:
            n += 1
        header.append(full)
    return {"records": [{h: None if i >= len(r) or r[i] in NO_VALUE else r[i] for i, h in enumerate(header)} for r in rows[1:]],
            "failed": False}


def table_rows(text: Column) -> Column:
    """A struct of the records of a CSV text and whether it failed to parse."""
    @F.pandas_udf("struct<records:array<map<string,string>>,failed:boolean>")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_table_rows(t) or {"records": None, "failed": None} for t in texts], columns=["records", "failed"])

    return parse(text)


def parse_artifacts(artifacts: DataFrame) -> DataFrame:
    """(path, content bytes) + kind, text, records, parse_failed, image_format, image_base64; other kinds of files are
    skipped and unreadable ones (null content) too. A CSV file that is no table has no records and is flagged."""
    path, text = F.col("path"), utf8_text(F.col("content"))
    image = has_extension(path, [".png", ".jpg", ".jpeg"])
    kind = (F.when(F.endswith(path, F.lit(".csv")), "csv").when(F.endswith(path, F.lit(".txt")), "text")
            .when(image, "image"))
    kept = artifacts.withColumn("kind", kind).filter(F.col("kind").isNotNull() & F.col("content").isNotNull())
    return (kept.withColumn("_table", table_rows(F.when(F.col("kind") == "csv", text))).withColumns({
                "text": F.when(F.col("kind") == "text", text),
                "records": F.col("_table.records"), "parse_failed": F.coalesce("_table.failed", F.lit(False)),
                "image_format": F.when(F.col("kind") == "image", F.lower(F.substring_index(path, ".", -1))),
                "image_base64": F.when(F.col("kind") == "image", base64_text(F.col("content")))}).drop("_table"))


def list_artifacts(tree: DataFrame) -> DataFrame:
    return tree.filter(~F.col("is_dir")).select("run_id", "path")


def list_dataset_files(listing: DataFrame, folder: str = "", only_specs: bool = True) -> DataFrame:
    """listing(file_name, label, is_directory, size, name_size, last_modified): names without the folder prefix;
    directories and YAML files only, unless ``only_specs`` is off."""
    name = F.coalesce(F.nullif("file_name", F.lit("")), "label", F.lit(""))
    if folder:
        prefix = folder.rstrip("/") + "/"
        name = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)
    is_dir = F.coalesce("is_directory", F.lit(False))
    out = listing.select(name.alias("file_name"), is_dir.alias("is_directory"), F.coalesce(
        F.nullif("size", F.lit(0)), "name_size", F.lit(0)).alias("size_in_bytes"), "last_modified")
    low = F.lower("file_name")
    return out.filter(F.col("is_directory") | F.endswith(low, F.lit(".yaml")) | F.endswith(low, F.lit(".yml"))) if only_specs else out


def list_specs(files: DataFrame, folder: str) -> DataFrame:
    """files(file_name, is_directory, size_in_bytes, last_modified) -> name, path, size in KB, created_at."""
    size = round_binary(F.coalesce("size_in_bytes", F.lit(0)) / 1024, 1)
    return files.filter(~F.coalesce("is_directory", F.lit(False))).select(
        F.col("file_name").alias("name"), F.concat(F.lit(folder + "/"), F.col("file_name")).alias("path"),
        size.alias("size_kb"), F.coalesce("last_modified", F.lit("")).alias("created_at"))


def safe_spec_path(name: Column, folder: str, unique: Column | None = None) -> Column:
    """Upload path: the bare file name behind a unique prefix, any folders in the name removed."""
    bare = F.regexp_extract(name, r"([^/\\]*)$", 1)
    return F.concat(F.lit(folder + "/"), unique if unique is not None else F.uuid(), F.lit("_"), bare)


def pick_readme(files: DataFrame) -> DataFrame:
    """files(project, path, content) -> each project's first readme by name priority, cut to the limit."""
    place = F.array_position(F.array(*[F.lit(n) for n in rules.README_NAMES]), F.col("path"))
    found = files.withColumn("_place", place).filter((F.col("_place") > 0) & F.col("content").isNotNull())
    return (found.groupBy("project").agg(F.min_by("content", "_place").alias("readme"))
            .withColumn("readme", clip(F.col("readme"), rules.README_LIMIT, rules.TRUNCATED_SUFFIX)))
