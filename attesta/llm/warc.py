"""WARC archives as chunked record tables.

A payload of any length is a run of rows (record, chunk number, bytes). The writer streams these rows: a record longer than
one chunk becomes a segmented record (``WARC-Segment-Number`` and ``continuation`` records), each segment a gzip member of
its own. The reader streams them back as rows again, with the digest of each record so far. Neither side holds more than
one chunk of a record. Archives are written below the shared folder under names of their own attempt; only attempts that
ended well are in the manifest, which is a table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from attesta.llm.scratch import materialise, scratch_path

CHUNK_BYTES = 1 << 18
ROLL_BYTES = 1 << 30
EPOCH = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records long"
CHUNKS = ("id long, copy long, chunk_no long, data binary, bytes_so_far long, digest_so_far string, last boolean, "
          "record_type string, refers_to long, payload_bytes long, payload_digest string")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def plan_records(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """What each record becomes: (id, copy, sha1, bytes, record_type, refers_to). Of records with equal payloads of
    ``least_bytes`` or more, that with the largest id is the response; repeated rows of it are revisits as well."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = (pages.select(F.col(key).cast("long").alias("id"), F.sha1(body).alias("sha1"), F.length(body).cast("long").alias("bytes"))
            .groupBy("id", "sha1", "bytes").agg(F.count("*").alias("n")))
    largest = rows.groupBy("sha1", "bytes").agg(F.max("id").alias("response"))
    every = rows.join(largest, ["sha1", "bytes"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    is_response = (F.col("bytes") < least_bytes) | (F.col("id").eqNullSafe(F.col("response")) & (F.col("copy") == 0))
    return every.select("id", "copy", "sha1", "bytes", F.when(is_response, "response").otherwise("revisit").alias("record_type"),
                        F.when(~is_response, F.col("response")).alias("refers_to"))


def chunk_rows(pages: DataFrame, records: DataFrame, key: str, payload: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: a row per chunk of each response, in order within a partition; one row per revisit. Payloads
    are cut before they travel, of rows that occur twice one brings its chunks, and only records of more than one chunk are
    gathered once more."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))

    def places(size):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((size - 1) / chunk_bytes))))

    named = [F.coalesce(F.col("id"), F.lit(0)).alias("k"), F.col("id").isNull().alias("unnamed"), F.col("sha1").alias("h")]
    on = ["k", "unnamed", "h", "chunk_no"]
    chunk = F.substring("body", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    pieces = (pages.select(F.col(key).cast("long").alias("id"), F.sha1(body).alias("sha1"), body.alias("body"))
              .select(*named, "body", places(F.length("body").cast("long")).alias("chunk_no"))
              .select(*on, chunk.alias("data")).groupBy(*on).agg(F.first("data").alias("data")))
    columns = ["id", "copy", "sha1", "bytes", "record_type", "refers_to"]
    responses = records.filter("record_type = 'response'").select(*columns, *named, places(F.col("bytes")).alias("chunk_no"))
    stored = responses.join(pieces, on).select(*columns, "chunk_no", "data")
    revisits = records.filter("record_type = 'revisit'").select(
        *columns, F.lit(0).cast("long").alias("chunk_no"), F.lit(None).cast("binary").alias("data"))
    long = stored.filter(F.col("bytes") > chunk_bytes).repartition("id", "sha1").sortWithinPartitions("id", "sha1", "chunk_no")
    return stored.filter(F.col("bytes") <= chunk_bytes).unionByName(revisits).unionByName(long)


def _uri(number, copy) -> str:
    return f"<urn:record:{'' if number is None else number}:{copy}>"


def _header(kind: str, record: dict, chunk_no: int, chunks: int, length: int) -> bytes:
    digest = base32(record["sha1"])
    own = _uri(record["id"], record["copy"])
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {EPOCH}", "Content-Type: text/html; charset=utf-8",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {record['bytes']}"]
    if kind == "continuation":
        lines += [f"WARC-Record-ID: {own[:-1]}:{chunk_no}>", f"WARC-Segment-Origin-ID: {own}"]
    else:
        lines.append(f"WARC-Record-ID: {own}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_uri(record['refers_to'], 0)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    if chunks > 1:
        lines.append(f"WARC-Segment-Number: {chunk_no + 1}")
        if chunk_no == chunks - 1:
            lines.append(f"WARC-Segment-Total-Length: {record['bytes']}")
    lines.append(f"Content-Length: {length}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _write(folder: str, chunk_bytes: int, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        out, path, count, digest = None, "", 0, None

        def manifest():
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{path}", "records": count}],
                                              schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: a chunk is all that is in Python's memory
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                data = row["data"] or b""
                chunks = max(1, -(-row["bytes"] // chunk_bytes)) if row["record_type"] == "response" else 1
                if row["chunk_no"] == 0 and out is not None and out.tell() >= roll_bytes:
                    yield manifest()
                    out = None
                if out is None:
                    path, count = f"{uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{path}", compression=None)
                kind = row["record_type"] if row["chunk_no"] == 0 else "continuation"
                if row["record_type"] == "response":
                    digest = hashlib.sha1() if row["chunk_no"] == 0 else digest
                    digest.update(data)
                    if row["chunk_no"] == chunks - 1 and digest.hexdigest() != row["sha1"]:
                        raise ValueError(f"record {row['id']}: chunks do not make up its payload")
                out.write(gzip.compress(_header(kind, row, row["chunk_no"], chunks, len(data)) + data + b"\r\n\r\n", 1, mtime=0))
                count += row["chunk_no"] == 0
        if out is not None:
            yield manifest()
    return run


def write_archives(chunks: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the chunk rows to ``folder`` and return the manifest (path, records), a table."""
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top)
    return materialise(chunks.mapInArrow(_write(folder, chunk_bytes, roll_bytes), MANIFEST), "manifest")


def _number(uri: str) -> tuple[int | None, int]:
    first, second = uri.strip("<>").removeprefix("urn:record:").split(":")[:2]
    return (int(first) if first else None), int(second)


def _read(with_data: bool, chunk_bytes: int):
    schema = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()),
                        ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string())])

    def records(path: str):
        store, name = fs.FileSystem.from_uri(path)
        state: dict = {}
        with store.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            while line := stream.readline():
                if line.strip() != b"WARC/1.1":
                    raise ValueError(f"{path}: no record where one should begin")
                head = {}
                while (line := stream.readline()) not in (b"\r\n", b""):
                    name_, _, value = line.decode().partition(":")
                    head[name_.lower()] = value.strip()
                kind, left = head["warc-type"], int(head["content-length"])
                if kind != "continuation":
                    number, copy = _number(head["warc-record-id"])
                    refers = _number(head["warc-refers-to"])[0] if "warc-refers-to" in head else None
                    state = {"id": number, "copy": copy, "record_type": kind, "refers_to": refers, "no": 0, "sha1": hashlib.sha1(), "n": 0}
                ends = "warc-segment-number" not in head or "warc-segment-total-length" in head
                while True:
                    data = stream.read(min(left, chunk_bytes))
                    if left and not data:
                        raise ValueError(f"{path}: a record is cut short")
                    left -= len(data)
                    state["sha1"].update(data)
                    state["n"] += len(data)
                    last = ends and not left
                    so_far = base64.b32encode(state["sha1"].digest()).decode()
                    declared = head["warc-payload-digest"].removeprefix("sha1:")
                    if last and kind != "revisit" and (so_far != declared or state["n"] != int(head["x-payload-length"])):
                        raise ValueError(f"{path}: record {state['id']} does not have its digest")
                    yield {"id": state["id"], "copy": state["copy"], "chunk_no": state["no"], "data": data if with_data else None,
                           "bytes_so_far": state["n"], "digest_so_far": so_far, "last": last, "record_type": state["record_type"],
                           "refers_to": state["refers_to"], "payload_bytes": int(head["x-payload-length"]), "payload_digest": declared}
                    state["no"] += 1
                    if not left:
                        break
                stream.readline()
                stream.readline()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in records(path):
                    rows.append(row)
                    held += len(row["data"] or b"")
                    if len(rows) >= 4096 or held >= 8 * chunk_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def read_archives(manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives: (id, copy, chunk_no, data, bytes_so_far, digest_so_far, last, record_type,
    refers_to, payload_bytes, payload_digest). A payload that does not have its declared digest is an error."""
    archives = manifest.count()  # a task each: as one row each, they would be merged into few
    return manifest.select("path").repartition(max(1, archives)).mapInArrow(_read(with_data, chunk_bytes), CHUNKS)


def archive_round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", least_bytes: int = 0,
                       chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record per row, read the archives back, and return per row: its id, ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to``. A null payload is empty. Rows without an id are records without one; they are a
    response only where no equal payload has an id."""
    folder = scratch_path(pages.sparkSession, "warc")
    records = materialise(plan_records(pages, key, payload, least_bytes), "records")
    manifest = write_archives(chunk_rows(pages, records, key, payload, chunk_bytes), folder, chunk_bytes)
    return read_archives(manifest, with_data=False, chunk_bytes=chunk_bytes).filter("last").select(
        F.col("id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to")
