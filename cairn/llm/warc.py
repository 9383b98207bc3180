"""WARC archives as a Python data source.

Reading plans one task for each group of whole files, small files together. Filters on record_type, page_id and header columns
that Spark hands over are tested on the headers alone; the payload of a record that fails them, or whose payload isn't asked for
(option payload=false), is skipped in the file without being decoded. Archives ending in .gz hold one gzip member a record.

Writing makes files of at most ROLL bytes or one record, each under its task's own name, moved to `archive` by the commit's
manifest: files that a lost task left are not listed and not read.

Records whose payloads are equal and at least `least` bytes long are deduplicated: the one with the largest page_id is written as
response, the others as revisits that refer to it and carry no payload.

Defined cases
    null html       an empty payload
    null page_id    smallest of all; a record without page id, and refers_to is null where it points to one
    repeated rows   one record each; of equal largest page_ids one row is the response
    null url        a record without target URI
    very long html  one record, written and read alone; skipped without being read in plain archives
    empty table     a manifest without files; no rows
    extra columns   not written
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from cairn.llm import workspace as ws

MANIFEST = "_manifest.json"
#: A file is closed after so many bytes.
ROLL = 256 << 20
#: Small files are read together up to so many bytes a task.
TASK_BYTES = 64 << 20
#: What is read at a time where payloads are skipped.
SKIPPING = 64 << 10
#: Payloads of at least this many bytes are deduplicated.
LEAST_BYTES = 0
BUFFER = 4 << 20
#: Parts that equal rows are dealt to.
SALTS = 64
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"

_SCHEMA = "record_id string, record_type string, target_uri string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to bigint, content_length bigint, payload binary"
_KINDS = (("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("content_length", pa.int64()), ("payload", pa.binary()))


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = _HTTP % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {kind}')}>",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {''.join(url.split())}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []),
        f"X-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(file) -> dict[str, str] | None:
    """The named fields of the next record, or None at the end; the block follows."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := file.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC record ends within its header")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _row(found: dict[str, str]) -> dict:
    number = lambda name: int(found[name]) if name in found else None
    length = int(found.get("content-length", 0))
    return {
        "record_id": found.get("warc-record-id"), "record_type": found.get("warc-type"), "target_uri": found.get("warc-target-uri"), "page_id": number("x-page-id"), "payload_bytes": number("x-payload-length"),
        "payload_digest": found.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number("x-refers-to-page-id"), "content_length": length,
    }


#: Filters on header columns that are tested before a block is touched.
_TESTS = {
    EqualTo: lambda f, v: v is not None and v == f.value,
    In: lambda f, v: v is not None and v in f.value,
    IsNull: lambda f, v: v is None,
    IsNotNull: lambda f, v: v is not None,
    GreaterThan: lambda f, v: v is not None and v > f.value,
    GreaterThanOrEqual: lambda f, v: v is not None and v >= f.value,
    LessThan: lambda f, v: v is not None and v < f.value,
    LessThanOrEqual: lambda f, v: v is not None and v <= f.value,
    StringStartsWith: lambda f, v: v is not None and v.startswith(f.value),
    StringEndsWith: lambda f, v: v is not None and v.endswith(f.value),
    StringContains: lambda f, v: v is not None and f.value in v,
}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        store, folder = _open(self.path)
        listed = f"{folder}/{MANIFEST}"
        if store.get_file_info(listed).type == fs.FileType.File:
            with store.open_input_stream(listed) as file:
                files = [(f"{folder}/{f['name']}", f["bytes"]) for f in json.loads(file.read())["files"]]
        else:  # archives of others
            infos = store.get_file_info(fs.FileSelector(folder, recursive=True)) if store.get_file_info(folder).type == fs.FileType.Directory else [store.get_file_info(folder)]
            files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz")))
        groups, held = [[]], 0
        for name, size in files:
            if groups[-1] and held + size > TASK_BYTES:
                groups, held = [*groups, []], 0
            groups[-1].append(name)
            held += size
        return [Files(g) for g in groups]

    def read(self, partition):
        store, _ = _open(self.path)
        rows, held = [], 0
        for name in partition.names:
            with store.open_input_file(name) as raw:  # blocks of plain files are sought past, not read
                for row in self._records(io.BufferedReader(gzip.GzipFile(fileobj=raw), BUFFER) if name.endswith(".gz") else io.BufferedReader(raw, SKIPPING if not self.payload else BUFFER)):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > ws_batch or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, file) -> Iterator[dict]:
        while (found := headers(file)) is not None:
            row = _row(found)
            length = row["content_length"]
            if not all(_TESTS[type(f)](f, row.get(f.attribute[0])) for f in self.filters) or not self.payload:
                file.seek(length, io.SEEK_CUR)  # the block is passed over: never held whole, never decoded
                if not self.payload and all(_TESTS[type(f)](f, row.get(f.attribute[0])) for f in self.filters):
                    yield row | {"payload": None}
                continue
            block = file.read(length)
            payload = None if row["record_type"] == "revisit" else block[block.find(b"\r\n\r\n") + 4 :] if found.get("content-type", "").startswith("application/http") else block
            yield row | {"payload": payload}


ws_batch = 16 << 20


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in _KINDS], names=[n for n, _ in _KINDS])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, html, record_type, refers_to)."""

    def __init__(self, path: str, compressed: bool):
        self.path, self.compressed = path, compressed

    def write(self, iterator) -> WriterCommitMessage:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        files, out = [], None
        for batch in iterator:
            for page_id, url, html, kind, refers_to in zip(*(batch.column(n) for n in ("page_id", "url", "html", "record_type", "refers_to"))):
                made = record(kind.as_py(), page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())
                if self.compressed:
                    made = gzip.compress(made, 6, mtime=0)
                if out is None or files[-1][1] + len(made) > ROLL:
                    if out:
                        out.close()
                    files.append([f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc{'.gz' * self.compressed}", 0, 0])
                    out = store.open_output_stream(f"{folder}/{files[-1][0]}", compression=None, buffer_size=BUFFER)
                out.write(made)
                files[-1][1] += len(made)
                files[-1][2] += 1
        if out:
            out.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages) -> None:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"files": [{"name": n, "bytes": b, "records": r} for m in messages if m for n, b, r in m.files]}).encode())

    def abort(self, messages) -> None:
        store, folder = _open(self.path)
        for m in messages:
            for name, *_ in m.files if m else ():
                store.delete_file(f"{folder}/{name}")


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("compressed", "false").lower() == "true")


def with_roles(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, record_type, refers_to.

    Digests alone are grouped (each task sends one row a digest), and only digests that occur more than once are joined back;
    both sides are staged or scanned right before their shuffles, so Spark splits the partition of a digest that many pages have.
    """
    p = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(p) >= least, F.sha1(p)).alias("digest"))
    by_id = marked.where("digest is not null").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    copies = by_id.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("n")).where("n > 1")
    copies, _ = ws.stage(copies.select(F.col("digest").alias("of"), F.col("last.page_id").alias("to"), (F.col("last.n") > 1).alias("tied")), "warc-copies")
    joined = marked.join(copies, F.col("digest") == F.col("of"), "left")
    last = F.col("page_id").eqNullSafe(F.col("to"))
    # rows that share the largest page_id of a payload are equal but for their URL, so they are counted within tasks, in SALTS parts,
    # and each part writes as many as it counted; the first of the part that comes first is the response
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    groups, _ = ws.stage(joined.where(F.col("tied") & last).groupBy("digest", "page_id", "url", "to", salt).agg(F.first("html").alias("html"), F.count(F.lit(1)).cast("int").alias("n")), "warc-tied")
    lead = groups.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url", "salt")).alias("lead"))
    tied = groups.join(lead, "digest").withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
    tied = tied.withColumn("revisit", ~((F.col("k") == 1) & F.col("url").eqNullSafe(F.col("lead.url")) & (F.col("salt") == F.col("lead.salt"))))
    rest = joined.where(F.col("of").isNull() | ~(F.col("tied") & last)).withColumn("revisit", F.col("of").isNotNull() & ~last)
    columns = ["page_id", "url", "html", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("to")).alias("refers_to")]
    return rest.select(*columns).unionByName(tied.select(*columns))


def write_warc(pages: DataFrame, path: str, least: int = LEAST_BYTES, compressed: bool = False) -> None:
    pages.sparkSession.dataSource.register(Warc)
    with_roles(pages, least).write.format("cairn_warc").option("compressed", str(compressed).lower()).mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("cairn_warc").option("payload", str(payload).lower()).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives' headers."""
    path = ws.new_path(spark, "warc")
    write_warc(ws.table(spark, sf_dir, "pages"), path)
    found = read_warc(spark, path, payload=False).where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
