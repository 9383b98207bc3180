"""Token ids in length-delimited binary record files, with an offset index for shuffled reads.

A `.rec` file is a row of frames, all numbers little-endian:
    8 bytes   length n of the payload
    4 bytes   masked CRC-32 of those 8 bytes
    n bytes   payload: 1 byte flag (1: the document has an id), 8 bytes doc_id, 1 byte width w, then ids of w bytes each
    4 bytes   masked CRC-32 of the payload
The mask turns a checksum right by 15 bits and adds 0xa282ead8, so that a checksum of data that holds checksums stays telling.
Beside it, an `.idx` file holds 16 bytes for each frame: its offset and its number of ids. `_manifest.json`, written last,
lists the files in order with their numbers of records and ids: what it doesn't list was left by a lost task and is not read.

Files are made by a Python data source: each task writes one file under its own name, and the commit on the driver gets one
message a task.

Defined cases
    null or empty text   only the end id
    null doc_id          comes first, null again when read
    repeated rows        all written; equal ids are ordered by their text's hash
    empty table          a manifest without files; no rows
    extra columns        not written
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cairn.llm import tokens
from cairn.llm import workspace as ws

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
MANIFEST = "_manifest.json"
#: Read and written at a time.
BUFFER = 8 << 20
BATCH_BYTES = 16 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(file, name: str = "") -> tuple[int | None, int, bytes] | None:
    """doc_id, width and ids of the next frame, or None at the end. A damaged frame raises."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
        raise ValueError(f"damaged length in {name}")
    body = file.read(struct.unpack_from("<Q", head)[0] + 4)
    payload = body[:-4]
    if len(body) != struct.unpack_from("<Q", head)[0] + 4 or struct.unpack_from("<I", body, len(payload))[0] != masked(payload):
        raise ValueError(f"damaged payload in {name}")
    known, doc_id, width = struct.unpack_from("<BqB", payload)
    return (doc_id if known else None), width, payload[10:]


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Written(WriterCommitMessage):
    def __init__(self, part: int, name: str, records: int, ids: int):
        self.part, self.name, self.records, self.ids = part, name, records, ids


class RecordWriter(DataSourceArrowWriter):
    """Rows (doc_id, ids, width), in the order in which the task gets them; with a tokenizer, rows (doc_id, text), whose ids and end
    id are made in the process that writes them."""

    def __init__(self, path: str, tokenizer: str | None = None, end_id: int = END_ID):
        self.path, self.tokenizer, self.end_id, self.job = path, tokenizer, end_id, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = open_folder(self.path)
        store.create_dir(folder, recursive=True)
        part, name = TaskContext.get().partitionId(), None
        out = index = None
        records = total = at = 0
        for batch in encoded(iterator, self.tokenizer, self.end_id, self.job) if self.tokenizer else iterator:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
                out, index = store.open_output_stream(f"{folder}/{name}.rec", buffer_size=BUFFER), store.open_output_stream(f"{folder}/{name}.idx", buffer_size=1 << 16)
            for doc_id, ids, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width").to_pylist()):
                ids = ids.as_buffer().to_pybytes()
                framed = frame(doc_id, ids, width)
                out.write(framed)
                index.write(struct.pack("<QQ", at, n := len(ids) // width))
                at, records, total = at + len(framed), records + 1, total + n
        for file in (out, index):
            if file:
                file.close()
        return Written(part, name or "", records, total)

    def commit(self, messages) -> None:
        store, folder = open_folder(self.path)
        files = [{"name": m.name, "records": m.records, "ids": m.ids} for m in sorted((m for m in messages if m and m.records), key=lambda m: m.part)]
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages) -> None:
        store, folder = open_folder(self.path)
        for m in messages:
            for end in ("rec", "idx") if m and m.name else ():
                store.delete_file(f"{folder}/{m.name}.{end}")


class OneFile(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


class RecordReader(DataSourceReader):
    """A task for each file. With option ids=false, ids stay empty: only their checksum leaves the task."""

    def __init__(self, path: str, ids: bool):
        self.path, self.ids = path, ids

    def partitions(self):
        store, folder = open_folder(self.path)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as file:
            files = json.loads(file.read())["files"]
        starts = np.concatenate(([0], np.cumsum([f["ids"] for f in files], dtype=np.int64)))
        return [OneFile(f["name"], int(s)) for f, s in zip(files, starts)] or [OneFile("", 0)]

    def read(self, partition):
        if not partition.name:
            return
        store, folder = open_folder(self.path)
        at, rows, held = partition.start, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

        with store.open_input_stream(f"{folder}/{partition.name}.rec", buffer_size=BUFFER) as file:
            while (found := unframe(file, partition.name)) is not None:
                doc_id, width, ids = found
                ids = tokens.wide(ids, width)
                rows.append((doc_id, at, n := len(ids) // 4, zlib.crc32(ids), ids if self.ids else b""))
                at, held = at + n, held + len(ids)
                if held > BATCH_BYTES or len(rows) >= 10_000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class TokenRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_records"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options["path"], self.options.get("ids", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options["path"], self.options.get("tokenizer"), int(self.options.get("end_id", END_ID)))


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, job: str) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, ids, width) from batches of (doc_id, text), in the same order."""
    e = tokens.shared(tokenizer, job)
    end = np.array([end_id], e.dtype).tobytes()
    for batch in batches:
        made, held, first = [], 0, 0
        doc_ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            made.append(e.encode(texts[i].as_py() or "") + end)
            held += len(made[-1])
            if held > BATCH_BYTES or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, len(made)), pa.array(made, pa.binary()), pa.array(np.full(len(made), e.width, np.int32))], names=["doc_id", "ids", "width"])
                made, held, first = [], 0, i + 1


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, width) of whole texts, row by row in the order of docs."""
    import public_tokenizers

    path, job = tokenizer or public_tokenizers.path(TOKENIZER), uuid.uuid4().hex
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: encoded(batches, path, end_id, job), "doc_id bigint, ids binary, width int")


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of docs to files under path, in ascending doc_id order over all files.

    Texts are dealt out by ranges of (doc_id, hash of the text) and encoded after that, by the writer itself, so the order costs one
    shuffle of the texts and the pass that samples the ranges encodes nothing.
    """
    import public_tokenizers

    spark = docs.sparkSession
    spark.dataSource.register(TokenRecords)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = narrow.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    how = {"tokenizer": tokenizer or public_tokenizers.path(TOKENIZER), "end_id": end_id}
    ordered.select("doc_id", "text").write.format("cairn_records").options(**how).mode("append").save(path)


def read_records(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    spark.dataSource.register(TokenRecords)
    return spark.read.format("cairn_records").option("ids", str(ids).lower()).load(path)


def read_at(path: str, name: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in a file, through the index: what a shuffled reader does."""
    store, folder = open_folder(path)
    with store.open_input_file(f"{folder}/{name}.idx") as index:
        index.seek(16 * record)
        offset, _ = struct.unpack("<QQ", index.read(16))
    with store.open_input_file(f"{folder}/{name}.rec") as file:
        file.seek(offset)
        doc_id, width, ids = unframe(file, name)
    return doc_id, np.frombuffer(ids, f"<u{width}")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    path = ws.new_path(spark, "records")
    write_records(ws.table(spark, sf_dir, "documents"), path)
    return read_records(spark, path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
