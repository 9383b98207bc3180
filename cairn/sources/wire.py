"""The request protocol as text on disk: command logs in frames of arrays of bulk strings, read and written by Spark.

A log has an order, and frames can't be found from the middle of a file, so a file is one task; a database number holds from its
`select` on. Spark reads logs of many files in parallel, (file, nth) being the order.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"
BUFFER = 1 << 20


def encode_command(words: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(w), w) for w in words)


def encode_texts(commands: Iterable[Collection[str]]) -> bytes:
    """encode_command of each of the commands, whose words are texts."""
    out = []
    for words in commands:
        out.append(f"*{len(words)}\r\n")
        out += [f"${len(w) if w.isascii() else len(w.encode())}\r\n{w}\r\n" for w in words]
    return "".join(out).encode()


def encode_reply(value) -> bytes:
    """None, integers, bytes, lists, text (a status) and exceptions (an error)."""
    if value is None:
        return b"$-1\r\n"
    if isinstance(value, bool | int):
        return b":%d\r\n" % value
    if isinstance(value, bytes):
        return b"$%d\r\n%s\r\n" % (len(value), value)
    if isinstance(value, Exception):
        return b"-%s\r\n" % str(value).encode()
    if isinstance(value, str):
        return b"+%s\r\n" % value.encode()
    return b"*%d\r\n" % len(value) + b"".join(map(encode_reply, value))


class Torn(ValueError):
    """A value that the end of the file cuts off."""


def decode(file) -> Iterator:
    """Values of a stream of frames; a line that starts with no mark is a command of words with blanks between."""
    while (value := _next(file)) is not _END:
        yield value


_END = object()


def _next(file):
    line = file.readline()
    if not line:
        return _END
    if not line.endswith(b"\n"):
        raise Torn("a frame ends within its first line")
    mark, rest = line[:1], line[1:].rstrip(b"\r\n")
    if mark == b"*":
        out = [_next(file) for _ in range(int(rest))] if int(rest) >= 0 else None
        if out and any(x is _END for x in out):
            raise Torn("an array ends early")
        return out
    if mark == b"$":
        n = int(rest)
        if n < 0:
            return None
        body = file.read(n + 2)
        if len(body) != n + 2 or body[-2:] != b"\r\n":
            raise Torn("a bulk string ends early")
        return body[:-2]
    if mark == b":":
        return int(rest)
    if mark == b"+":
        return rest.decode()
    if mark == b"-":
        return RuntimeError(rest.decode())
    return line.split()


def whole(values: Iterator) -> Iterator:
    """values up to one that is cut off: a writer that was stopped leaves such a last command, which never took effect."""
    try:
        yield from values
    except Torn:
        return


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class OneFile(InputPartition):
    def __init__(self, name: str):
        self.name = name


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, folder = _open(self.path)
        info = store.get_file_info(folder)
        if info.type == fs.FileType.File:
            return [OneFile(folder)]
        listed = f"{folder}/{MANIFEST}"
        if store.get_file_info(listed).type == fs.FileType.File:
            with store.open_input_stream(listed) as file:
                names = [f"{folder}/{n}" for n in json.loads(file.read())]
        else:
            names = sorted(i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.path.endswith(".aof"))
        return [OneFile(n) for n in names]

    def read(self, partition):
        store, _ = _open(self.path)
        rows, db = [], 0
        with store.open_input_stream(partition.name, buffer_size=BUFFER) as file:
            for nth, words in enumerate(whole(decode(io.BufferedReader(file, BUFFER)))):
                if not words:
                    continue
                name = words[0].decode().lower()
                if name == "select":
                    db = int(words[1])
                    continue
                args = [w.decode("utf-8", "replace") for w in words[1:]]
                rows.append((partition.name.rpartition("/")[2], nth, db, name, args[0] if args else None, args[1:]))
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "nth", "db", "cmd", "key", "args"])


class Written(WriterCommitMessage):
    def __init__(self, part: int, name: str):
        self.part, self.name = part, name


class LogWriter(DataSourceArrowWriter):
    """Rows (db, cmd, key, args) in the order in which the task gets them."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        name, out, db = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.aof", None, None
        for batch in iterator:
            commands = []
            for at, cmd, key, args in zip(*(batch.column(c).to_pylist() for c in ("db", "cmd", "key", "args"))):
                if at != db:
                    db = at
                    commands.append(("select", str(db or 0)))
                commands.append([w for w in (cmd, key, *(args or ())) if w is not None])
            if commands:
                out = out or store.open_output_stream(f"{folder}/{name}", buffer_size=BUFFER)
                out.write(encode_texts(commands))
        if out:
            out.close()
        return Written(TaskContext.get().partitionId(), name if out else "")

    def commit(self, messages) -> None:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps([m.name for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part)]).encode())

    def abort(self, messages) -> None:
        store, folder = _open(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{folder}/{m.name}")


class CommandLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_log"

    def schema(self) -> str:
        return "file string, nth bigint, db int, cmd string, key string, args array<string>"

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LogWriter(self.options["path"])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CommandLog)
    return spark.read.format("cairn_log").load(path)


def in_order(log: DataFrame) -> DataFrame:
    """seq, cmd, key, args of a read log: files in the order of their parts' numbers, commands as they stand in them."""
    part = F.coalesce(F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return log.select((part * (1 << 40) + F.col("nth")).alias("seq"), "cmd", "key", "args")


def write_log(commands: DataFrame, path: str) -> None:
    """commands: db, cmd, key, args, written in the order of their partitions."""
    commands.sparkSession.dataSource.register(CommandLog)
    commands.select("db", "cmd", "key", F.col("args").cast("array<string>").alias("args")).write.format("cairn_log").mode("append").save(path)
