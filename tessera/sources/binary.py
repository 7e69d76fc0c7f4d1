"""Readings as packed binary records: a data source for batch and stream, read by byte ranges.

A record is a magic number, the length of its body, the body and the CRC-32 of the body; the body holds the fields of
FIELDS. Files are found by commit documents in the folder _commits, which the writer makes when all its tasks are done;
a folder without such documents, as a device dumps it, is read as it is, every .bin file of it.

A range's reader begins at the first whole record that begins in it, and ends at the first that begins after it, so
every byte is looked at by one reader: what is no whole record on the way is reported as a row with `broken` set, and
reading goes on at the next magic number.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

MAGIC = b"TSR\x01"
FIELDS = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
SCHEMA = f"{FIELDS}, broken string, file string, at long"
#: Bytes of a range, rows of a batch, bytes that are read at a time, and the longest body that is believed.
RANGE, ROWS, READ, LONGEST = 64 << 20, 8192, 4 << 20, 1 << 26
_HEAD, _FIXED = struct.Struct("<4sI"), struct.Struct("<BqqqdII")


def packed(event_id, user_id, us, event_type, value, props) -> bytes:
    """One record; a null is a bit of the first byte."""
    fields = (event_id, user_id, us, event_type, value, props)
    nulls = sum(1 << k for k, x in enumerate(fields) if x is None)
    kind, text = (event_type or "").encode(), (props or "").encode()
    body = _FIXED.pack(nulls, event_id or 0, user_id or 0, us or 0, 0.0 if value is None else value, len(kind), len(text)) + kind + text
    return _HEAD.pack(MAGIC, len(body)) + body + struct.pack("<I", zlib.crc32(body))


def unpacked(body: bytes) -> tuple | None:
    """The fields of a body, or None if its lengths don't fit."""
    if len(body) < _FIXED.size:
        return None
    nulls, event_id, user_id, us, value, n, m = _FIXED.unpack_from(body)
    if _FIXED.size + n + m != len(body):
        return None
    kind, text = body[_FIXED.size : _FIXED.size + n], body[_FIXED.size + n :]
    fields = (event_id, user_id, us, kind.decode(errors="replace"), value, text.decode(errors="replace"))
    return tuple(None if nulls >> k & 1 else x for k, x in enumerate(fields))


class _Bytes:
    """A file as a buffer that is read on as needed and forgotten from behind."""

    def __init__(self, file, size: int, at: int) -> None:
        self.file, self.size, self.begin, self.data = file, size, at, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the end of the file; `at` never falls."""
        if at + n > self.begin + len(self.data):
            keep = self.data[max(0, at - self.begin) :]
            begin = max(at, self.begin)
            self.file.seek(begin + len(keep))
            self.data, self.begin = keep + self.file.read(max(READ, n)), begin
        return self.data[at - self.begin : at - self.begin + n]

    def find(self, at: int) -> int:
        """Where the next magic number from `at` on begins, or the size."""
        while at < self.size:
            some = self.get(at, READ)
            if (k := some.find(MAGIC)) >= 0:
                return at + k
            if len(some) < READ:
                break
            at += len(some) - len(MAGIC) + 1
        return self.size


def records(file, size: int, begin: int, end: int) -> Iterator[tuple]:
    """(at, fields, None) or (at, None, what is wrong) of the range [begin, end)."""
    data, at = _Bytes(file, size, begin), begin
    started, bad = begin == 0, None  # bad: where what is being reported began
    while at < size:
        head, why, fields = data.get(at, _HEAD.size), "no magic number", None
        if head[:4] == MAGIC:
            n = _HEAD.unpack(head)[1] if len(head) == _HEAD.size else LONGEST + 1
            why = "cut short" if n <= LONGEST else "length"
            rest = data.get(at + _HEAD.size, n + 4) if n <= LONGEST else b""
            if n <= LONGEST and len(rest) == n + 4:
                why = "checksum"
                if struct.unpack_from("<I", rest, n)[0] == zlib.crc32(rest[:n]):
                    fields, why = unpacked(rest[:n]), "lengths"
        if fields is None:
            if started and bad is None:
                bad = (at, why)
            at = data.find(at + 1)
            if not started and at >= end:
                return
            continue
        if bad is not None:
            yield bad[0], None, bad[1]
            bad = None
        if at >= end:
            return
        started = True
        yield at, fields, None
        at += _HEAD.size + n + 4
    if bad is not None:
        yield bad[0], None, bad[1]


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _committed(path: str) -> list[tuple[int, dict]]:
    """Numbers and documents of the commits of a folder, in order."""
    fs, root = _filesystem(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/_commits", allow_not_found=True))
    names = sorted((int(f.base_name.removesuffix(".json")), f.path) for f in found if f.base_name.endswith(".json"))
    return [(n, json.loads(fs.open_input_stream(p).read())) for n, p in names]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int
    checks: tuple = ()


def _ranges(path: str, files: list[dict], size: int, checks: tuple = ()) -> list[Range]:
    out = []
    for f in files:
        if f.get("least") is not None and any(c == "ts" and not _may(op, v, f["least"], f["most"]) for c, op, v in checks):
            continue
        out += [Range(f"{path}/{f['name']}", k, min(k + size, f["size"]), f["size"], checks) for k in range(0, f["size"], size)]
    return out


def _may(op: str, v: int, least: int, most: int) -> bool:
    """Whether a file whose times are from least to most may hold one that passes."""
    return {"=": least <= v <= most, ">": most > v, ">=": most >= v, "<": least < v, "<=": least <= v}[op]


_PASS = {"=": lambda x, v: x == v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v}
_PLACE = {"event_id": 0, "user_id": 1, "ts": 2, "event_type": 3, "value": 4}


def _read(part: Range) -> Iterator[pa.RecordBatch]:
    fs, path = _filesystem(part.path)
    kinds = [pa.int64(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows: list[tuple] = []
    with fs.open_input_file(path) as file:
        for at, fields, broken in records(file, part.size, part.begin, part.end):
            if fields is None:
                fields = (None,) * 6
                if part.checks:  # as a null, it passes no comparison
                    continue
            elif any((x := fields[_PLACE[c]]) is None or not _PASS[op](x, v) for c, op, v in part.checks):
                continue
            rows.append((*fields, broken, part.path if broken else None, at if broken else None))
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class BinaryReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.checks = path, size, ()

    def partitions(self) -> list[Range]:
        commits = _committed(self.path)
        files = [f for _, c in commits for f in c["files"]]
        if not commits:
            fs, root = _filesystem(self.path)
            files = [{"name": f.base_name, "size": f.size} for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".bin")]
        return _ranges(self.path, files, self.size, self.checks) or [Range(self.path, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition.size else iter(())


class PushingReader(BinaryReader):
    """Comparisons with a constant are made before a row is, and files without such times aren't opened."""

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            op, column, v = ops.get(type(f)), ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if op is None or column not in _PLACE or v is None:
                yield f
                continue
            if column == "ts":
                v = _micros(v)
            self.checks += ((column, op, v),)


def _micros(at: datetime.datetime) -> int:
    at = at if at.tzinfo else at.astimezone()
    return (at - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)) // datetime.timedelta(microseconds=1)


class BinaryStream(DataSourceStreamReader):
    """Offsets are numbers of commits: a batch holds the files of some commits, each in ranges."""

    def __init__(self, path: str, size: int, most: int) -> None:
        self.path, self.size, self.most, self.at = path, size, most, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        numbers = [n for n, _ in _committed(self.path) if n > self.at]
        self.at = (numbers[: self.most] or [self.at])[-1]
        return {"commit": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = max(self.at, end["commit"])
        files = [f for n, c in _committed(self.path) if start["commit"] < n <= end["commit"] for f in c["files"]]
        return _ranges(self.path, files, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)


@dataclass
class Written(WriterCommitMessage):
    files: list


class BinaryWriter(DataSourceArrowWriter):
    """A file for each task; a job's files are seen when its commit document is there."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, size, least, most = f"{uuid.uuid4().hex}.bin", 0, None, None
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                columns = {c: batch.column(c) for c in batch.schema.names}
                columns["ts"] = columns["ts"].cast(pa.timestamp("us", columns["ts"].type.tz)).cast(pa.int64())
                for row in zip(*(columns[c.split()[0]].to_pylist() for c in FIELDS.split(", ")), strict=True):
                    data = packed(*row)
                    out.write(data)
                    size += len(data)
                    if row[2] is not None:
                        least, most = row[2] if least is None else min(least, row[2]), row[2] if most is None else max(most, row[2])
        return Written([{"name": name, "size": size, "least": least, "most": most}] if size else [])

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        old = _committed(self.path)
        fs.create_dir(f"{root}/_commits", recursive=True)
        if self.overwrite:
            for n, _ in old:
                fs.delete_file(f"{root}/_commits/{n}.json")
        n, made = (old[-1][0] if old else 0) + 1, f"{root}/_commits/.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as out:
            out.write(json.dumps({"files": [f for m in messages if m for f in m.files]}).encode())
        fs.move(made, f"{root}/_commits/{n}.json")

    def abort(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f['name']}")


class BinaryRecords(DataSource):
    """Format "tessera_records"; register it with spark.dataSource.register(BinaryRecords).

    Options: path (a folder: a local path, or a URI that pyarrow knows), rangeBytes, pushdown (true: takes filters; Spark
    asks for spark.sql.python.filterPushdown.enabled then), commitsPerTrigger. A row has the fields of FIELDS, or what is
    wrong in broken with its file and place. One job writes to a folder at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_records"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def reader(self, schema) -> BinaryReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else BinaryReader
        return kind(self._path(), int(self.options.get("rangeBytes", RANGE)))

    def streamReader(self, schema) -> BinaryStream:  # noqa: N802
        return BinaryStream(self._path(), int(self.options.get("rangeBytes", RANGE)), int(self.options.get("commitsPerTrigger", 1 << 30)))

    def writer(self, schema, overwrite: bool) -> BinaryWriter:
        return BinaryWriter(self._path(), overwrite)
