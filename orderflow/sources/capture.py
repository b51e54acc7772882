"""Packet captures as a Spark data source: ``spark.read.format("pcap")``, ``readStream`` and ``write``.

Captures are read in ranges of bytes, so one large file is many tasks. A range begins at the first record in it, which is
found by following the headers of records before it; a record belongs to the range in which it starts. The sink
writes one file for each task, under a temporary name until the driver commits.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..functions.scalars import big_endian, big_endian_hex

#: The file header's marks (micro- and nanoseconds, little-endian), its length and a record header's, the link type Ethernet.
MICRO, NANO, FILE_HEAD, RECORD_HEAD, ETHERNET = 0xA1B2C3D4, 0xA1B23C4D, 24, 16, 1
#: Longest record that is written, and that is believed in.
SNAPLEN = 262_144
#: Bytes of a range; records that must follow each other for a place to be a record's start; seconds between any two of a file.
RANGE, CHAIN, SPAN = 64 << 20, 16, 400 * 86_400
PIECE = 8 << 20
SCHEMA = "path string, at long, ts_ns long, orig_len int, frame binary"
_FIELDS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("ts_ns", pa.int64()), ("orig_len", pa.int32()), ("frame", pa.binary())])
_RECORD = struct.Struct("<IIII")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    """A capture, or all in a folder, by time of writing; names with a dot or underscore in front are no captures."""
    store, own = _open(path)
    info = store.get_file_info(own)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: (f.mtime_ns or 0, f.path))


def _ranges(files: Sequence[fs.FileInfo], size: int) -> list[_Range]:
    return [_Range(f.path, at, min(at + (size or f.size), f.size)) for f in files for at in range(0, f.size, size or max(1, f.size))]


class _Bytes:
    """Part of a file that slides along; ``need`` is what must be there from a place on."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, place: int, need: int) -> memoryview:
        """``need`` bytes from ``place`` on, fewer at the end of the file."""
        if place < self.base or place + need > self.base + len(self.data):
            self.file.seek(place)
            self.base, self.data = place, self.file.read(min(max(need, PIECE), self.size - place)) if place < self.size else b""
        return memoryview(self.data)[place - self.base : place - self.base + need]


def _head(part: _Bytes, at: int, parts: int, near: int) -> tuple[int, int, int, int] | None:
    """Seconds, fraction, stored and original length of a record that may start at ``at``; None where none can."""
    head = part.at(at, RECORD_HEAD)
    if len(head) < RECORD_HEAD:
        return None
    sec, fraction, stored, length = _RECORD.unpack(head)
    sound = fraction < parts and 0 < stored <= min(length, SNAPLEN) and length <= 1 << 20 and abs(sec - near) <= SPAN
    return (sec, fraction, stored, length) if sound else None


def _follow(part: _Bytes, at: int, until: int, most: float, parts: int, near: int) -> int | None:
    """Where the records that begin at ``at`` lead to, beyond ``until`` or after ``most`` of them or at the end; None if one cannot be."""
    while at < min(until, part.size) and most > 0:
        head = _head(part, at, parts, near)
        if head is None:
            return at if part.size - at < RECORD_HEAD else None
        at, most = at + RECORD_HEAD + head[2], most - 1
    return at


def _first_record(part: _Bytes, start: int, parts: int, near: int) -> int:
    """The first record from ``start`` on.

    The search begins two longest records earlier. Bytes of a frame that look like records lead to the end of that frame, where the
    true ones go on, or to nothing; so what is followed up to ``start`` are true ones.
    """
    at = start - 2 * SNAPLEN
    if at <= FILE_HEAD:
        return _follow(part, FILE_HEAD, start, float("inf"), parts, near) or part.size
    while at < part.size:
        if _follow(part, at, part.size, CHAIN, parts, near) is not None and (first := _follow(part, at, start, float("inf"), parts, near)) is not None:
            return first
        at += 1
    return part.size


def records(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Records that start in the range. A cut-off record ends its file; a file that is no capture is an error."""
    store, own = _open(path)
    size = store.get_file_info(own).size
    with store.open_input_file(own) as file:
        part = _Bytes(file, size)
        head = bytes(part.at(0, FILE_HEAD))
        mark = struct.unpack("<I", head[:4])[0] if len(head) == FILE_HEAD else 0
        if mark not in (MICRO, NANO):
            raise ValueError(f"{path} is no capture that is known")
        parts = 10**9 if mark == NANO else 10**6
        first = part.at(FILE_HEAD, 4)
        near = struct.unpack("<I", first)[0] if len(first) == 4 else 0
        at = FILE_HEAD if start <= FILE_HEAD else _first_record(part, start, parts, near)
        rows: list[tuple] = []
        held = 0
        while at < end:
            found = part.at(at, RECORD_HEAD)
            if len(found) < RECORD_HEAD:
                break
            sec, fraction, stored, length = _RECORD.unpack(found)
            frame = bytes(part.at(at + RECORD_HEAD, stored)) if stored <= SNAPLEN else b""
            if len(frame) < stored:
                break
            rows.append((own, at, sec * 10**9 + fraction * (10**9 // parts), length, frame))
            at, held = at + RECORD_HEAD + stored, held + stored
            if held >= PIECE or len(rows) >= 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        return _ranges(_files(self.path), self.size)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from records(partition.path, partition.start, partition.end)


class _StreamReader(DataSourceStreamReader):
    """Captures are whole when they appear in the folder (written elsewhere and moved in). The offset is the last one's time and path."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"mtime_ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"mtime_ns": files[-1].mtime_ns or 0, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        place = lambda o: (o["mtime_ns"], o["path"])
        return _ranges([f for f in _files(self.path) if place(start) < (f.mtime_ns or 0, f.path) <= place(end)], self.size)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from records(partition.path, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceArrowWriter):
    """Tasks write below ``_temporary``; the driver moves what succeeded to its place, or drops all of it."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, own = _open(self.path)
        folder = f"{own}/_temporary/{self.job}"
        name = f"part-{uuid.uuid4().hex}.pcap"
        batch = next(iterator, None)
        if batch is None:
            return _Written(None)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(struct.pack("<IHHiIII", NANO, 2, 4, 0, 0, SNAPLEN, ETHERNET))
            while batch is not None:
                parts = []
                for ts, length, frame in zip(*(batch.column(c).to_pylist() for c in ("ts_ns", "orig_len", "frame"))):
                    frame = frame or b""
                    if not 0 < len(frame) <= SNAPLEN:
                        raise ValueError(f"a frame has 1 to {SNAPLEN} bytes, not {len(frame)}")
                    parts += [_RECORD.pack(ts // 10**9, ts % 10**9, len(frame), max(len(frame), length or 0)), frame]
                out.write(b"".join(parts))
                batch = next(iterator, None)
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, own = _open(self.path)
        before = [f.path for f in _files(self.path)] if self.overwrite else []
        names = [m.name for m in messages if m and m.name]
        store.create_dir(own, recursive=True)
        for name in names:
            store.move(f"{own}/_temporary/{self.job}/{name}", f"{own}/{name}")
        for path in before:
            store.delete_file(path)
        self._clear(store, own)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: fs.FileSystem, own: str) -> None:
        if store.get_file_info(f"{own}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{own}/_temporary/{self.job}")


class CaptureSource(DataSource):
    """Format ``pcap``; option ``rangeBytes`` sets the size of ranges, 0 one range to a file.

    Rows are path, at (byte of the record), ts_ns, orig_len and frame. Paths are local ones or URIs that Arrow's file systems open.
    Written rows need ts_ns, orig_len (or null) and frame.
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return int(self.options.get("rangeBytes", RANGE))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._size())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._size())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"ts_ns", "orig_len", "frame"} - set(schema.names)
        if missing:
            raise ValueError(f"captures need the columns {json.dumps(sorted(missing))}")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


def framed(payload: Column, dst_ip: Column, dst_port: Column) -> Column:
    """A payload behind Ethernet, IPv4 and UDP headers, 42 bytes together; checksums are left out."""
    length = F.length(payload)
    ethernet, ip = F.lit("01005E000001000000000000" + "0800"), F.concat(F.lit("4500"), big_endian_hex(length + 28, 2), F.lit("0000" + "4000" + "4011" + "0000" + "00000000"), big_endian_hex(dst_ip, 4))
    udp = F.concat(big_endian_hex(F.lit(0), 2), big_endian_hex(dst_port, 2), big_endian_hex(length + 8, 2), F.lit("0000"))
    return F.unhex(F.concat(ethernet, ip, udp, F.hex(payload)))


def destination(frame: Column) -> tuple[Column, Column]:
    """Address and port that a frame was sent to; null where it is shorter than its headers."""
    whole = F.length(frame) >= 42
    return F.when(whole, big_endian(frame, 30, 4).cast("long")), F.when(whole, big_endian(frame, 36, 2).cast("int"))
