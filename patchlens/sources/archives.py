"""ZIP archives as a Spark data source: read in ranges of their directories, written by tasks.

    spark.dataSource.register(archives.Archives)
    spark.read.format("members").option("path", "dump.zip").load()
    df.select("name", "content").write.format("members").mode("append").save("folder")

A reader's partition is a range of an archive's central directory; its task reads these entries and their members by
position, one member at a time, so that no archive is ever held. A member that cannot be read is a row with its error; an
archive without a directory is one such row. The driver scans directories in pieces and keeps a number for each range. A
writer's task makes archives of bounded directories, which get their names when the job commits; what a failed task or job wrote is deleted.
Paths are what Arrow's file systems open (local files, HDFS, object stores), a folder standing for its *.zip files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from typing import Any, BinaryIO
from zipfile import ZIP_DEFLATED, ZipFile

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "archive string, name string, content binary, error string"
#: Members of a partition at most, and stored bytes of one about.
MEMBERS, BYTES = 1000, 64 << 20
#: Members of an archive that a writer makes at most: it remembers each until the archive's directory is written.
WRITTEN = 50_000
#: Bytes of a directory that are scanned at once.
PIECE = 1 << 20
# The records of the format.
ENTRY, LOCAL, END, END64, LOCATOR64 = b"PK\1\2", b"PK\3\4", b"PK\5\6", b"PK\6\6", b"PK\6\7"
FIXED, LOCAL_FIXED, END_FIXED = 46, 30, 22
MANY32 = 0xFFFFFFFF


@dataclass
class Entry:
    name: str
    method: int
    flags: int
    crc: int
    stored: int
    size: int
    at: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def directory(file: BinaryIO, size: int) -> tuple[int, int]:
    """Where the central directory begins, and its bytes."""
    back = min(size, END_FIXED + 0xFFFF)
    file.seek(size - back)
    tail = file.read(back)
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < END_FIXED:
        raise ValueError("no directory")
    length, start = struct.unpack_from("<II", tail, at + 12)
    if length == MANY32 or start == MANY32:
        place = tail.rfind(LOCATOR64, 0, at)
        if place < 0:
            raise ValueError("no 64-bit directory")
        file.seek(struct.unpack_from("<Q", tail, place + 8)[0])
        record = file.read(56)
        if record[:4] != END64:
            raise ValueError("no 64-bit directory")
        length, start = struct.unpack_from("<QQ", record, 40)
    if start + length > size:
        raise ValueError("the directory is cut off")
    return start, length


def entries(data: bytes) -> Iterator[tuple[int, Entry]]:
    """Entries of a piece of a directory that are whole, each with where it ends."""
    at = 0
    while at + FIXED <= len(data):
        if data[at : at + 4] != ENTRY:
            raise ValueError("a broken directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        crc, stored, size, name, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        (place,) = struct.unpack_from("<I", data, at + 42)
        end = at + FIXED + name + extra + comment
        if end > len(data):
            return
        more, k = data[at + FIXED + name : at + FIXED + name + extra], 0
        while k + 4 <= len(more):
            kind, long = struct.unpack_from("<HH", more, k)
            if kind == 1:  # values that do not fit into 32 bits, in this order
                wide = iter(struct.unpack_from(f"<{long // 8}Q", more, k + 4))
                size = next(wide, size) if size == MANY32 else size
                stored = next(wide, stored) if stored == MANY32 else stored
                place = next(wide, place) if place == MANY32 else place
            k += 4 + long
        label = data[at + FIXED : at + FIXED + name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        yield end, Entry(label, method, flags, crc, stored, size, place)
        at = end


def member(file: BinaryIO, e: Entry) -> bytes:
    file.seek(e.at)
    head = file.read(LOCAL_FIXED)
    if len(head) < LOCAL_FIXED or head[:4] != LOCAL:
        raise ValueError("no member where the directory says")
    if e.flags & 1:
        raise ValueError("encrypted")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(e.at + LOCAL_FIXED + name + extra)
    data = file.read(e.stored)
    if e.method == 8:
        inflater = zlib.decompressobj(-15)
        data = inflater.decompress(data, e.size + 1)
    elif e.method:
        raise ValueError(f"method {e.method}")
    if len(data) != e.size or zlib.crc32(data) != e.crc:
        raise ValueError("the member is damaged")
    return data


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int
    error: str = ""


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [options["path"]] if "path" in options else []
        self.members = int(options.get("members", MEMBERS))

    def archives(self) -> Iterator[str]:
        for path in self.paths:
            system, place = opened(path)
            info = system.get_file_info(place)
            scheme = path[: path.index(place)] if place in path else ""
            if info.type == fs.FileType.Directory:
                found = system.get_file_info(fs.FileSelector(place, recursive=True))
                yield from sorted(scheme + f.path for f in found if f.path.endswith(".zip"))
            elif info.type == fs.FileType.File:
                yield path

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        for path in self.archives():
            system, place = opened(path)
            try:
                with system.open_input_file(place) as file:
                    start, length = directory(file, file.size())
                    at, first, count, held = start, start, 0, 0
                    while at < start + length:
                        file.seek(at)
                        data, used = file.read(min(PIECE, start + length - at)), 0
                        for end, e in entries(data):
                            used, count, held = end, count + 1, held + e.stored
                            if count >= self.members or held >= BYTES:
                                out.append(Range(path, first, at + end))
                                first, count, held = at + end, 0, 0
                        if not used:
                            raise ValueError("a broken directory")
                        at += used
                    if first < start + length:
                        out.append(Range(path, first, start + length))
            except (ValueError, OSError, struct.error) as e:
                out = [r for r in out if r.archive != path] + [Range(path, 0, 0, f"{type(e).__name__}: {e}")]
        return out

    def read(self, partition: Any) -> Iterator[tuple]:
        if partition is None:
            return
        if partition.error:
            yield partition.archive, None, None, partition.error
            return
        system, place = opened(partition.archive)
        with system.open_input_file(place) as file:
            file.seek(partition.start)
            for _, e in entries(file.read(partition.end - partition.start)):
                if e.name.endswith("/"):
                    continue
                try:
                    yield partition.archive, e.name, member(file, e), None
                except (ValueError, OSError, struct.error, zlib.error) as wrong:
                    yield partition.archive, e.name, None, f"{type(wrong).__name__}: {wrong}"


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def write(self, iterator: Iterator[Any]) -> Written:
        system, folder = opened(self.path)
        system.create_dir(f"{folder}/_temporary", recursive=True)
        paths: list[str] = []
        try:
            while (first := next(iterator, None)) is not None:
                paths.append(f"{folder}/_temporary/{uuid.uuid4().hex}.zip")
                with system.open_output_stream(paths[-1]) as out, ZipFile(out, "w", ZIP_DEFLATED) as archive:
                    archive.writestr(first["name"], bytes(first["content"] or b""))
                    for row in islice(iterator, WRITTEN - 1):
                        archive.writestr(row["name"], bytes(row["content"] or b""))
        except BaseException:
            for path in paths:
                if system.get_file_info(path).type == fs.FileType.File:
                    system.delete_file(path)
            raise
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.path.endswith(".zip"):
                    system.delete_file(f.path)
        for k, path in enumerate(p for m in messages if m is not None for p in m.paths):
            system.move(path, f"{folder}/part-{k:05}-{uuid.uuid4().hex[:8]}.zip")
        system.delete_dir(f"{folder}/_temporary")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        if system.get_file_info(f"{folder}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_temporary")


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)
