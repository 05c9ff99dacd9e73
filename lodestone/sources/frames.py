"""Files of length-prefixed frames as a data source and sink: four bytes, big-endian, then that many of CBOR or JSON.

Reading: a file up to a part's size is one part; of a larger one the prefixes are walked once, and its frames dealt to
parts by bytes. Each part is read and decoded alone, in Arrow blocks. Empty and oversized frames, and a file that ends
within one, are errors that name the file and place. Writing: a file a task, moved into place when the job is committed.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.sources.files import cbor_decode, cbor_encode

MOST, PART, BLOCK = 16 << 20, 32 << 20, 4096  # bytes of a frame, bytes of a part, frames of an Arrow block
SCHEMA = "file string, offset long, size int, message string"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def checked(size: int, most: int, file: str, at: int) -> int:
    if not 0 < size <= most:
        raise ValueError(f"bad frame of {size} bytes in {file} at {at}")
    return size


def walked(stream, total: int, part: int, most: int, file: str) -> list[tuple[int, int]]:
    """(start, end) of parts of whole frames, each of about `part` bytes, by the prefixes alone."""
    out, start, at = [], 0, 0
    while at < total:
        stream.seek(at)
        head = stream.read(4)
        if len(head) < 4:
            raise ValueError(f"{file} ends within a frame at {at}")
        after = at + 4 + checked(struct.unpack(">I", head)[0], most, file, at)
        if after > total:
            raise ValueError(f"{file} ends within a frame at {at}")
        if after - start > part and at > start:
            out.append((start, at))
            start = at
        at = after
    return [*out, (start, total)] if total > start else out


class Part(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))


class Frames(DataSource):
    """Options: path, most (bytes of a frame), part (bytes of a part). Rows: file, offset, size, and the message as JSON text, null where a body is neither CBOR nor JSON. The sink takes rows with a `message`, JSON text, and writes CBOR."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options["path"], int(self.options.get("most", MOST)), int(self.options.get("part", PART)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if "message" not in schema.names:
            raise ValueError("frames are written from a column `message`")
        return FrameWriter(self.options["path"], int(self.options.get("most", MOST)), overwrite)


class FrameReader(DataSourceReader):
    def __init__(self, path: str, most: int, part: int):
        self.path, self.most, self.part = path, most, part

    def partitions(self) -> list[Part]:
        from pyarrow.fs import FileSelector, FileType

        fs, path = filesystem(self.path)
        info = fs.get_file_info(path)
        held = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(path, recursive=True)) if f.type == FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted(held, key=lambda f: f.path):
            if f.size <= self.part:
                out += [Part(f.path, 0, f.size)] if f.size else []
                continue
            with fs.open_input_file(f.path) as stream:
                out += [Part(f.path, a, b) for a, b in walked(stream, f.size, self.part, self.most, f.path)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        file, start, end = partition.value
        if start == end:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(file) as stream:
            stream.seek(start)
            data = stream.read(end - start)
        rows, at = [], 0
        while at < len(data):
            if at + 4 > len(data):
                raise ValueError(f"{file} ends within a frame at {start + at}")
            size = checked(struct.unpack_from(">I", data, at)[0], self.most, file, start + at)
            if at + 4 + size > len(data):
                raise ValueError(f"{file} ends within a frame at {start + at}")
            rows.append((file, start + at, size, decoded(data[at + 4 : at + 4 + size])))
            at += 4 + size
            if len(rows) == BLOCK:
                yield block(rows)
                rows = []
        if rows:
            yield block(rows)


def block(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["file", "offset", "size", "message"])


def decoded(body: bytes) -> str | None:
    """JSON text of a body, told apart by its first byte."""
    try:
        return json.dumps(json.loads(body) if body[:1] == b"{" else cbor_decode(body), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, KeyError, IndexError, struct.error, TypeError):
        return None


@dataclass
class Written(WriterCommitMessage):
    staged: str
    file: str


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str, most: int, overwrite: bool):
        self.path, self.most, self.overwrite, self.job = path, most, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = filesystem(self.path)
        staged = f"{path}/_temporary-{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{path}/_temporary-{self.job}", recursive=True)
        size = 0
        with fs.open_output_stream(staged) as out:
            for batch in iterator:
                for message in batch.column(batch.schema.get_field_index("message")).to_pylist():
                    body = cbor_encode(json.loads(message))
                    out.write(struct.pack(">I", checked(len(body), self.most, staged, size)) + body)
                    size += 4 + len(body)
        return Written(staged, f"{path}/part-{self.job}-{TaskContext.get().partitionId():05d}.frames" if size else "")  # a task without rows leaves no file

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(FileSelector(path)):
                if f.type == FileType.File:
                    fs.delete_file(f.path)
        for m in messages:
            if m is not None and m.file:
                fs.move(m.staged, m.file)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, path = filesystem(self.path)
        if fs.get_file_info(f"{path}/_temporary-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{path}/_temporary-{self.job}")
