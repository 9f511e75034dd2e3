"""A data source that stages rows: Parquet files with their hashes, and nothing that a reader would see.

Tasks write files of bounded size under a name of their own for every attempt, read each back and compare its
hash with that of what they wrote.  `commit` lists the files of the tasks that succeeded; `abort`, after
a task has failed for good, removes what the others wrote and lists nothing.  Only a journal
(`sinks.versions`) makes listed files part of a table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Arrow bytes of one file.
FILE_BYTES = 128 << 20
LISTING = "_staged.json"


def file_sha256(system: fs.FileSystem, path: str) -> str:
    digest = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


class _Hashed:
    """An output stream that knows the hash of what went through it."""

    def __init__(self, out):
        self.out, self.digest, self.closed = out, hashlib.sha256(), False

    def write(self, data) -> int:
        self.digest.update(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()

    def tell(self) -> int:
        return self.out.tell()

    def close(self) -> None:
        self.closed = True
        self.out.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, str]]


class StagingWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        files: list[tuple[str, int, str]] = []
        writer = out = None
        rows = held = 0

        def close() -> None:
            writer.close()
            out.close()
            told = out.digest.hexdigest()
            if file_sha256(system, f"{folder}/{name}") != told:
                raise OSError(f"{name} does not read as it was written")
            files.append((name, rows, told))

        for batch in iterator:
            if writer is None:
                name, rows, held = f"part-{uuid.uuid4().hex}.parquet", 0, 0
                out = _Hashed(system.open_output_stream(f"{folder}/{name}", compression=None))
                writer = pq.ParquetWriter(pa.PythonFile(out, mode="w"), batch.schema)
            writer.write_batch(batch)
            rows, held = rows + batch.num_rows, held + batch.nbytes
            if held >= FILE_BYTES:
                close()
                writer = None
        if writer is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        system.create_dir(folder, recursive=True)
        told = sorted(x for m in messages if m for x in m.files)
        with system.open_output_stream(f"{folder}/{LISTING}", compression=None) as f:
            f.write(json.dumps(told).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class StagedSource(DataSource):
    """Write only; option `folder` is a new folder."""

    @classmethod
    def name(cls) -> str:
        return "loomspan_staged"

    def schema(self) -> str:
        return "nothing string"

    def writer(self, schema, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options["folder"])


def listed(folder: str) -> list[tuple[str, int, str]]:
    """(name, rows, hash) of the files that a committed write staged in a folder."""
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{LISTING}", compression=None) as f:
        return [tuple(x) for x in json.loads(f.read())]
