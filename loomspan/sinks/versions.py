"""Tables that change together: rows are staged, checked, and become visible by one journal entry, or not at all.

The journal is a chain.  Entry n names the files that transaction n added to each table, with their
hashes, and the hash of entry n - 1; it is created once, so of two writers that both want to be n
one is refused.  A reader that names no version sees every entry there is, and a file that no
entry names is in no table.

A transaction has an id.  The same id with the same rows is a replay and changes nothing; with other rows it
is a collision.  Rows are the same when their number and the sum of their hashes are, in every table.  A
writer that read version n may ask to be n + 1; it gets a conflict if another was.

Files are created once by hard links where the folder is local, and by a rename that refuses an existing name on
HDFS.  A store without either must have one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staged import StagedSource, file_sha256, listed

COMMITTED, REPLAYED, COLLISION, CONFLICT, DRY_RUN = "committed", "replayed", "collision", "conflict", "dry_run"
_FILE = "struct<name: string, rows: bigint, sha256: string>"
JOURNAL = f"version bigint, transaction_id string, content_sha256 string, parent_sha256 string, parts array<struct<table: string, folder: string, schema: string, rows: bigint, digest: string, files: array<{_FILE}>>>"


@dataclass
class Part:
    """Staged rows of one table."""

    table: str
    folder: str
    schema: str
    rows: int
    digest: str
    files: list[tuple[str, int, str]]


@dataclass
class Outcome:
    outcome: str
    version: int | None


def rows_digest(df: DataFrame) -> tuple[int, str]:
    """(number, sum of hashes) of rows, in any order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row.n, str(row.h or 0)


def _content(told) -> str:
    """The hash of what (table, rows, digest) tell of a transaction."""
    return hashlib.sha256(json.dumps(sorted(told)).encode()).hexdigest()


def create_once(uri: str, data: bytes) -> bool:
    """Whether this call created the file; its content is there at once or not at all."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft, compression=None) as f:
        f.write(data)
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(draft, path)
        elif system.get_file_info(path).type != fs.FileType.NotFound:
            return False
        else:
            system.move(draft, path)
            return True
    except OSError:
        if system.get_file_info(path).type == fs.FileType.NotFound:
            raise
        return False
    finally:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
    return True


class Store:
    """A folder of tables and their journal."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        spark.dataSource.register(StagedSource)

    def stage(self, df: DataFrame, table: str) -> Part:
        """Write rows where no reader looks, and check that they read back as many."""
        folder = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        df.write.format("loomspan_staged").option("folder", folder).mode("append").save()
        files = listed(folder)
        part = Part(table, folder, df.schema.json(), sum(n for _, n, _ in files), "0", files)
        rows, part.digest = rows_digest(self._read([part], df.schema))
        if rows != part.rows:
            raise OSError(f"{table}: {rows} rows read back of {part.rows}")
        return part

    def _read(self, parts: list[Part], schema: T.StructType) -> DataFrame:
        paths = [f"{p.folder}/{name}" for p in parts for name, _, _ in p.files]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def version(self) -> int:
        """The newest version; 0 is the empty store."""
        system, path = fs.FileSystem.from_uri(f"{self.root}/journal")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return max((int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json")), default=0)

    def _entry(self, version: int) -> str:
        return f"{self.root}/journal/{version:020d}.json"

    def journal(self) -> DataFrame:
        """The entries, and their own hashes."""
        if not self.version():
            return self.spark.createDataFrame([], JOURNAL + ", entry_sha256 string")
        raw = self.spark.read.text(f"{self.root}/journal/*.json", wholetext=True)
        return raw.select(F.from_json("value", JOURNAL).alias("e"), F.sha2(F.col("value").cast("binary"), 256).alias("entry_sha256")).select("e.*", "entry_sha256")

    def commit(self, transaction_id: str, parts: list[Part], base: int | None = None, dry_run: bool = False) -> Outcome:
        """Make staged parts of any number of tables visible together."""
        content = _content((p.table, p.rows, p.digest) for p in parts)
        while True:
            prior = self._prior(transaction_id)
            if prior:
                return Outcome(REPLAYED if prior.content_sha256 == content else COLLISION, prior.version)
            newest = self.version()
            if base is not None and base != newest:
                return Outcome(CONFLICT, None)
            if dry_run:
                return Outcome(DRY_RUN, None)
            entry = {"version": newest + 1, "transaction_id": transaction_id, "content_sha256": content, "parent_sha256": self._sha(newest),
                     "parts": [{**vars(p), "files": [dict(zip(("name", "rows", "sha256"), f)) for f in p.files]} for p in parts]}
            if create_once(self._entry(newest + 1), json.dumps(entry).encode()):
                return Outcome(COMMITTED, newest + 1)

    def _prior(self, transaction_id: str):
        """The entry of a transaction, or None."""
        return self.journal().where(F.col("transaction_id") == transaction_id).first()

    def _sha(self, version: int) -> str:
        return file_sha256(*fs.FileSystem.from_uri(self._entry(version))) if version else ""

    def write(self, transaction_id: str, tables: dict[str, DataFrame], base: int | None = None, dry_run: bool = False) -> Outcome:
        """Stage and commit; rows of a transaction that is there already are only compared with it, as none of them would become visible."""
        prior = self._prior(transaction_id)
        if prior:
            content = _content((name, *rows_digest(df)) for name, df in tables.items())
            return Outcome(REPLAYED if prior.content_sha256 == content else COLLISION, prior.version)
        return self.commit(transaction_id, [self.stage(df, name) for name, df in tables.items()], base, dry_run)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as of a version."""
        found = self.journal() if version is None else self.journal().where(F.col("version") <= version)
        rows = found.select(F.explode("parts").alias("p")).where(F.col("p.table") == name).select("p.*").collect()
        if not rows:
            raise ValueError(f"no table {name}")
        parts = [Part(r.table, r.folder, r.schema, r.rows, r.digest, [(f.name, f.rows, f.sha256) for f in r.files]) for r in rows]
        return self._read(parts, T.StructType.fromJson(json.loads(parts[0].schema)))

    def broken(self) -> DataFrame:
        """(code, version, message): entries that do not continue the chain, and files that are gone or changed."""
        entries = self.journal()
        before = entries.select((F.col("version") + 1).alias("version"), F.col("entry_sha256").alias("expected"))
        chain = entries.join(before, "version", "left").where(F.coalesce("expected", F.lit("")) != F.col("parent_sha256")) \
            .select(F.lit("journal_chain_broken").alias("code"), "version", F.col("transaction_id").alias("message"))
        files = entries.select("version", F.explode("parts").alias("p")).select("version", "p.folder", F.explode("p.files").alias("f")) \
            .select("version", F.concat_ws("/", "folder", "f.name").alias("uri"), "f.sha256")

        def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                codes = []
                for uri, sha in zip(frame["uri"], frame["sha256"]):
                    system, path = fs.FileSystem.from_uri(uri)
                    gone = system.get_file_info(path).type == fs.FileType.NotFound
                    codes.append("file_missing" if gone else None if file_sha256(system, path) == sha else "file_changed")
                yield frame.assign(code=codes)[["code", "version", "uri"]].rename(columns={"uri": "message"})

        return chain.unionByName(files.mapInPandas(check, "code string, version long, message string").where("code is not null"))

    def vacuum(self, older_than_s: float = 86_400) -> int:
        """Delete staged folders that no entry names and that nobody has touched for a time; how many."""
        named = {os.path.basename(r.folder) for r in self.journal().select(F.explode("parts.folder").alias("folder")).toLocalIterator()}
        system, path = fs.FileSystem.from_uri(f"{self.root}/data")
        gone = 0
        for table in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            for x in system.get_file_info(fs.FileSelector(table.path)):
                if x.base_name not in named and (x.mtime_ns or 0) / 1e9 < time.time() - older_than_s:
                    system.delete_dir(x.path)
                    gone += 1
        return gone
