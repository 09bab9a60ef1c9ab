"""Tables that change by commits: what a batch wrote is seen at once by later readers, or not at all.

A store is a folder with data and commits. A batch writes its rows as Parquet into folders of their own, under data/<table>/segment=<version>;
nobody reads them before a commit names them. A commit is one small JSON file, commits/<version>.json: the folders of every
table as of that version, totals that the writers keep, and the last batch of each writer. It is written beside its place and moved there,
which fails if the name is taken, so of two writers that start from the same version one gets a Conflict, and nothing of it is seen.
A batch that is tried again after its commit is recognised by its writer and number. A reader holds a snapshot, the
content of one commit, and sees the same rows until `vacuum` drops what no kept commit names.

The folder has to be one that driver and executors share. HDFS refuses to move a file onto another; where a file system does not,
as plain disks, the look before the move leaves a moment in which two writers could both succeed, so there one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string


#: Settings of Spark while a table is written: its shuffle files are dropped at the end, and Arrow batches are of 4 MB at most.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


class Conflict(Exception):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Snapshot:
    """version 0 is the empty store. parts: table -> its folders; totals: number by name; applied: writer -> last batch."""

    version: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    totals: dict[str, float] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._file(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names("commits") if x.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last commit, or the one of `version`."""
        known = self.versions()
        version = max(known, default=0) if version is None else version
        if version == 0:
            return Snapshot()
        if version not in known:
            raise ValueError(f"version {version} is not in the store")
        return Snapshot(**json.loads(self.spark.read.text(f"{self.root}/commits/{version:012d}.json", wholetext=True).first()[0]))

    def write(self, df: DataFrame, table: str, segment: int, partition_by: Sequence[str] = (), **options) -> str:
        """Writes rows of a batch for the version `segment`; returns the folder, which a commit has to name.

        The shuffle files go when the rows are written, and Python workers get small batches meanwhile.
        """
        path = f"{self.root}/data/{table}/segment={segment}/part={uuid.uuid4().hex}"
        before = {k: self.spark.conf.get(k) for k in WRITING}
        try:
            for k, v in WRITING.items():
                self.spark.conf.set(k, v)
            df.write.options(**options).partitionBy(*partition_by).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return path

    def part(self, path: str, table: str, schema: str) -> DataFrame:
        """The rows of one folder, without its segment."""
        return self.rows([path], table, schema).drop("segment")

    def rows(self, paths: Sequence[str], table: str, schema: str) -> DataFrame:
        """The rows of some folders of a table, with the version that wrote them in the column segment."""
        kind = _parse_datatype_string(f"{schema}, segment long, part string")
        assert isinstance(kind, StructType)
        if not paths:
            return self.spark.createDataFrame([], kind).drop("part")
        return self.spark.read.schema(kind).option("basePath", f"{self.root}/data/{table}").parquet(*paths).drop("part")

    def table(self, snapshot: Snapshot, table: str, schema: str) -> DataFrame:
        return self.rows(snapshot.parts.get(table, []), table, schema)

    def commit(self, base: Snapshot, add: dict[str, list[str]], replace: dict[str, list[str]] | None = None, totals: dict[str, float] | None = None, writer: str = "", batch: int = 0) -> Snapshot:
        """The version after base: folders of `add` come to those of their tables, those of `replace` take their place; totals are added."""
        parts = {k: [*(base.parts.get(k, []) if k not in (replace or {}) else []), *add.get(k, []), *(replace or {}).get(k, [])] for k in {*base.parts, *add, *(replace or {})}}
        sums = {k: base.totals.get(k, 0) + (totals or {}).get(k, 0) for k in {*base.totals, *(totals or {})}}
        after = Snapshot(base.version + 1, parts, sums, base.applied | ({writer: batch} if writer else {}))
        fs, at = self._file(f"{self.root}/commits/{after.version:012d}.json")
        fs.mkdirs(at.getParent())
        # the content is whole before the name is there: it is written beside it and moved, which fails if the name is taken
        _, draft = self._file(f"{self.root}/commits/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(after.__dict__).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise Conflict(f"version {after.version} was committed by another writer")
        return after

    def vacuum(self, keep: int = 1) -> int:
        """Drops all but the last `keep` commits, and data that none of these names; returns the number of folders dropped. No batch may be running."""
        known = self.versions()
        for v in known[:-keep]:
            fs, at = self._file(f"{self.root}/commits/{v:012d}.json")
            fs.delete(at, False)
        named = {p for v in known[-keep:] for folders in self.snapshot(v).parts.values() for p in folders}
        dropped = 0
        for table in self._names("data"):
            for segment in self._names(f"data/{table}"):
                for part in self._names(f"data/{table}/{segment}"):
                    if (path := f"{self.root}/data/{table}/{segment}/{part}") not in named:
                        fs, at = self._file(path)
                        fs.delete(at, True)
                        dropped += 1
        return dropped
