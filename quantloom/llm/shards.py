"""Size-tiered compaction of immutable Parquet shards under a versioned manifest.

Arrivals are appended as small shards as they come. A shard's tier is the power of FANOUT that its size has reached;
a tier with FANOUT shards or more is merged into shards near the target size. Shards are never changed. A version of the
table is a manifest file that lists its shards; a commit gives the next version's file its name, which fails if another
writer has done so first: by a hard link on local and mounted disks, by a rename on HDFS and views of it. Other file
systems may replace an existing file, so a store refuses them. Readers use one manifest throughout; shards that no kept
version lists are removed once they are old enough not to belong to an append that is still under way.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.llm.base import file_system, prepare, qualified

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 1 << 20
FANOUT = 4
#: Seconds that a data file no version lists is left alone; an append must commit within them.
LEASE_SECONDS = 24 * 3600
#: File systems that never replace a file by a link or a rename.
SAFE_SYSTEMS = ("file", "hdfs", "viewfs")


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str = ""
    shards: tuple[Shard, ...] = field(default_factory=tuple)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A table of shards under ``root``, a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, smallest_bytes: int = SMALLEST_BYTES, fanout: int = FANOUT):
        prepare(spark)
        self.spark, self.root = spark, qualified(spark, root).rstrip("/")
        self.scheme = self.root.split(":")[0]
        if self.scheme not in SAFE_SYSTEMS:
            raise ValueError(f"a store needs a file system that refuses to replace files, one of {SAFE_SYSTEMS}: {root}")
        self.target, self.smallest, self.fanout = target_bytes, smallest_bytes, fanout
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _file(self, version: int) -> str:
        return f"{self.root}/_manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest:
        """That version, or the latest; version 0 is the empty table."""
        found = self.versions()
        version = version if version is not None else (found[-1] if found else 0)
        if not version:
            return Manifest()
        stream = self._fs.open(self._path(self._file(version)))
        try:
            said = json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(said["version"], said["schema"], tuple(Shard(**s) for s in said["shards"]))

    def commit(self, before: Manifest, schema: str, add: list[Shard], remove: set[str] = frozenset()) -> Manifest:
        """The next version: written aside, then given a name that must not exist yet."""
        after = Manifest(before.version + 1, schema, tuple(s for s in before.shards if s.path not in remove) + tuple(add))
        aside = self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        try:
            stream.write(json.dumps(asdict(after)).encode())
        finally:
            stream.close()
        try:
            if self.scheme == "file":
                os.link(file_system(str(aside))[1], file_system(self._file(after.version))[1])
            elif not self._fs.rename(aside, self._path(self._file(after.version))):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(str(after.version)) from None
        finally:
            self._fs.delete(aside, False)
        return after

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return [Shard(str(s.getPath()), int(s.getLen())) for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]

    def append(self, df: DataFrame) -> Manifest:
        """Add the rows of ``df`` as shards, one for each of its partitions. Nothing is seen of them before the commit.
        Names and types of the columns must be the table's."""
        fields = lambda schema: [(f["name"], f["type"]) for f in json.loads(schema)["fields"]]
        shards = self._write(df)
        while True:
            before = self.manifest()
            schema = df.schema.json()
            if before.schema and fields(schema) != fields(before.schema):
                raise ValueError("the columns differ from the table's")
            try:
                return self.commit(before, before.schema or schema, shards)
            except Conflict:
                continue

    def tier(self, shard: Shard) -> int:
        return max(0, int(math.log(max(shard.size, 1) / self.smallest, self.fanout)) + 1) if shard.size >= self.smallest else 0

    def plan(self, manifest: Manifest) -> list[list[Shard]]:
        """Runs to merge: the shards of each tier that has enough of them, if smaller than the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.shards:
            if s.size < self.target * 3 // 4:
                tiers.setdefault(self.tier(s), []).append(s)
        return [sorted(run, key=lambda s: (-s.size, s.path)) for _, run in sorted(tiers.items()) if len(run) >= self.fanout]

    def compact(self) -> Manifest:
        """Merge what plan() names, smallest tier first, until it names nothing.

        The files of a run are packed into read partitions of the target size, and each partition is written as one
        shard, so no rows are shuffled. A run that would not give fewer shards is left as it is. If another writer commits
        meanwhile, the merged shards are committed after it, unless it has merged some of the run itself.
        """
        done: set[frozenset] = set()
        while True:
            now = self.manifest()
            runs = [r for r in self.plan(now) if frozenset(s.path for s in r) not in done]
            if not runs:
                return now
            run = runs[0]
            own = frozenset(s.path for s in run)
            merged = self._write(self._packed(run))
            while len(merged) < len(run) and own <= {s.path for s in now.shards}:
                try:
                    self.commit(now, now.schema, merged, set(own))
                    break
                except Conflict:
                    now = self.manifest()
            else:
                done.add(own)

    def _packed(self, run: list[Shard]) -> DataFrame:
        own = self.spark.newSession()
        own.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        own.conf.set("spark.sql.files.openCostInBytes", "0")
        own.conf.set("spark.sql.files.minPartitionNum", "1")
        return own.read.parquet(*[s.path for s in run])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; of the empty table, none and no columns."""
        now = self.manifest(version)
        schema = StructType.fromJson(json.loads(now.schema)) if now.schema else StructType()
        if not now.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in now.shards])

    def vacuum(self, keep: int = 1, lease: float = LEASE_SECONDS) -> int:
        """Remove the manifests before the last ``keep`` versions, and the data files older than ``lease`` seconds that the
        kept ones don't list; younger ones may be those of an append that hasn't committed yet."""
        before = (time.time() - lease) * 1000
        versions = self.versions()
        kept = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._file(v)), False)
        gone = 0
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for f in self._fs.listStatus(folder.getPath()):
                if str(f.getPath()) not in kept and f.getModificationTime() <= before:
                    self._fs.delete(f.getPath(), False)
                    gone += 1
        return gone


def arrivals(docs: DataFrame, id_col: str, n: int) -> list[DataFrame]:
    """``docs`` dealt by a hash of the id into ``n`` arrivals; together they are all rows, null ids included."""
    part = F.pmod(F.xxhash64(id_col), F.lit(n))
    return [docs.where(part == k) for k in range(n)]


def compacted(docs: DataFrame, root: str, id_col: str = "doc_id", batches: int = 3, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """A store of all rows of ``docs`` that came in ``batches`` arrivals, compacted and vacuumed after each, without a lease
    as nobody else knows of the new store. Null ids and texts, repeated rows and other columns are kept as they are; an
    empty table gives a store of no rows."""
    store = ShardStore(docs.sparkSession, root, target_bytes)
    for df in arrivals(docs, id_col, batches):
        store.append(df)
        store.compact()
        store.vacuum(lease=0)
    return store


def contents(store: ShardStore, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, text_sha256) of each row of the store's latest version; null texts have null figures."""
    rows = store.read()
    return rows.select(F.col(id_col).alias("doc_id"), F.octet_length(text_col).cast("bigint").alias("n_bytes"), F.sha2(F.col(text_col).cast("binary"), 256).alias("text_sha256"))
