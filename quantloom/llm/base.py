"""What the operators of this subpackage share: inputs, the shared folder, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` separates at exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes up to which a table may be broadcast; beyond either, the same join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20

#: Bytes of an Arrow batch that a Python worker gets at once.
BATCH_BYTES = 8 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """The checkpoint folder that the session names; in local mode, where one process does all, else a temporary one. Also
    bounds the session's Arrow batches to BATCH_BYTES, because 10,000 whole texts may be much more."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864").rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.sparkContext.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantloom-"))


_WORKER: dict[tuple, object] = {}


def kept_by_worker(key: tuple, make):
    """``make()``, kept by this Python worker for its next tasks of the same ``key``; what it kept for another goes."""
    if key not in _WORKER:
        forget()
        _WORKER[key] = make()
    return _WORKER[key]


def forget() -> None:
    """Frees what tasks of other operators have left in this Python worker, which Spark uses again."""
    _WORKER.clear()


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the driver and all executors share, with its file system's name."""
    prepare(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{qualified(spark, root).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as the cluster's default file system has it, so that executors don't take it for their own disks'."""
    system, at = _hadoop(spark, path)
    return str(system.makeQualified(at))


def list_files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Files of a folder in order, with their file system's name."""
    system, at = _hadoop(spark, folder)
    names = [str(s.getPath()) for s in system.listStatus(at)] if system.exists(at) else []
    return sorted(n for n in names if n.endswith(ending))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """What opens a path that names its file system."""
    if re.match(r"file:/+", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if "://" not in uri:
        raise ValueError(f"a path without its file system: {uri}")
    return pafs.FileSystem.from_uri(uri)


def checked(df: DataFrame, row_bytes: int = 64) -> tuple[DataFrame, int, bool]:
    """``df`` after a checkpoint, its row count, and whether it is small enough to broadcast."""
    prepare(df.sparkSession)
    kept = df.checkpoint()
    n = kept.count()
    return kept, n, n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df`` checkpointed, with a broadcast hint only if its counted size is within the bound."""
    kept, _, fits = checked(df, row_bytes)
    return F.broadcast(kept) if fits else kept


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the input: file sizes for scans. Only sizes buckets, never selects rows.

    An estimate of a join is a product, so it counts no more than the tables below it. Rows that don't come from a table
    have no estimate (Spark then takes the largest long); the bytes of their texts are summed in a pass.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) >= df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes():
        texts = [i for i, f in enumerate(df.schema) if f.dataType.typeName() in ("string", "binary")]
        plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        each = sum((F.coalesce(F.octet_length(f"c{i}"), F.lit(0)).cast("bigint") for i in texts), F.lit(8 * len(df.columns)).cast("bigint"))
        return plain.agg(F.sum(each)).first()[0] or 0
    return min(int(str(plan.stats().sizeInBytes())), sum(sizes))


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 32, most: int = 1 << 20) -> int:
    """How many hash buckets keep each bucket of a shuffle of ``df``'s text near ``bytes_each``."""
    return max(least, min(most, input_bytes(df) // bytes_each + 1))


def ascii_lower(text):
    """A-Z lower-cased, all other characters unchanged."""
    return F.translate(text, UPPER, UPPER.lower())
