"""WARC archives: a writer on DataFrame functions and a Python data source that reads them.

Records are written by Spark's text writer with the record separator as line separator, so archives get Spark's
commit protocol and any Hadoop file system; payloads may be any bytes. The reader plans one partition a file (or a
few small files), takes record-type and header predicates down to the file, parses a record's header first, and
passes over the payload of a record that the predicates reject or whose payload is not asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not, StringContains, StringStartsWith

from quantloom.llm.base import checked, file_system, prepare, qualified

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, content_length bigint, payload_digest string, refers_to string, headers map<string,string>, payload binary"
#: Columns that are one header each.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Small files are read together up to this many bytes a partition.
PARTITION_BYTES = 64 << 20
_BATCH_BYTES = 16 << 20
_SKIP = 1 << 20


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  the value is computed once
    digit = lambda bits, k: F.substring(F.lit(_BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    eight = lambda bits: F.concat(*(digit(bits, k) for k in range(8)))
    # 40 bits are ten hex digits, or eight base32 digits
    return once(F.sha1(data), lambda h: F.concat(*(once(F.conv(F.substring(h, at, 10), 16, 10).cast("bigint"), eight) for at in (1, 11, 21, 31))))


def with_revisits(rows: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``rows`` with payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least ``least_bytes`` the ones of the largest id are responses and the others
    revisits of it. Null payloads are empty. Rows of a null id are responses unless their payload also has an id; rows
    that repeat the largest id are all responses. Equal payloads are found on (length, SHA-1) with partial counts, so a
    large group costs each task one row; only payloads that occur twice are joined back, by broadcast if their
    counted number is small.
    """
    prepare(rows.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    sized = rows.withColumn("__payload", payload).withColumn("payload_bytes", F.octet_length("__payload").cast("bigint")).withColumn("payload_digest", sha1_base32(F.col("__payload")))
    groups = sized.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_bytes", "payload_digest").agg(F.count("*").alias("n"), F.max(id_col).alias("__keeper"))
    again, _, fits = checked(groups.where("n > 1").select(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"), "__keeper"), 120)
    again = F.broadcast(again) if fits else again
    found = sized.join(again, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes")), "left")
    revisit = F.col("__keeper").isNotNull() & ~F.coalesce(F.col(id_col) == F.col("__keeper"), F.lit(False))
    return (
        found.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("__keeper")))
        .drop("__digest", "__bytes", "__keeper")
    )


def write(rows: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", compression: str = "none") -> None:
    """Write the rows of with_revisits() as WARC 1.1 records under ``path``, one archive a task.

    A revisit has no payload block. The id of the row and the length of the whole payload are headers of their own;
    line ends in urls become spaces, a null url is left out.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    uuid = lambda value: F.concat(F.lit("<urn:row:"), value.cast("string"), F.lit(">"))
    response = F.col("record_type") == "response"
    block = F.when(response, F.col("__payload")).otherwise(F.lit("").cast("binary"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uuid(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(F.col(url_col), r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Refers-To", uuid(F.col("refers_to"))),
        line("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), block).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", _END).option("compression", compression).mode("error").text(path)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def records(stream: io.BufferedIOBase, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records of an uncompressed stream that ``wanted(headers)`` accepts. The payloads of
    the others are passed over unread; so are all, with ``payload`` false."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        left = int(headers.get("content-length", 0))
        if wanted(headers):
            body = stream.read(left) if payload else None
            if not payload:
                _pass(stream, left)
            yield headers, body
        else:
            _pass(stream, left)


def _pass(stream, n: int) -> None:
    if stream.seekable():
        stream.seek(n, io.SEEK_CUR)
    else:
        while n > 0:
            n -= len(stream.read(min(n, _SKIP))) or n


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.columns = HEADERS | extra_columns(options)
        self.tests: list[tuple[str, bool, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take equality, membership, prefix, substring and not-null tests of header columns, and their negations; return
        the others."""
        for f in filters:
            test = f.child if isinstance(f, Not) else f
            key = self.columns.get(test.attribute[0]) if hasattr(test, "attribute") and len(test.attribute) == 1 else None
            how = {EqualTo: "in", In: "in", StringStartsWith: "starts", StringContains: "contains", IsNotNull: "there"}.get(type(test))
            if key and how and not (how == "there" and test is not f):
                value = getattr(test, "value", None)
                self.tests.append((key, test is f, how, tuple(value) if isinstance(test, In) else (value,)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        """Whether a record passes all tests taken; a test of a header that isn't there is never passed, as in SQL."""
        for key, yes, how, values in self.tests:
            x = headers.get(key)
            if x is None:
                return False
            found = how == "there" or x in values if how in ("in", "there") else x.startswith(values[0]) if how == "starts" else values[0] in x
            if found != yes:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        found: list[tuple[str, int]] = []
        for uri in self.path.split(","):
            system, path = file_system(uri)
            info = system.get_file_info(path)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(uri)
            infos = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
            prefix = uri[: uri.index(path)] if path in uri else ""
            found += [(prefix + i.path, i.size) for i in infos if i.is_file and i.size and not i.base_name.startswith(("_", "."))]
        parts, room = [], 0
        for path, n in sorted(found):
            if room >= n and parts:
                parts[-1].paths.append(path)
                room -= n
            else:
                parts.append(Files([path]))
                room = PARTITION_BYTES - n
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for uri in partition.paths:
            system, path = file_system(uri)
            with system.open_input_file(path) as raw:
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = gzip.GzipFile(fileobj=raw) if zipped else io.BufferedReader(raw, 1 << 20)
                if zipped:
                    stream.seekable = lambda: False
                for headers, body in records(stream, self.wanted, self.payload):
                    rows.append((headers, body))
                    held += len(body or b"") + 500
                    if held >= _BATCH_BYTES:
                        yield _batch(rows, self.columns)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, self.columns)


def extra_columns(options: dict[str, str]) -> dict[str, str]:
    """Column and header of the further headers that the option ``headers`` names, separated by commas."""
    names = [h.strip().lower() for h in options.get("headers", "").split(",") if h.strip()]
    return {h.replace("-", "_"): h for h in names}


def _batch(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    column = {name: pa.array([h.get(key) for h, _ in rows], pa.string()) for name, key in columns.items()}
    column["content_length"] = pa.array([int(h.get("content-length", 0)) for h, _ in rows], pa.int64())
    column["headers"] = pa.array([list(h.items()) for h, _ in rows], pa.map_(pa.string(), pa.string()))
    column["payload"] = pa.array([b for _, b in rows], pa.binary())
    names = [part.split()[0] for part in SCHEMA.split(", ")] + [n for n in columns if n not in HEADERS]
    return pa.RecordBatch.from_arrays([column[n] for n in names], names)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; option payload=false leaves payloads null and unread, option
    headers=a,b adds a column for each of these headers (hyphens become underscores), whose tests go down to the file
    like those of the fixed columns. Tests of ``headers[...]`` stay above the scan."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA + "".join(f", `{name}` string" for name in extra_columns(self.options))

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True, headers: tuple[str, ...] = ()) -> DataFrame:
    """The records under ``path``, an archive or a folder of them, plain or gzip. An empty folder gives no rows. Turns on
    the session's filter pushdown to Python sources, without which the source could take no test."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("headers", ",".join(headers)).load(qualified(spark, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives under ``path``.

    Responses are read with their payloads, whose length and digest are computed again and must be what the header
    says; revisits are read by header alone.
    """
    row = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:row:(.*)>$", 1), F.lit("null")).cast("bigint")
    said = F.regexp_replace("payload_digest", "^sha1:", "")
    full = read(spark, path).where(F.col("record_type") == "response")
    own = sha1_base32(F.col("payload"))
    bad = F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id"))
    full = full.select(row("record_id").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.when(own == said, own).otherwise(bad).alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    heads = read(spark, path, payload=False, headers=("x-payload-length",)).where(F.col("record_type") == "revisit")
    heads = heads.select(row("record_id").alias("page_id"), F.col("x_payload_length").cast("bigint").alias("payload_bytes"), said.alias("payload_digest"), "record_type", row("refers_to").alias("refers_to"))
    return full.unionByName(heads)
