"""File and table sources of prices, fundamentals and factor panels."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

# The input tables' column names.
PRICE_COLUMNS = ("symbol", "market", "observed_at", "open", "high", "low", "close", "volume")
FACT_COLUMNS = ("symbol", "market", "metric", "value", "observed_at", "period_role", "period_end", "period_type", "period_ref", "prior_period_ref", "snapshot_ref", "currency", "valuation_as_of", "vendor_field")


def _typed(df: DataFrame, wanted: tuple[str, ...], numbers: tuple[str, ...]) -> DataFrame:
    """The wanted columns that are there, numbers as doubles; times without a zone are an error."""
    have = {c.lower(): c for c in df.columns}
    out = df.select(*[F.col(have[c]).alias(c) for c in wanted if c in have])
    for c in numbers:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("double"))
    if dict(out.dtypes).get("observed_at") == "string":
        zoned = F.col("observed_at").rlike(r"(Z|[+-]\d\d:?\d\d)$")
        at = F.when(zoned, F.to_timestamp("observed_at")).otherwise(F.raise_error(F.concat(F.lit("time without a zone: "), F.coalesce("observed_at", F.lit("null")))).cast("timestamp"))
        out = out.withColumn("observed_at", at)
    return out


def csv_prices(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.option("header", True).csv(path), PRICE_COLUMNS, ("open", "high", "low", "close", "volume"))


def parquet_prices(spark: SparkSession, path: str) -> DataFrame:
    """Filters and columns reach the scan."""
    return _typed(spark.read.parquet(path), PRICE_COLUMNS, ("open", "high", "low", "close", "volume"))


def csv_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    out = _typed(spark.read.option("header", True).csv(path), FACT_COLUMNS, ("value",))
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    return out.withColumn("value", F.when(bad, F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(F.col("value")))


class _Sqlite(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "prices")
        self.columns = [c.strip() for c in options["columns"].split(",")]
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        where = " AND ".join(f'"{c}" = ?' for c, _ in self.tests) or "1"
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            cursor = db.execute(f'SELECT {", ".join(chr(34) + c + chr(34) if c in have else "NULL" for c in self.columns)} FROM "{self.table}" WHERE {where}', [v for _, v in self.tests])
            while rows := cursor.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array([None if r[i] is None else str(r[i]) for r in rows], pa.string()) for i in range(len(self.columns))], self.columns)


class SqliteSource(DataSource):
    """One table of a SQLite file; equality tests become its WHERE clause. The file must be where executors can read it."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"{c.strip()} string" for c in self.options["columns"].split(","))

    def reader(self, schema):
        return _Sqlite(self.options)


def sqlite_table(spark: SparkSession, path: str, table: str = "prices", columns: tuple[str, ...] = PRICE_COLUMNS, numbers: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return _typed(spark.read.format("sqlite").option("path", path).option("table", table).option("columns", ",".join(columns)).load(), columns, numbers)


def french_panel(lines: DataFrame, monthly: bool = False, columns: tuple[str, ...] = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF")) -> DataFrame:
    """(date, values map) of a factor file's text lines (column value): rows keyed by day or month, in percent; rows
    with a missing-value mark are left out."""
    digits = 6 if monthly else 8
    rows = lines.select(F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("p")).where(F.col("p")[0].rlike(f"^[0-9]{{{digits}}}$") & (F.size("p") == len(columns) + 1))
    numbers = F.transform(F.slice("p", 2, len(columns)), lambda x: x.try_cast("double"))
    ok = F.forall(numbers, lambda x: x.isNotNull() & ~x.isin(-99.99, -999.0))
    date = F.last_day(F.to_date(F.concat(F.col("p")[0], F.lit("01")), "yyyyMMdd")) if monthly else F.to_date(F.col("p")[0], "yyyyMMdd")
    return rows.where(ok).select(date.alias("date"), F.map_from_arrays(F.array(*map(F.lit, columns)), F.transform(numbers, lambda x: x / 100)).alias("values"))


def filings_of(submissions: DataFrame, most: int = 64) -> DataFrame:
    """(symbol, form, filing_date, accession, is_amendment) of JSON text with parallel arrays; the first ``most`` each."""
    said = F.from_json("content", "form array<string>, filingDate array<string>, accessionNumber array<string>")
    rows = submissions.select("symbol", said.alias("j")).select("symbol", F.posexplode(F.arrays_zip("j.form", "j.filingDate", "j.accessionNumber")).alias("pos", "z")).where(F.col("pos") < most)
    return rows.select("symbol", F.col("z.form").alias("form"), F.try_to_date("z.filingDate").alias("filing_date"), F.col("z.accessionNumber").alias("accession"), F.col("z.form").contains("/A").alias("is_amendment"))


def cik_map(content: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(symbol, cik) of the ticker list's JSON, ten digits; overrides win."""
    said = F.from_json("content", "map<string, struct<cik_str: bigint, ticker: string>>")
    rows = content.select(F.explode(F.map_values(said)).alias("v")).select(F.upper("v.ticker").alias("symbol"), F.lpad(F.col("v.cik_str").cast("string"), 10, "0").alias("cik"))
    if overrides is None:
        return rows
    own = overrides.select(F.upper("symbol").alias("symbol"), F.lpad("cik", 10, "0").alias("__own"))
    return rows.join(own, "symbol", "full_outer").select("symbol", F.coalesce("__own", "cik").alias("cik"))


def chart_bars(payloads: DataFrame) -> DataFrame:
    """(symbol, observed_at, open, high, low, close, volume) of stored chart JSON; rows without a close are left out."""
    arrays = "open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"
    said = F.from_json("content", f"timestamp array<bigint>, {arrays}")
    z = F.arrays_zip("j.timestamp", "j.open", "j.high", "j.low", "j.close", "j.volume")
    rows = payloads.select("symbol", said.alias("j")).select("symbol", F.explode(z).alias("z")).where("z.close is not null")
    return rows.select("symbol", F.timestamp_seconds("z.timestamp").alias("observed_at"), *[F.col(f"z.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
