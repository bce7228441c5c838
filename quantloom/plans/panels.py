"""The driver's tables as the library's panels: bars, close-only walks, interval returns, ticks, facts and filings.

Each panel is a DataFrame over many instruments, and SQL text of the same definition for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the region, nation and brand of its row; the dimensions are small and joined as their size allows."""
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = place.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name", "n_name")
    return table(spark, sf_dir, "lineitem").join(place, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("day", F.to_date("l_shipdate"))


_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each region: (symbol, day, open, high, low, close, volume)."""
    key = F.struct(*_KEY)
    price = F.col("l_extendedprice")
    return _located(spark, sf_dir).groupBy(F.col("r_name").alias("symbol"), "day").agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("l_quantity").alias("volume")
    )


def _walk(rows: DataFrame, symbol: str) -> DataFrame:
    daily = rows.groupBy(F.col(symbol).alias("symbol"), "day").agg(F.round(F.avg("l_discount") - 0.05, 10).alias("ret"))
    by = W.Window.partitionBy("symbol").orderBy("day").rowsBetween(W.Window.unboundedPreceding, 0)
    return daily.select("symbol", "day", F.round(100 * F.exp(F.sum(F.ln(1 + F.col("ret"))).over(by)), 8).alias("close"))


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A close-only series of each region with realistic daily moves: (symbol, day, close)."""
    return _walk(_located(spark, sf_dir), "r_name")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each nation, with its region: (symbol, day, close, region)."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("region"))
    return _walk(_located(spark, sf_dir), "n_name").join(place, "symbol")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval returns of walk(): (symbol, start_date, end_date, value)."""
    by = W.Window.partitionBy("symbol").orderBy("day")
    rows = walk(spark, sf_dir).select("symbol", F.lag("day").over(by).alias("start_date"), F.col("day").alias("end_date"), F.round(F.col("close") / F.lag("close").over(by) - 1, 10).alias("value"))
    return rows.where("start_date is not null")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars of each event type: (symbol, ts, session, open, high, low, close); the session is New York's date."""
    rows = table(spark, sf_dir, "events").where("value > 0").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / 1800) * 1800)
    key = F.struct("at", "event_id")
    made = rows.groupBy(F.col("event_type").alias("symbol"), bucket.alias("ts")).agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"))
    return made.withColumn("session", F.to_date(F.from_utc_timestamp("ts", "America/New_York")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly facts of each nation, long: (symbol, metric, period_role, value, period_end, currency, period_type, period_ref,
    prior_period_ref, snapshot_ref, valuation_as_of, observed_at)."""
    place = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = table(spark, sf_dir, "orders").join(place, F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    yearly = rows.groupBy(F.col("n_name").alias("symbol"), year.alias("y")).agg(
        F.sum(price).alias("revenue"), F.sum(F.when(status == "F", price)).alias("net_income"), F.sum(F.when(status == "O", price)).alias("operating_income"),
        F.max(price).alias("equity"), F.avg(price).alias("total_debt"), F.count("*").cast("double").alias("market_cap"),
    )
    latest = yearly.groupBy("symbol").agg((F.max("y") - 1).alias("last"))
    two = yearly.join(latest, "symbol").where("y in (last, last - 1)").withColumn("period_role", F.when(F.col("y") == F.col("last"), "current").otherwise("prior"))
    names = ("revenue", "net_income", "operating_income", "equity", "total_debt", "market_cap")
    stack = ", ".join(f"'{n}', {n}" for n in names)
    keys = ["'annual' as period_type", "cast(y as string) as period_ref", "if(period_role = 'current', cast(y - 1 as string), null) as prior_period_ref", "'s1' as snapshot_ref", "make_date(y + 1, 1, 31) as valuation_as_of", "make_date(y + 1, 2, 28) as observed_at"]
    return two.selectExpr("symbol", "period_role", "make_date(y, 12, 31) as period_end", "'USD' as currency", *keys, f"stack({len(names)}, {stack}) as (metric, value)").where("value is not null")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts() of which some don't match the others: by the last digit of the nation the net income is of another
    snapshot (0, 1), the equity of another currency (2, 3), the prior period another one (4, 5), or the market
    value as of a day before the period's end (6, 7) or after its observation (8)."""
    rows = facts(spark, sf_dir)
    last = F.right("symbol", F.lit(1))
    other = lambda column, metric, letters, value: F.when(last.isin(*letters) & (F.col("metric") == metric), value).otherwise(F.col(column))
    rows = rows.withColumn("snapshot_ref", other("snapshot_ref", "net_income", "01", F.lit("s2"))).withColumn("currency", other("currency", "equity", "23", F.lit("EUR")))
    rows = rows.withColumn("prior_period_ref", F.when(last.isin(*"45"), F.lit("1900")).otherwise(F.col("prior_period_ref")))
    return rows.withColumn("valuation_as_of", F.when(last.isin(*"67"), F.date_sub("period_end", 1)).when(last.isin(*"8"), F.date_add("observed_at", 1)).otherwise(F.col("valuation_as_of")))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of each customer: (symbol, form, filing_date)."""
    form = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), form[F.col("o_orderpriority")].alias("form"), F.to_date("o_orderdate").alias("filing_date"))


#: Filing forms that the order priorities stand for.
FORMS = {"1-URGENT": "8-K", "2-HIGH": "10-Q", "3-MEDIUM": "10-K", "4-NOT SPECIFIED": "8-K/A", "5-LOW": "10-Q/A"}

_LOCATED_SQL = """located AS (
  SELECT l.*, r_name, n_name, CAST(l_shipdate AS DATE) AS day FROM lineitem l
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

BARS_SQL = _LOCATED_SQL + """, keyed AS (
  SELECT r_name, day, l_extendedprice AS p, l_quantity AS q, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM located
), bars AS (
  SELECT r_name AS symbol, day, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(q) AS volume FROM keyed GROUP BY ALL
)"""


def _walk_sql(name: str, column: str) -> str:
    return f"""{name}_r AS (
  SELECT {column} AS symbol, day, round(avg(l_discount) - 0.05, 10) AS ret FROM located GROUP BY ALL
), {name} AS (
  SELECT symbol, day, round(100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY day)), 8) AS close FROM {name}_r
)"""


WALK_SQL = _LOCATED_SQL + ", " + _walk_sql("walk", "r_name")
UNIVERSE_SQL = _LOCATED_SQL + ", " + _walk_sql("uni", "n_name") + """, universe AS (
  SELECT u.*, r_name AS region FROM uni u JOIN nation ON u.symbol = n_name JOIN region ON n_regionkey = r_regionkey
)"""
RETURNS_SQL = WALK_SQL + """, rets AS (
  SELECT * FROM (
    SELECT symbol, lag(day) OVER w AS start_date, day AS end_date, round(close / lag(close) OVER w - 1, 10) AS value FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY day)
  ) WHERE start_date IS NOT NULL
)"""
TICKS_SQL = """raw AS (
  SELECT event_type AS symbol, to_timestamp(floor(epoch(ts) / 1800) * 1800) AS ts, value, ROW(ts, event_id) AS k FROM events WHERE value > 0
), ticks AS (
  SELECT symbol, ts, arg_min(value, k) AS open, max(value) AS high, min(value) AS low, arg_max(value, k) AS close,
    CAST(timezone('America/New_York', ts) AS DATE) AS session FROM raw GROUP BY symbol, ts
)"""
FACTS_SQL = """yearly AS (
  SELECT n_name AS symbol, year(o_orderdate) AS y, sum(o_totalprice) AS revenue, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS net_income,
    sum(o_totalprice) FILTER (o_orderstatus = 'O') AS operating_income, max(o_totalprice) AS equity, avg(o_totalprice) AS total_debt, count(*)::DOUBLE AS market_cap
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
), latest AS (
  SELECT symbol, max(y) - 1 AS last FROM yearly GROUP BY symbol
), two AS (
  SELECT y.*, CASE WHEN y.y = l.last THEN 'current' ELSE 'prior' END AS period_role FROM yearly y JOIN latest l USING (symbol) WHERE y.y IN (l.last, l.last - 1)
), facts AS (
  SELECT symbol, period_role, y, make_date(y, 12, 31) AS period_end, 'USD' AS currency, metric, value
  FROM (UNPIVOT two ON revenue, net_income, operating_income, equity, total_debt, market_cap INTO NAME metric VALUE value)
)"""
FILINGS_SQL = """filings AS (
  SELECT o_custkey AS symbol, CASE o_orderpriority """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMS.items()) + """ END AS form, CAST(o_orderdate AS DATE) AS filing_date FROM orders
)"""
