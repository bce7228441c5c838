"""Queries of smaller joins, filters, samples and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.operators import evaluation as ev
from quantloom.plans import panels as P
from quantloom.plans.q_risk import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


@query("flt10_same_session", f"WITH {P.TICKS_SQL} SELECT symbol, count(*) AS n FROM (SELECT symbol, session, lead(session, 3) OVER (PARTITION BY symbol ORDER BY ts) AS ahead FROM ticks) WHERE session = ahead GROUP BY symbol")
def _flt10(spark, sf_dir):
    """Bars whose third next bar lies in the same session."""
    rows = P.ticks(spark, sf_dir).withColumn("ahead", F.lead("session", 3).over(W.Window.partitionBy("symbol").orderBy("ts")))
    return rows.where("session = ahead").groupBy("symbol").agg(F.count("*").alias("n"))


@query("flt11_candidate_range", f"WITH {P.WALK_SQL}, i AS (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS idx, count(*) OVER (PARTITION BY symbol) AS n FROM walk) SELECT symbol, min(day) AS first, max(day) AS last, count(*) AS n FROM i WHERE idx >= 50 AND idx < n - 21 GROUP BY symbol")
def _flt11(spark, sf_dir):
    """Times after a warm-up that leave a whole horizon."""
    w = W.Window.partitionBy("symbol")
    rows = P.walk(spark, sf_dir).withColumns({"idx": F.row_number().over(w.orderBy("day")) - 1, "size": F.count("*").over(w)})
    return rows.where("idx >= 50 and idx < size - 21").groupBy("symbol").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n"))


@query("join11_eligible_times", f"WITH {P.WALK_SQL} SELECT a.symbol, count(*) AS n FROM walk a SEMI JOIN (SELECT day FROM walk WHERE symbol = 'ASIA') b USING (day) GROUP BY a.symbol")
def _join11(spark, sf_dir):
    rows = P.walk(spark, sf_dir)
    return rows.join(rows.where("symbol = 'ASIA'").select("day"), "day", "left_semi").groupBy("symbol").agg(F.count("*").alias("n"))


@query("join21_cash_subtraction", f"WITH {P.RETURNS_SQL}, c AS (SELECT start_date, end_date, abs(value) / 10 AS rf FROM rets WHERE symbol = 'AFRICA') SELECT symbol, end_date, round(value - rf, 6) AS excess FROM rets JOIN c USING (start_date, end_date) WHERE symbol <> 'AFRICA'")
def _join21(spark, sf_dir):
    rows = P.returns(spark, sf_dir)
    cash = rows.where("symbol = 'AFRICA'").select("start_date", "end_date", (F.abs("value") / 10).alias("rf"))
    return rounded(rows.where("symbol <> 'AFRICA'").join(cash, ["start_date", "end_date"]).select("symbol", "end_date", (F.col("value") - F.col("rf")).alias("excess")))


@query("join17_period_intersection", f"WITH {P.RETURNS_SQL} SELECT a.end_date, round(a.value, 6) AS a, round(b.value, 6) AS b FROM rets a JOIN rets b USING (start_date, end_date) WHERE a.symbol = 'ASIA' AND b.symbol = 'AFRICA'")
def _join17(spark, sf_dir):
    rows = P.returns(spark, sf_dir)
    side = lambda s, n: rows.where(F.col("symbol") == s).select("start_date", "end_date", F.col("value").alias(n))
    return rounded(side("ASIA", "a").join(side("AFRICA", "b"), ["start_date", "end_date"]).select("end_date", "a", "b"))


@query("agg26_segments", f"WITH {P.RETURNS_SQL} SELECT symbol, CASE WHEN end_date < DATE '1996-01-01' THEN 'development' ELSE 'holdout' END AS segment, count(*) AS n, round(avg(value), 6) AS mean FROM rets WHERE NOT (start_date < DATE '1996-01-01' AND end_date >= DATE '1996-01-01') GROUP BY ALL")
def _agg26(spark, sf_dir):
    """Intervals before and after a boundary; the ones across it are purged."""
    rows = P.returns(spark, sf_dir).where("not (start_date < DATE '1996-01-01' and end_date >= DATE '1996-01-01')")
    segment = F.when(F.col("end_date") < "1996-01-01", "development").otherwise("holdout")
    return rounded(rows.groupBy("symbol", segment.alias("segment")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("agg27_deployed_capital", f"WITH {P.WALK_SQL}, i AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS bar, close FROM walk), d AS (SELECT symbol, bar, close AS delta FROM i WHERE bar % 50 = 0 UNION ALL SELECT symbol, bar + 30, -close FROM i WHERE bar % 50 = 0), s AS (SELECT symbol, bar, sum(delta) AS delta FROM d GROUP BY ALL), r AS (SELECT symbol, bar, sum(delta) OVER (PARTITION BY symbol ORDER BY bar) AS held FROM s) SELECT symbol, round(max(held), 4) AS max_deployed, count(*) AS changes FROM r GROUP BY symbol")
def _agg27(spark, sf_dir):
    """Capital held over time from entries and exits: running sums of their differences."""
    rows = P.walk(spark, sf_dir).select("symbol", (F.row_number().over(W.Window.partitionBy("symbol").orderBy("day")) - 1).alias("bar"), "close").where("bar % 50 = 0")
    deltas = rows.select("symbol", "bar", F.col("close").alias("delta")).union(rows.select("symbol", F.col("bar") + 30, -F.col("close"))).groupBy("symbol", "bar").agg(F.sum("delta").alias("delta"))
    held = deltas.withColumn("held", F.sum("delta").over(W.Window.partitionBy("symbol").orderBy("bar")))
    return rounded(held.groupBy("symbol").agg(F.max("held").alias("max_deployed"), F.count("*").alias("changes")), 4)


@query("srt06_bucketed_curve", f"WITH {P.WALK_SQL}, i AS (SELECT symbol, day, close, (row_number() OVER (PARTITION BY symbol ORDER BY day) - 1) // 50 AS b FROM walk) SELECT symbol, b::INT AS bucket, arg_max(day, {{'c': close, 'd': -epoch(day)}}) AS peak_day, round(max(close), 6) AS peak FROM i GROUP BY symbol, b")
def _srt06(spark, sf_dir):
    """The highest point of each bucket of 50, the first of equal ones."""
    rows = P.walk(spark, sf_dir).withColumn("bucket", F.floor((F.row_number().over(W.Window.partitionBy("symbol").orderBy("day")) - 1) / 50).cast("int"))
    first = F.struct("close", -F.unix_date("day"))
    return rounded(rows.groupBy("symbol", "bucket").agg(F.max_by("day", first).alias("peak_day"), F.max("close").alias("peak")))


@query("srt01_ordered_series", f"WITH {P.WALK_SQL} SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day)::INT AS position FROM walk")
def _srt01(spark, sf_dir):
    return P.walk(spark, sf_dir).select("symbol", "day", F.row_number().over(W.Window.partitionBy("symbol").orderBy("day")).alias("position"))


@query("srt03_latest_events", f"WITH {P.WALK_SQL} SELECT symbol, day FROM (SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM walk WHERE close > 90) WHERE r <= 10")
def _srt03(spark, sf_dir):
    w = W.Window.partitionBy("symbol").orderBy(F.col("day").desc())
    return P.walk(spark, sf_dir).where("close > 90").withColumn("r", F.row_number().over(w)).where("r <= 10").select("symbol", "day")


@query("fn10_clamped_scores", f"WITH {P.RETURNS_SQL} SELECT symbol, end_date, round((greatest(-0.5, least(0.5, value * 20)) + 0.5) * 100, 4) AS momentum, round(greatest(0, least(1, (value * 20 + 0.2) / 0.4)) * 100, 4) AS strength FROM rets")
def _fn10(spark, sf_dir):
    v = F.col("value") * 20
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    return rounded(P.returns(spark, sf_dir).select("symbol", "end_date", ((clamp(v, -0.5, 0.5) + 0.5) * 100).alias("momentum"), (clamp((v + 0.2) / 0.4, 0.0, 1.0) * 100).alias("strength")), 4)


@query("fn12_barrier_prices", f"WITH {P.WALK_SQL} SELECT symbol, day, round(close * 1.05, 4) AS long_target, round(close * 0.95, 4) AS short_target FROM walk")
def _fn12(spark, sf_dir):
    price = lambda side: ev.barrier_value(F.col("close"), F.lit(0.05), F.lit(side))
    return rounded(P.walk(spark, sf_dir).select("symbol", "day", price("long").alias("long_target"), price("short").alias("short_target")), 4)


@query("fn07_iso_week", "SELECT o_orderkey, isoyear(o_orderdate)::INT AS iso_year, weekofyear(o_orderdate)::INT AS iso_week FROM orders")
def _fn07(spark, sf_dir):
    return P.table(spark, sf_dir, "orders").select("o_orderkey", F.expr("extract(YEAROFWEEK FROM o_orderdate)").alias("iso_year"), F.weekofyear("o_orderdate").alias("iso_week"))


@query("win37_contiguity", f"WITH {P.WALK_SQL}, m AS (SELECT DISTINCT symbol, last_day(day) AS month FROM walk), c AS (SELECT symbol, month, lag(month) OVER (PARTITION BY symbol ORDER BY month) AS was FROM m) SELECT symbol, bool_and(was IS NULL OR last_day((was + INTERVAL 1 MONTH)::DATE) = month) AS contiguous FROM c GROUP BY symbol")
def _win37(spark, sf_dir):
    months = P.walk(spark, sf_dir).select("symbol", F.last_day("day").alias("month")).distinct()
    was = F.lag("month").over(W.Window.partitionBy("symbol").orderBy("month"))
    return months.select("symbol", (was.isNull() | (F.last_day(F.add_months(was, 1)) == F.col("month"))).alias("ok")).groupBy("symbol").agg(F.bool_and("ok").alias("contiguous"))
