"""Queries of vendor payloads, source contracts, symbols, and of studies' panels and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import symbols
from quantloom.operators import contracts
from quantloom.operators.validation import return_violations
from quantloom.plans import panels as P
from quantloom.plans.q_risk import rounded
from quantloom.sources import payloads

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _series(rows, value: str = "close"):
    """Each symbol's days and values, in order, as arrays t (seconds at noon UTC) and v; every tenth day's value is null."""
    point = F.struct(F.unix_timestamp(F.col("day").cast("timestamp")).alias("t"), F.when(F.dayofmonth("day") != 10, F.col(value)).alias("v"))
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_list(point)).alias("z"))


def _chart(rows, identity, kind, zone, currency, indicators):
    meta = F.struct(identity.alias("symbol"), kind.alias("instrumentType"), F.lit(zone).alias("exchangeTimezoneName"), currency.alias("currency"))
    result = F.struct(meta.alias("meta"), F.transform("z.t", lambda t: t + 43200).alias("timestamp"), indicators.alias("indicators"))
    return F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})


@query("src12_adjusted_levels", f"WITH {P.WALK_SQL} SELECT symbol, CASE symbol WHEN 'ASIA' THEN 'GBP' ELSE 'USD' END AS currency, day AS date, CASE WHEN day(day) <> 10 THEN round(close, 6) END AS value FROM walk")
def _src12(spark, sf_dir):
    rows = _series(P.walk(spark, sf_dir))
    levels = F.struct(F.array(F.struct(F.col("z.v").alias("adjclose"))).alias("adjclose"))
    currency = F.when(F.col("symbol") == "ASIA", "GBp").otherwise("USD")
    return rounded(payloads.adjusted_levels(rows.select("symbol", _chart(rows, F.lower("symbol"), F.lit("ETF"), "Europe/London", currency, levels).alias("content"))))


@query("src13_fx_levels", f"WITH {P.WALK_SQL} SELECT CASE symbol WHEN 'ASIA' THEN 'EUR' WHEN 'EUROPE' THEN 'GBP' ELSE 'CHF' END AS base, 'USD' AS quote, day AS date, round(close, 6) AS value FROM walk WHERE symbol IN ('ASIA', 'EUROPE', 'AFRICA') AND day(day) <> 10")
def _src13(spark, sf_dir):
    base = F.when(F.col("symbol") == "ASIA", "EUR").when(F.col("symbol") == "EUROPE", "GBP").otherwise("CHF")
    rows = _series(P.walk(spark, sf_dir).where("symbol in ('ASIA', 'EUROPE', 'AFRICA')").withColumn("symbol", base))
    closes = F.struct(F.array(F.struct(F.col("z.v").alias("close"))).alias("quote"))
    return rounded(payloads.fx_levels(rows.select("symbol", _chart(rows, F.concat("symbol", F.lit("USD=X")), F.lit("CURRENCY"), "Europe/London", F.lit("USD"), closes).alias("content"))))


@query("src14_candles", f"WITH {P.BARS_SQL} SELECT symbol, strftime(day, '%Y-%m-%d') AS observed, open, high, low, close, volume::DOUBLE AS volume FROM bars")
def _src14(spark, sf_dir):
    point = F.array((F.unix_date("day") * 86_400_000.0).cast("double"), *[F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")])
    rows = P.bars(spark, sf_dir).groupBy("symbol").agg(F.to_json(F.collect_list(point)).alias("content"))
    return payloads.candles(rows).select("symbol", F.date_format("observed_at", "yyyy-MM-dd").alias("observed"), "open", "high", "low", "close", "volume")


_COMPANY = """o AS (SELECT n_name AS symbol, year(o_orderdate) AS fy, o_orderstatus AS s, sum(o_totalprice) AS val FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
m AS (SELECT symbol, s, max(fy) AS last FROM o GROUP BY ALL), r AS (SELECT o.symbol, o.s, o.fy, val, CASE WHEN fy = last THEN 'current' ELSE 'prior' END AS period_role FROM o JOIN m USING (symbol, s) WHERE fy IN (last, last - 1))"""


@query("src22_company_facts", f"""WITH {_COMPANY} SELECT symbol, CASE s WHEN 'F' THEN 'revenue' ELSE 'net_income' END AS metric, period_role, round(val, 2) AS value, make_date(fy, 12, 31) AS period_end FROM r WHERE s IN ('F', 'P')
UNION ALL SELECT symbol, 'free_cash_flow', period_role, round(val - abs(-2 * val), 2), make_date(fy, 12, 31) FROM r WHERE s = 'O'""")
def _src22(spark, sf_dir):
    place = P.table(spark, sf_dir, "customer").join(P.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    yearly = P.table(spark, sf_dir, "orders").join(place, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("n_name").alias("symbol"), F.year("o_orderdate").alias("fy"), "o_orderstatus").agg(F.sum("o_totalprice").alias("val"))
    concepts = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("Revenues"), F.lit(1.0)))).when(F.col("o_orderstatus") == "P", F.array(F.struct(F.lit("NetIncomeLoss"), F.lit(1.0))))
    both = F.array(F.struct(F.lit("NetCashProvidedByUsedInOperatingActivities"), F.lit(1.0)), F.struct(F.lit("PaymentsToAcquirePropertyPlantAndEquipment"), F.lit(-2.0)))
    rows = yearly.select("symbol", "fy", "val", F.explode(F.coalesce(concepts, both)).alias("c")).select("symbol", "fy", F.col("c.col1").alias("concept"), (F.col("val") * F.col("c.col2")).alias("val"))
    texts = [F.concat(F.col("fy").cast("string"), F.lit("-12-31")).alias("end"), "val", "fy", F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), F.concat((F.col("fy") + 1).cast("string"), F.lit("-02-01")).alias("filed"), F.lit("a").alias("accn")]
    per = rows.groupBy("symbol", "concept").agg(F.struct(F.create_map(F.lit("USD"), F.collect_list(F.struct(*texts))).alias("units")).alias("units"))
    content = per.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("concept", "units"))).alias("g"))
    return rounded(payloads.company_facts(content.select("symbol", F.to_json(F.struct(F.struct(F.col("g").alias("us-gaap")).alias("facts"))).alias("content"))), 2)


@query("src24_level_inspection", f"WITH {P.WALK_SQL} SELECT symbol, day, CASE WHEN day(day) <> 10 THEN round(close, 6) END AS close, CASE symbol WHEN 'ASIA' THEN 'stock' ELSE 'leg' END AS kind FROM walk WHERE symbol IN ('ASIA', 'EUROPE', 'AFRICA') AND day BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def _src24(spark, sf_dir):
    """Delivered levels of a stock and its legs, with their gaps."""
    rows = P.walk(spark, sf_dir).withColumn("close", F.when(F.dayofmonth("day") != 10, F.col("close")))
    day = lambda d: F.lit(d).cast("date")
    return rounded(contracts.inspected(rows.where("symbol = 'ASIA'"), rows.where("symbol in ('EUROPE', 'AFRICA')"), day("1995-01-01"), day("1995-12-31")))


_MARKETS = "CASE n_nationkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'LSE' WHEN 2 THEN 'SSE' WHEN 3 THEN 'XETRA' WHEN 4 THEN 'CRYPTO' ELSE 'OSLO' END"


@query("src25_vendor_symbols", f"""SELECT n_name AS symbol, m AS market, CASE m WHEN 'US' THEN n_name WHEN 'LSE' THEN n_name || '.L' WHEN 'SSE' THEN n_name || '.SS' WHEN 'XETRA' THEN n_name || '.DE' WHEN 'OSLO' THEN n_name || '.OL' END AS chart,
CASE m WHEN 'US' THEN n_name || ' US Equity' WHEN 'LSE' THEN n_name || ' LN Equity' WHEN 'SSE' THEN n_name || ' CH Equity' WHEN 'XETRA' THEN n_name || ' GY Equity' WHEN 'OSLO' THEN n_name || ' NO Equity' END AS terminal, CASE m WHEN 'CRYPTO' THEN n_name END AS exchange
FROM (SELECT n_name, {_MARKETS} AS m FROM nation)""")
def _src25(spark, sf_dir):
    rows = P.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), F.expr(_MARKETS).alias("market"))
    s, m = F.col("symbol"), F.col("market")
    return rows.select("symbol", "market", symbols.vendor_symbol("yahoo", s, m).alias("chart"), symbols.vendor_symbol("bloomberg", s, m).alias("terminal"), symbols.vendor_symbol("ccxt", s, m).alias("exchange"))


@query("src25_security_identifier", """SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN 'C' || c_custkey || '-B' END AS symbol, CASE c_custkey % 4 WHEN 0 THEN 'LSE' WHEN 1 THEN 'BME' WHEN 2 THEN 'SIX' END AS market,
CASE c_custkey % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CHF' END AS currency FROM customer""")
def _src25b(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("LN", "sm", "SW", "ZZ"))), F.col("c_custkey").cast("int") % 4 + 1)
    rows = P.table(spark, sf_dir, "customer").select("c_custkey", symbols.security(F.concat(F.lit(" c"), F.col("c_custkey").cast("string"), F.lit("/b "), code, F.lit(" Equity"))).alias("s"))
    return rows.select("c_custkey", "s.symbol", "s.market", "s.currency")


@query("fn03_benchmarks", f"""SELECT n_name, CASE m WHEN 'SSE' THEN 'CSI300,CSI500' WHEN 'LSE' THEN 'SXXP,SX5E' WHEN 'XETRA' THEN 'SXXP,SX5E' ELSE 'SPY,QQQ' END AS labels,
CASE m WHEN 'SSE' THEN '000300' WHEN 'LSE' THEN '^STOXX' WHEN 'XETRA' THEN '^STOXX' ELSE 'SPY' END AS symbol, CASE m WHEN 'SSE' THEN 'SSE' WHEN 'LSE' THEN 'INDEX' WHEN 'XETRA' THEN 'INDEX' ELSE 'US' END AS market FROM (SELECT n_name, {_MARKETS} AS m FROM nation)""")
def _fn03(spark, sf_dir):
    rows = P.table(spark, sf_dir, "nation").select("n_name", symbols.benchmarks(F.expr(_MARKETS)).alias("b"))
    return rows.select("n_name", F.array_join("b", ",").alias("labels"), symbols.benchmark_instrument(F.element_at("b", 1)).alias("i")).select("n_name", "labels", "i.symbol", "i.market")


@query("fn16_metric_algorithm", """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'macd_signal' WHEN 1 THEN 'macd' WHEN 2 THEN 'historical_risk_statistics' WHEN 3 THEN 'technical_basic_composite' END AS algorithm FROM nation""")
def _fn16(spark, sf_dir):
    metric = F.element_at(F.array(*map(F.lit, ("macd_signal_9", "macd_12_26", "max_drawdown", "volume_ratio_20", "unheard_of"))), F.col("n_nationkey").cast("int") % 5 + 1)
    return P.table(spark, sf_dir, "nation").select("n_nationkey", symbols.algorithm(metric).alias("algorithm"))


@query("flt09_evaluation_trim", f"WITH {P.WALK_SQL} SELECT symbol, count(*) AS points, max(day) AS last FROM walk WHERE day <= DATE '1996-06-30' GROUP BY symbol")
def _flt09(spark, sf_dir):
    rows = P.walk(spark, sf_dir).withColumnRenamed("day", "at")
    points, _ = contracts.evaluation_trimmed(rows, rows.where("at < DATE '1996-01-01'"), F.lit("1996-06-30").cast("date"))
    return points.groupBy("symbol").agg(F.count("*").alias("points"), F.max("at").alias("last"))


@query("flt15_price_contract", f"WITH {P.BARS_SQL} SELECT symbol, count(*) AS rows, count(*) FILTER (day(day) IN (3, 4)) AS not_finite, count(*) FILTER (day(day) = 6) AS no_time, count(*) FILTER (day(day) = 5) AS no_reference, count(*) > 4096 AS too_many FROM bars GROUP BY symbol")
def _flt15(spark, sf_dir):
    """Bars of which some have a number that isn't finite, no time, or a reference that is none."""
    d = F.dayofmonth("day")
    rows = P.bars(spark, sf_dir).withColumn("reference", F.when(d == 5, "sha256:00").otherwise(F.concat(F.lit("sha256:"), F.sha2("symbol", 256))))
    rows = rows.withColumns({"close": F.when(d == 3, F.lit(float("nan"))).otherwise(F.col("close")), "open": F.when(d == 4, F.lit(float("inf"))).otherwise(F.col("open")), "day": F.when(d != 6, F.col("day"))})
    return contracts.price_violations(rows)


@query("flt16_outcome_contract", f"WITH {P.BARS_SQL} SELECT symbol, (count(*) + count(*) FILTER (day(day) = 7))::BIGINT AS points, (2 * count(*) FILTER (day(day) = 7))::BIGINT AS repeated, count(*) FILTER (day(day) = 9)::BIGINT AS half_ranges, count(*) FILTER (day(day) IN (9, 11))::BIGINT AS basis_mismatch, count(*) + count(*) FILTER (day(day) = 7) > 8192 AS too_many FROM bars GROUP BY symbol")
def _flt16(spark, sf_dir):
    """Points of which some occur twice, have half a range, or none where the basis asks for one."""
    rows, d = P.bars(spark, sf_dir).withColumn("basis", F.lit("high_low")), F.dayofmonth("day")
    rows = rows.withColumns({"high": F.when(~d.isin(9, 11), F.col("high")), "low": F.when(d != 11, F.col("low"))})
    return contracts.outcome_violations(rows.unionByName(rows.where(d == 7)))


@query("flt17_fundamental_contract", f"""WITH {P.FACTS_SQL} SELECT symbol, count(*) AS rows, count(*) FILTER (metric = 'equity') AS unknown_metric, 0::BIGINT + count(*) FILTER (metric = 'total_debt') AS not_finite, count(*) FILTER (metric = 'revenue') AS bad_currency,
count(*) FILTER (metric = 'operating_income') AS bad_period, count(*) FILTER (metric = 'market_cap' AND right(symbol, 1) = 'A') AS bad_valuation_time, false AS too_many FROM facts GROUP BY symbol""")
def _flt17(spark, sf_dir):
    """Facts of which each metric breaks another rule."""
    m = F.col("metric")
    rows = P.facts(spark, sf_dir).withColumns({"value": F.when(m == "total_debt", F.lit(float("nan"))).otherwise(F.col("value")), "currency": F.when(m == "revenue", "usd").otherwise(F.col("currency"))})
    rows = rows.withColumn("period_type", F.when(m == "operating_income", "weekly").otherwise(F.col("period_type")))
    late = (m == "market_cap") & F.col("symbol").endswith("A")
    return contracts.fundamental_violations(rows.withColumn("valuation_as_of", F.when(late, F.date_add("observed_at", 1)).otherwise(F.col("valuation_as_of"))))


@query("flt18_return_contract", f"""WITH {P.RETURNS_SQL}, bad AS (SELECT symbol, start_date, end_date, CASE WHEN day(end_date) = 2 THEN -1.5 ELSE value END AS value FROM rets UNION ALL SELECT symbol, end_date, start_date, value FROM rets WHERE day(end_date) = 3)
SELECT symbol, count(*) FILTER (start_date >= end_date) AS reversed, count(*) FILTER (value < -1) AS below_minus_one, count(*) FILTER (was > start_date) AS overlapping FROM (SELECT *, lag(end_date) OVER (PARTITION BY symbol ORDER BY start_date, end_date) AS was FROM bad) GROUP BY symbol""")
def _flt18(spark, sf_dir):
    """Returns of which some are below -1 and some intervals run backwards."""
    rows = P.returns(spark, sf_dir)
    back = rows.where(F.dayofmonth("end_date") == 3).select("symbol", F.col("end_date").alias("start_date"), F.col("start_date").alias("end_date"), "value")
    return return_violations(rows.withColumn("value", F.when(F.dayofmonth("end_date") == 2, -1.5).otherwise(F.col("value"))).unionByName(back))


@query("join03_panel_join", f"""WITH {P.RETURNS_SQL}, p AS (SELECT end_date AS date, CASE WHEN day(end_date) = 15 THEN start_date - 1 WHEN day(end_date) > 20 THEN start_date END AS s, CASE WHEN day(end_date) <> 12 THEN abs(value) / 10 END AS rf FROM rets WHERE symbol = 'AFRICA'),
c AS (SELECT day, lag(day) OVER (ORDER BY day) AS was FROM (SELECT DISTINCT day FROM walk)) SELECT symbol, end_date, round(value - rf, 6) + 0 AS excess FROM rets JOIN p ON end_date = date LEFT JOIN c ON date = day WHERE symbol <> 'AFRICA' AND rf IS NOT NULL AND start_date = coalesce(s, was)""")
def _join03(spark, sf_dir):
    """Daily returns in excess of a panel's cash: days without cash, and returns of other intervals, fall out."""
    rows, d = P.returns(spark, sf_dir), F.dayofmonth("end_date")
    start = F.when(d == 15, F.date_sub("start_date", 1)).when(d > 20, F.col("start_date"))
    panel = rows.where("symbol = 'AFRICA'").select(F.col("end_date").alias("date"), start.alias("start_date"), F.when(d != 12, F.abs("value") / 10).alias("risk_free"))
    found = contracts.panel_joined(rows.where("symbol <> 'AFRICA'"), panel, P.walk(spark, sf_dir).select("day").distinct())
    return rounded(found.select("symbol", "end_date", "excess")).withColumn("excess", F.col("excess") + F.lit(0.0))


@query("join19_universe_metadata", "SELECT n_name AS symbol, CASE WHEN n_regionkey = 2 THEN 'energy' END AS sector, n_regionkey = 2 AS supplied FROM nation")
def _join19(spark, sf_dir):
    nation = P.table(spark, sf_dir, "nation")
    members = nation.where("n_regionkey = 2").select(F.col("n_name").alias("symbol"), F.lit("energy").alias("sector"))
    return contracts.with_metadata(nation.select(F.col("n_name").alias("symbol")), members)


@query("fac02_standardized_design", f"""WITH {P.RETURNS_SQL}, w AS (SELECT a.end_date, a.value AS x1, b.value AS x2 FROM rets a JOIN rets b USING (start_date, end_date) WHERE a.symbol = 'ASIA' AND b.symbol = 'EUROPE')
SELECT end_date, round((x1 - avg(x1) OVER ()) / stddev_samp(x1) OVER (), 5) AS x1, round((x2 - avg(x2) OVER ()) / stddev_samp(x2) OVER (), 5) AS x2 FROM w""")
def _fac02(spark, sf_dir):
    rows = P.returns(spark, sf_dir)
    side = lambda s, n: rows.where(F.col("symbol") == s).select("start_date", "end_date", F.col("value").alias(n))
    design, _ = contracts.standardized(side("ASIA", "x1").join(side("EUROPE", "x2"), ["start_date", "end_date"]).select("end_date", "x1", "x2"), ["x1", "x2"])
    return rounded(design, 5)
