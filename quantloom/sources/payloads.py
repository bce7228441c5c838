"""Stored vendor payloads as tables: adjusted levels, exchange rates, candles and company facts; and rows given inline.

A payload is one JSON text an instrument, in column ``content``. Nothing here asks a network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import fundamentals

_META = "meta struct<symbol: string, instrumentType: string, exchangeTimezoneName: string, currency: string>"
_CHART = f"chart struct<result: array<struct<{_META}, timestamp: array<bigint>, indicators: struct<adjclose: array<struct<adjclose: array<double>>>, quote: array<struct<close: array<double>>>>>>>"

# The metric of each reported concept, and the two concepts that free cash flow is made of.
CONCEPTS = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "Revenues": "revenue",
    "NetIncomeLoss": "net_income",
    "OperatingIncomeLoss": "operating_income",
    "StockholdersEquity": "shareholders_equity",
    "LongTermDebt": "total_debt",
    "ShortTermBorrowings": "total_debt",
    "GrossProfit": "gross_profit",
}
CASH_FLOW = {"NetCashProvidedByUsedInOperatingActivities": "operating_cash_flow", "PaymentsToAcquirePropertyPlantAndEquipment": "capital_expenditure"}

#: Columns of the tables that a request may carry itself.
INLINE = {
    "prices": "symbol string, market string, observed_at timestamp, open double, high double, low double, close double, volume double",
    "outcomes": "symbol string, name string, observed_at timestamp, value double, high double, low double",
    "returns": "symbol string, start_date date, end_date date, value double",
    "rates": "base string, quote string, date date, value double",
    "panel": "date date, start_date date, values map<string, double>, risk_free double",
    "positions": "symbol string, market string, quantity double",
}


def _results(payloads: DataFrame, *keep: str) -> DataFrame:
    return payloads.select(*keep, F.from_json("content", _CHART).alias("j")).select(*keep, F.element_at("j.chart.result", 1).alias("r"))


def _checked(value, ok, what: str):
    """``value``, or an error that names the instrument if ``ok`` is false or null."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col("symbol"), F.lit("null")))))


def _dated(rows: DataFrame, values: str, *keep: str) -> DataFrame:
    """One row a time: the exchange's date and the level. Arrays of unequal length are an error."""
    levels = F.col(values)
    zipped = F.arrays_zip(F.col("r.timestamp").alias("t"), levels.alias("v"))
    same = _checked(zipped, F.size("r.timestamp") == F.size(levels), "unequal arrays")
    out = rows.select(*keep, F.col("r.meta.exchangeTimezoneName").alias("__zone"), F.explode(same).alias("z"))
    utc = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, z.t)")
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.col("__zone"), utc))
    return out.select(*keep, local.alias("date"), F.col("z.v").alias("value"))


def adjusted_levels(payloads: DataFrame) -> DataFrame:
    """(symbol, currency, date, value) of chart payloads' adjusted closes, null ones kept; pence are labelled pounds. A payload
    of another security than ``symbol``, or one that is neither share nor fund, is an error."""
    rows = _results(payloads, "symbol")
    meta = F.col("r.meta")
    ok = (F.upper(meta["symbol"]) == F.upper("symbol")) & meta["instrumentType"].isin("EQUITY", "ETF")
    currency = F.when(meta["currency"].isin("GBp", "GBX"), "GBP").otherwise(meta["currency"])
    rows = rows.select(_checked(F.col("symbol"), ok, "wrong security").alias("symbol"), currency.alias("currency"), "r").withColumn("v", F.element_at("r.indicators.adjclose", 1)["adjclose"])
    return _dated(rows, "v", "symbol", "currency")


def fx_levels(payloads: DataFrame) -> DataFrame:
    """(base, quote, date, value) of chart payloads of rates, null closes left out. Only EUR, GBP and CHF in USD are served;
    another pair, or a payload of one, is an error. ``payloads`` has (symbol: the base currency, content)."""
    rows = _results(payloads, "symbol")
    meta = F.col("r.meta")
    ok = F.col("symbol").isin("EUR", "GBP", "CHF") & (meta["symbol"] == F.concat("symbol", F.lit("USD=X"))) & (meta["currency"] == "USD")
    rows = rows.select(_checked(F.col("symbol"), ok, "wrong pair").alias("symbol"), "r").withColumn("v", F.element_at("r.indicators.quote", 1)["close"])
    return _dated(rows, "v", "symbol").where("value is not null").select(F.col("symbol").alias("base"), F.lit("USD").alias("quote"), "date", "value")


def candles(payloads: DataFrame) -> DataFrame:
    """(symbol, observed_at, open, high, low, close, volume) of arrays of [milliseconds, open, high, low, close, volume]."""
    rows = payloads.select("symbol", F.explode(F.from_json("content", "array<array<double>>")).alias("c")).where("size(c) = 6 and c[4] is not null")
    names = ("open", "high", "low", "close", "volume")
    return rows.select("symbol", F.timestamp_millis(F.col("c")[0].cast("bigint")).alias("observed_at"), *[F.col("c")[i + 1].alias(n) for i, n in enumerate(names)])


def company_facts(payloads: DataFrame) -> DataFrame:
    """(symbol, metric, period_role, value, period_end) of company-facts payloads: of each known concept in USD the newest
    annual fact and the one of the year before, and free cash flow where both of its concepts have the role. Concepts
    that are absent or malformed are left out, facts without year, period, form or number too."""
    fact = "struct<end: string, val: double, fy: int, fp: string, form: string, filed: string, accn: string>"
    said = F.from_json("content", f"facts struct<`us-gaap`: map<string, struct<units: map<string, array<{fact}>>>>>")
    rows = payloads.select("symbol", said.alias("j")).select("symbol", F.explode(F.col("j.facts.us-gaap")).alias("concept", "c"))
    known = rows.where(F.col("concept").isin(*CONCEPTS, *CASH_FLOW))
    facts = known.select("symbol", "concept", F.explode(F.try_element_at("c.units", F.lit("USD"))).alias("f")).select("symbol", "concept", "f.*").where("fy is not null and val is not null and form is not null")
    picked = fundamentals.annual_periods(facts)
    metric = F.create_map(*[F.lit(x) for pair in (CONCEPTS | CASH_FLOW).items() for x in pair])[F.col("concept")]
    picked = picked.select("symbol", "concept", metric.alias("metric"), "period_role", F.col("val").alias("value"), F.try_to_date("end").alias("period_end"))
    columns = ("symbol", "metric", "period_role", "value", "period_end")
    cash = picked.where(F.col("concept").isin(*CASH_FLOW)).groupBy("symbol", "period_role").agg(
        F.max(F.when(F.col("metric") == "operating_cash_flow", F.col("value"))).alias("a"), F.max(F.when(F.col("metric") == "capital_expenditure", F.abs("value"))).alias("b"), F.max("period_end").alias("period_end")
    )
    cash = cash.where("a is not null and b is not null").select("symbol", F.lit("free_cash_flow").alias("metric"), "period_role", (F.col("a") - F.col("b")).alias("value"), "period_end")
    return picked.where(~F.col("concept").isin(*CASH_FLOW)).select(*columns).unionByName(cash)


def inline(spark: SparkSession, kind: str, rows: list) -> DataFrame:
    """The rows of a request as a table of one of the INLINE kinds; no rows give an empty table with its columns. Times must
    carry a zone."""
    for row in rows:
        for value in row.values() if isinstance(row, dict) else row:
            if hasattr(value, "tzinfo") and value.tzinfo is None:
                raise ValueError("time without a zone")
    return spark.createDataFrame(rows, INLINE[kind])


def required(table: DataFrame, symbol: str, key: str = "symbol") -> DataFrame:
    """The rows of one instrument; an error if there are none, as nothing else is asked."""
    found = table.where(F.col(key) == symbol)
    if found.isEmpty():
        raise LookupError(f"no rows of {symbol}")
    return found
