import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import symbols
from quantloom.operators import contracts
from quantloom.sources import payloads


def _chart(symbol, times, adjusted=None, close=None, kind="ETF", zone="Asia/Tokyo", currency="JPY"):
    meta = {"symbol": symbol, "instrumentType": kind, "exchangeTimezoneName": zone, "currency": currency}
    return json.dumps({"chart": {"result": [{"meta": meta, "timestamp": times, "indicators": {"adjclose": [{"adjclose": adjusted}], "quote": [{"close": close}]}}]}})


def test_levels_of_charts(spark):
    at = int(dt.datetime(2024, 1, 1, 20, tzinfo=dt.timezone.utc).timestamp())  # the next day in Tokyo
    text = _chart("abc", [at, at + 86400], adjusted=[1.5, None])
    made = spark.createDataFrame([("ABC", text)], "symbol string, content string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [tuple(r) for r in payloads.adjusted_levels(made).orderBy("date").collect()] == [("ABC", "JPY", dt.date(2024, 1, 2), 1.5), ("ABC", "JPY", dt.date(2024, 1, 3), None)]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    rates = spark.createDataFrame([("EUR", _chart("EURUSD=X", [at, at + 86400], close=[1.1, None], zone="Europe/London", currency="USD"))], "symbol string, content string")
    assert [tuple(r) for r in payloads.fx_levels(rates).collect()] == [("EUR", "USD", dt.date(2024, 1, 1), 1.1)]


@pytest.mark.parametrize("text", [_chart("xyz", [1], [1.0]), _chart("abc", [1], [1.0], kind="INDEX"), _chart("abc", [1, 2], [1.0]), "{}"])
def test_wrong_charts_are_errors(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        payloads.adjusted_levels(spark.createDataFrame([("ABC", text)], "symbol string, content string")).collect()


def test_company_facts(spark):
    fact = lambda fy, val, fp="FY", **k: {"end": f"{fy}-12-31", "val": val, "fy": fy, "fp": fp, "form": "10-K", "filed": f"{fy + 1}-02-01", "accn": "x"} | k
    usd = lambda *facts: {"units": {"USD": list(facts)}}
    gaap = {
        "Revenues": usd(fact(2022, 90.0), fact(2023, 100.0), fact(2024, 7.0, "Q1"), fact(2021, 1.0)),
        "NetIncomeLoss": usd(fact(2023, 9.0), fact(2021, 8.0)),
        "GrossProfit": {"units": {"EUR": [fact(2023, 1.0)]}},
        "NetCashProvidedByUsedInOperatingActivities": usd(fact(2023, 30.0), fact(2022, 20.0)),
        "PaymentsToAcquirePropertyPlantAndEquipment": usd(fact(2023, -12.0)),
        "Unknown": usd(fact(2023, 5.0)),
    }
    made = spark.createDataFrame([("A", json.dumps({"facts": {"us-gaap": gaap}})), ("B", "{"), ("C", None)], "symbol string, content string")
    got = {(r.symbol, r.metric, r.period_role): r.value for r in payloads.company_facts(made).collect()}
    assert got == {("A", "revenue", "current"): 100.0, ("A", "revenue", "prior"): 90.0, ("A", "net_income", "current"): 9.0, ("A", "free_cash_flow", "current"): 18.0}


def test_candles_and_inline(spark):
    made = spark.createDataFrame([("B", "[[1000, 1, 2, 0.5, 1.5, 9], [2000, 1, 1, 1, null, 1]]"), ("E", "[]")], "symbol string, content string")
    assert [(r.symbol, r.observed_at.timestamp(), r.close, r.volume) for r in payloads.candles(made).collect()] == [("B", 1.0, 1.5, 9.0)]
    rates = payloads.inline(spark, "rates", [("EUR", "USD", dt.date(2024, 1, 2), 1.1)])
    assert rates.count() == 1 and payloads.inline(spark, "panel", []).columns == ["date", "start_date", "values", "risk_free"]
    with pytest.raises(ValueError):
        payloads.inline(spark, "outcomes", [("A", "x", dt.datetime(2024, 1, 1), 1.0, None, None)])
    with pytest.raises(LookupError):
        payloads.required(payloads.inline(spark, "returns", []), "A")


def test_symbols(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(symbols.vendor_symbol("yahoo", F.lit("REP"), F.lit("BME"))) == "REP.MC" and one(symbols.vendor_symbol("yahoo", F.lit("REP"), F.lit("MOON"))) is None
    assert one(symbols.vendor_symbol("ccxt", F.lit("BTC/USDT"), F.lit("CRYPTO"))) == "BTC/USDT"
    with pytest.raises(KeyError):
        symbols.vendor_symbol("nobody", F.lit("A"), F.lit("US"))
    assert tuple(one(symbols.security(F.lit(" brk/b us Equity ")))) == ("BRK/B US Equity", "BRK-B", "US", "USD")
    assert all(one(symbols.security(F.lit(t))) is None for t in ("REP ZZ Equity", "REP SM Index", "", "REP")) and one(symbols.security(F.lit(None).cast("string"))) is None
    assert one(symbols.benchmarks(F.lit("SIX"))) == ["SXXP", "SX5E"] and one(symbols.benchmarks(F.lit("SIX"), (" spy ",))) == ["SPY"] and one(symbols.benchmarks(F.lit("X"), ("auto",))) == ["SPY", "QQQ"]
    got = [tuple(one(symbols.benchmark_instrument(F.lit(t)))) for t in ("csi500", "600000", "830001", "000001", "VUSA.L", "spy")]
    assert got == [("000905", "SSE"), ("600000", "SSE"), ("830001", "BJSE"), ("000001", "SZSE"), ("VUSA.L", "EU"), ("SPY", "US")]
    assert one(symbols.algorithm(F.lit("annualized_volatility"))) == "annualized_volatility" and one(symbols.algorithm(F.lit("macd_histogram_2"))) == "macd" and one(symbols.algorithm(F.lit("x"))) is None
    assert symbols.configuration_reference({"a": 1, "b": [2]}) == symbols.configuration_reference({"b": [2], "a": 1}) != symbols.configuration_reference({"a": 2})


def test_trim_refuses_later_events(spark):
    rows = spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 2, 3)], "symbol string, at date")
    points, events = contracts.evaluation_trimmed(rows, rows, F.lit("2024-01-02").cast("date"))
    assert points.count() == 2
    with pytest.raises(Exception, match="event after"):
        events.collect()


def test_standardized_design(spark):
    x = np.random.default_rng(1).normal(2, 3, (50, 2))
    study = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    design, back = contracts.standardized(study, ["a", "b"])
    z = design.toPandas().to_numpy()
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0, ddof=1), 1)
    beta = np.array([0.5, 2.0, -1.0])
    assert np.allclose(np.column_stack((np.ones(50), z)) @ beta, np.column_stack((np.ones(50), x)) @ (back @ beta))
    for bad in ("a", "1.0D", "2 * a + 1"):
        with pytest.raises(ValueError):
            contracts.standardized(study.selectExpr("a", f"{bad} as b"), ["a", "b"])
    assert contracts.attribution_order(["x", "y", "z"]) == [("y", ["x"]), ("z", ["x", "y"])]


def test_contracts_of_empty_tables(spark):
    empty = spark.createDataFrame([], "symbol string, day date, open double, high double, low double, close double, volume double, reference string, basis string")
    assert contracts.price_violations(empty).count() == 0 and contracts.outcome_violations(empty).count() == 0
