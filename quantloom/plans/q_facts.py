"""Queries of fundamentals, filings, text functions, backtests, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import backtest, signals
from quantloom.operators import fundamentals as fu
from quantloom.plans import panels as P
from quantloom.plans.q_risk import _RISK, rounded
from quantloom.plans.q_windows import FEATURES_SQL
from quantloom.sources import files, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_W = P.FACTS_SQL + """, w AS (SELECT symbol, """ + ", ".join(f"max(value) FILTER (metric = '{m}' AND period_role = '{r}') AS {m}_{r[0]}" for m in ("revenue", "net_income", "operating_income", "equity", "total_debt", "market_cap") for r in ("current", "prior")) + """ FROM facts GROUP BY symbol), ra AS (
  SELECT symbol, (revenue_c - revenue_p) / revenue_p AS revenue_growth, (net_income_c - net_income_p) / net_income_p AS earnings_growth, operating_income_c / revenue_c AS operating_margin, net_income_c / revenue_c AS net_margin, net_income_c / equity_c AS return_on_equity, total_debt_c / equity_c AS leverage, market_cap_c / net_income_c AS price_to_earnings FROM w)"""
_RATIOS = f"WITH {_W} SELECT symbol, metric, round(value, 6) AS value FROM (UNPIVOT ra ON revenue_growth, earnings_growth, operating_margin, net_margin, return_on_equity, leverage, price_to_earnings INTO NAME metric VALUE value)"


@query("skl01_fundamental", _RATIOS)
def _skl01(spark, sf_dir):
    return rounded(fu.ratios(P.facts(spark, sf_dir)))


_STATEMENTS = P.FACTS_SQL + """, st AS (
  SELECT symbol, metric, period_role, value, period_end, y, right(symbol, 1) AS l,
    CASE WHEN metric = 'net_income' AND right(symbol, 1) IN ('0', '1') THEN 's2' ELSE 's1' END AS snapshot,
    CASE WHEN metric = 'equity' AND right(symbol, 1) IN ('2', '3') THEN 'EUR' ELSE 'USD' END AS currency FROM facts
), pairs AS (
  SELECT a.symbol, a.l, a.metric AS top, b.metric AS bottom, a.value AS v, b.value AS w, a.snapshot = b.snapshot AND a.currency = b.currency AS alike, a.period_role AS ra, b.period_role AS rb, a.y AS ya, b.y AS yb
  FROM st a JOIN st b USING (symbol)
)"""


@query("join13_statement_ratio", f"""WITH {_STATEMENTS} SELECT symbol, CASE top || '/' || bottom WHEN 'operating_income/revenue' THEN 'operating_margin' WHEN 'net_income/revenue' THEN 'net_margin' WHEN 'net_income/equity' THEN 'return_on_equity' WHEN 'total_debt/equity' THEN 'leverage' END AS metric, round(v / w, 6) AS value
FROM pairs WHERE alike AND ra = 'current' AND rb = 'current' AND ya = yb AND top || '/' || bottom IN ('operating_income/revenue', 'net_income/revenue', 'net_income/equity', 'total_debt/equity')""")
def _join13(spark, sf_dir):
    return rounded(fu.statement_ratios(P.statements(spark, sf_dir)))


@query("join14_growth", f"""WITH {_STATEMENTS} SELECT symbol, CASE top WHEN 'revenue' THEN 'revenue_growth' ELSE 'earnings_growth' END AS metric, round((v - w) / w, 6) AS value
FROM pairs WHERE alike AND top = bottom AND top IN ('revenue', 'net_income') AND ra = 'current' AND rb = 'prior' AND ya = yb + 1 AND l NOT IN ('4', '5')""")
def _join14(spark, sf_dir):
    return rounded(fu.growths(P.statements(spark, sf_dir)))


@query("join15_valuation", f"""WITH {_STATEMENTS} SELECT symbol, 'price_to_earnings' AS metric, round(v / w, 6) AS value
FROM pairs WHERE alike AND top = 'market_cap' AND bottom = 'net_income' AND ra = 'current' AND rb = 'current' AND l NOT IN ('6', '7', '8')""")
def _join15(spark, sf_dir):
    return rounded(fu.valuations(P.statements(spark, sf_dir).where("period_role = 'current'")))


@query("flt12_latest_metric", f"WITH {P.FACTS_SQL} SELECT symbol, period_role, 'income' AS name, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period_role ORDER BY CASE metric WHEN 'operating_income' THEN 0 ELSE 1 END, period_end DESC) AS r FROM facts WHERE metric IN ('operating_income', 'net_income')) WHERE r = 1")
def _flt12(spark, sf_dir):
    return rounded(fu.latest_facts(P.facts(spark, sf_dir), {"income": ["operating_income", "net_income"]}).select("symbol", "period_role", "name", "value"))


_AGES = f"""WITH {P.FILINGS_SQL} SELECT symbol, count(*) AS filings, count(*) FILTER (form IN ('8-K', '8-K/A')) AS events, (DATE '1999-01-01' - max(filing_date) FILTER (form IN ('10-K', '10-K/A')))::INT AS days_since_annual, (DATE '1999-01-01' - max(filing_date) FILTER (form IN ('10-Q', '10-Q/A')))::INT AS days_since_quarterly FROM filings GROUP BY symbol"""


@query("skl03_filings", _AGES)
def _skl03(spark, sf_dir):
    return fu.filing_summary(P.filings(spark, sf_dir), F.lit("1999-01-01").cast("date"))


QUERIES["agg21_filing_counts"], SQL["agg21_filing_counts"] = QUERIES["skl03_filings"], _AGES


@query("fn13_filing_evidence", f"WITH {P.FILINGS_SQL} SELECT form, count(*) AS n, count(*) FILTER (contains(form, '/A')) AS amendments FROM filings WHERE day(filing_date) <> 1 GROUP BY form")
def _fn13(spark, sf_dir):
    rows = P.filings(spark, sf_dir)
    text = rows.select("symbol", F.when(F.dayofmonth("filing_date") == 1, "{bad").otherwise(F.to_json(F.struct("form", F.col("filing_date").cast("string").alias("filing_date")))).alias("content"))
    return fu.parsed_evidence(text).groupBy("form").agg(F.count("*").alias("n"), F.count_if("is_amendment").alias("amendments"))


@query("agg24_annual_periods", """WITH f AS (SELECT o_custkey AS symbol, 'revenue' AS concept, CASE WHEN o_orderstatus = 'F' THEN 'FY' ELSE 'Q1' END AS fp, year(o_orderdate) AS fy, CAST(o_orderdate AS DATE) AS filed, o_orderkey AS accn, o_totalprice AS val FROM orders), r AS (SELECT * FROM f WHERE fp = 'FY'),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, concept ORDER BY fy DESC, filed DESC, accn DESC) AS k FROM r) WHERE k = 1), p AS (SELECT r.*, row_number() OVER (PARTITION BY r.symbol, r.concept ORDER BY r.fy DESC, r.filed DESC, r.accn DESC) AS k FROM r JOIN c ON c.symbol = r.symbol AND r.fy = c.fy - 1)
SELECT symbol, 'current' AS period_role, accn, val FROM c UNION ALL SELECT symbol, 'prior', accn, val FROM p WHERE k = 1""")
def _agg24(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    facts = o.select(F.col("o_custkey").alias("symbol"), F.lit("revenue").alias("concept"), F.when(F.col("o_orderstatus") == "F", "FY").otherwise("Q1").alias("fp"), F.year("o_orderdate").alias("fy"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderkey").alias("accn"), F.col("o_totalprice").alias("val"))
    return fu.annual_periods(facts).select("symbol", "period_role", "accn", "val")


@query("join16_free_cash_flow", f"WITH {P.FACTS_SQL} SELECT a.symbol, a.period_role AS frame, round(a.value - abs(b.value), 6) AS free_cash_flow FROM facts a JOIN facts b USING (symbol, period_role) WHERE a.metric = 'operating_income' AND b.metric = 'total_debt'")
def _join16(spark, sf_dir):
    names = F.when(F.col("metric") == "operating_income", "operating_cash_flow").when(F.col("metric") == "total_debt", "capital_expenditure")
    return rounded(fu.free_cash_flow(P.facts(spark, sf_dir).select("symbol", names.alias("concept"), F.col("period_role").alias("frame"), F.col("value").alias("val"))))


@query("src19_french_panel", "SELECT DATE '2023-01-31' AS date, 0.01::DOUBLE AS market, 0.002::DOUBLE AS cash UNION ALL SELECT DATE '2023-02-28', -0.02, 0.003")
def _src19(spark, sf_dir):
    text = ["intro", ",Mkt-RF,SMB,HML,RMW,CMA,RF", "202301, 1.00, 2.00, 3.00, 4.00, 5.00, 0.20", "202302,-2.00, 1.00, 1.00, 1.00, 1.00, 0.30", "202303,-99.99,1,1,1,1,1", " Annual", "2023, 1,2,3,4,5,6"]
    rows = files.french_panel(spark.createDataFrame([(t,) for t in text], "value string"), monthly=True)
    return rows.select("date", F.col("values")["Mkt-RF"].alias("market"), F.col("values")["RF"].alias("cash"))


@query("src20_cik_map", "SELECT 'AAA' AS symbol, '0000000012' AS cik UNION ALL SELECT 'BBB', '0000000099'")
def _src20(spark, sf_dir):
    content = spark.createDataFrame([('{"0": {"cik_str": 12, "ticker": "aaa"}, "1": {"cik_str": 7, "ticker": "BBB"}}',)], "content string")
    return files.cik_map(content, spark.createDataFrame([("bbb", "99")], "symbol string, cik string"))


@query("src21_filings_scan", f"WITH {P.FILINGS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY filing_date, form) AS r FROM filings) SELECT symbol, form, filing_date, contains(form, '/A') AS is_amendment FROM l WHERE r <= 64")
def _src21(spark, sf_dir):
    one = P.filings(spark, sf_dir).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("filing_date", "form"))).alias("z"))
    text = one.select("symbol", F.to_json(F.struct(F.col("z.form").alias("form"), F.transform("z.filing_date", lambda d: d.cast("string")).alias("filingDate"), F.transform("z.form", lambda _: F.lit("x")).alias("accessionNumber"))).alias("content"))
    return files.filings_of(text).drop("accession")


#: Control, zero-width, direction and byte-order characters that texts are cleaned of.
UNSAFE = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u200B-\u200F\u202A-\u202E\u2060-\u2064\uFEFF]"


@query("fn01_sanitised_text", r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'))::INT AS n FROM documents")
def _fn01(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", UNSAFE, "")).alias("n"))


@query("fn02_symbols", "SELECT c_custkey, upper(replace(c_name, '#', '-')) AS symbol, regexp_full_match(upper(replace(c_name, '#', '-')), '[A-Z0-9.-]{1,32}') AS valid FROM customer")
def _fn02(spark, sf_dir):
    symbol = F.upper(F.translate("c_name", "#", "-"))
    return P.table(spark, sf_dir, "customer").select("c_custkey", symbol.alias("symbol"), symbol.rlike(r"^[A-Z0-9.-]{1,32}$").alias("valid"))


@query("fn04_content_reference", "SELECT n_nationkey, 'sha256:' || sha256(n_nationkey::VARCHAR || '|' || n_name) AS reference FROM nation")
def _fn04(spark, sf_dir):
    return P.table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256)).alias("reference"))


@query("fn15_boundary_rounding", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS value FROM lineitem")
def _fn15(spark, sf_dir):
    return P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 8, 2).alias("value"))


@query("set04_ordered_distinct", "SELECT o_orderkey, o_orderstatus || CASE WHEN left(o_orderkey::VARCHAR, 1) <> '1' THEN ',' || left(o_orderkey::VARCHAR, 1) ELSE '' END || ',1' AS distinct_values FROM orders")
def _set04(spark, sf_dir):
    values = F.array("o_orderstatus", F.substring(F.col("o_orderkey").cast("string"), 1, 1), F.lit("1"), "o_orderstatus", F.lit("1"))
    return P.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", F.array_distinct(values)).alias("distinct_values"))


@query("flt08_membership", f"WITH {P.WALK_SQL} SELECT symbol, count(*) AS n FROM walk WHERE (symbol <> 'ASIA' OR day >= DATE '1994-01-01') AND (symbol <> 'EUROPE' OR day <= DATE '1996-06-30') GROUP BY symbol")
def _flt08(spark, sf_dir):
    members = spark.createDataFrame([("ASIA", "1994-01-01", None), ("EUROPE", None, "1996-06-30")], "symbol string, a string, b string").select("symbol", F.col("a").cast("date").alias("member_from"), F.col("b").cast("date").alias("member_to"))
    rows = P.walk(spark, sf_dir).join(members, "symbol", "left")
    return rows.where("coalesce(member_from <= day, true) and coalesce(day <= member_to, true)").groupBy("symbol").agg(F.count("*").alias("n"))


@query("snk03_json_rows", f"WITH {_RISK} SELECT symbol, count(*) AS n FROM (UNPIVOT risk ON annualized_volatility, max_drawdown INTO NAME metric VALUE value) GROUP BY symbol")
def _snk03(spark, sf_dir):
    from quantloom.operators import risk

    rows = sinks.as_json(sinks.bounded(risk.unpivot(risk.risk_statistics(P.walk(spark, sf_dir)), ("annualized_volatility", "max_drawdown"))))
    return rows.select(F.get_json_object("value", "$.symbol").alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def _bt(spark, sf_dir):
    b = P.bars(spark, sf_dir)
    return b, signals.sma_cross_actions(b)


@query("bt01_trades")
def _bt01(spark, sf_dir):
    return rounded(backtest.trades(*_bt(spark, sf_dir)))


@query("bt03_action_flags", f"""WITH {FEATURES_SQL}, c AS (SELECT symbol, day, round(sma20, 8) AS l, round(sma50, 8) AS r FROM features), a AS (
  SELECT symbol, day, CASE WHEN lag(l) OVER w <= lag(r) OVER w AND l > r THEN 'add_long' WHEN lag(l) OVER w >= lag(r) OVER w AND l < r THEN 'exit_long' END AS action FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)
) SELECT symbol, action, count(*) AS n FROM a GROUP BY ALL""")
def _bt03(spark, sf_dir):
    return backtest.flagged(*_bt(spark, sf_dir)).groupBy("symbol", "action").agg(F.count("*").alias("n"))


@query("skl12_backtesting")
def _skl12(spark, sf_dir):
    b, a = _bt(spark, sf_dir)
    return rounded(backtest.headline(backtest.equity(b, a), backtest.trades(b, a)))


QUERIES["bt04_07_metrics"] = QUERIES["skl12_backtesting"]


@query("srt05_even_sampling")
def _srt05(spark, sf_dir):
    return rounded(backtest.sampled(backtest.equity(*_bt(spark, sf_dir)), backtest.trades(*_bt(spark, sf_dir))))


@query("srt04_endpoints", f"WITH {P.WALK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS u, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS d FROM walk) SELECT symbol, day, round(close, 6) AS close FROM r WHERE u <= 100 OR d <= 100")
def _srt04(spark, sf_dir):
    return rounded(backtest.endpoints(P.walk(spark, sf_dir), "day"))


@query("join10_unmatched_events", f"WITH {P.BARS_SQL} SELECT symbol, count(*) AS n FROM bars WHERE day(day) = 2 GROUP BY symbol")
def _join10(spark, sf_dir):
    b = P.bars(spark, sf_dir)
    actions = b.select("symbol", F.col("day").alias("at"), F.lit("add_long").alias("action"))
    return backtest.unmatched(b.where(F.dayofmonth("day") != 2), actions).groupBy("symbol").agg(F.count("*").alias("n"))
