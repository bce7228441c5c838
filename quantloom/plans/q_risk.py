"""Queries of returns: risk, volatility and Markov regimes, alignment, portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import alignment, risk
from quantloom.plans import panels as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df, digits: int = 6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


_R = P.WALK_SQL + """, r AS (
  SELECT *, row_number() OVER w - 1 AS idx, round(close / lag(close) OVER w - 1, 10) AS ret, round(ln(close / lag(close) OVER w), 10) AS log_ret, close / max(close) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd,
    round(coalesce(close / lag(close, 20) OVER w - 1, 0), 10) AS roll FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY day)
)"""
_RISK = _R + """, q AS (SELECT symbol, round(quantile_cont(ret, 0.05), 10) AS q05 FROM r GROUP BY symbol), m AS (SELECT symbol, avg(ret) AS mu FROM r GROUP BY symbol), risk AS (
  SELECT symbol, stddev_samp(ret) * sqrt(252) AS annualized_volatility, sqrt(avg(least(ret, 0) ** 2) FILTER (ret IS NOT NULL)) * sqrt(252) AS downside_volatility, min(dd) AS max_drawdown,
    greatest(0, -any_value(q05)) AS historical_var_95, greatest(0, -avg(ret) FILTER (ret <= q05)) AS historical_cvar_95,
    avg((ret - mu) ** 3) / avg((ret - mu) ** 2) ** 1.5 AS return_skewness, avg((ret - mu) ** 4) / avg((ret - mu) ** 2) ** 2 - 3 AS return_excess_kurtosis, max(ret) AS best_daily_return, min(ret) AS worst_daily_return
  FROM r JOIN q USING (symbol) JOIN m USING (symbol) GROUP BY symbol HAVING count(ret) >= 30)"""


@query("skl05_risk_analysis", f"WITH {_RISK} SELECT symbol, metric, round(value, 6) AS value FROM (UNPIVOT risk ON {', '.join(risk.METRICS)} INTO NAME metric VALUE value)")
def _skl05(spark, sf_dir):
    return rounded(risk.unpivot(risk.risk_statistics(P.walk(spark, sf_dir)), risk.METRICS))


def _one(name: str, columns: str):
    @query(name, f"WITH {_RISK} SELECT symbol, {', '.join(f'round({c}, 6) AS {c}' for c in columns.split())} FROM risk")
    def run(spark, sf_dir):
        return rounded(risk.risk_statistics(P.walk(spark, sf_dir)).select("symbol", *columns.split()))


_one("agg01_deviation", "annualized_volatility")
_one("agg02_quantile", "historical_var_95")
_one("agg03_moments", "return_skewness return_excess_kurtosis")
_one("agg04_downside", "downside_volatility")
_one("agg05_var_cvar", "historical_var_95 historical_cvar_95")


@query("agg06_max_drawdown", f"WITH {_R} SELECT symbol, round(min(dd), 6) AS max_drawdown FROM r GROUP BY symbol")
def _agg06(spark, sf_dir):
    return rounded(risk.max_drawdown(P.walk(spark, sf_dir)))


_REGIME = _R + """, v AS (
  SELECT symbol, day, round(CASE WHEN idx >= 20 THEN stddev_samp(log_ret) OVER (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING) * sqrt(252) END, 10) AS vol FROM r
), b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM v WHERE vol IS NOT NULL), c AS (
  SELECT symbol, max(vol) FILTER (back = 1) AS cur, max(vol) FILTER (back = 2) AS prev FROM b GROUP BY symbol
), p AS (SELECT symbol, cur, prev, (count(*) FILTER (vol < cur) + (count(*) FILTER (vol = cur) - 1) / 2) / 119 AS pct FROM b JOIN c USING (symbol) WHERE back <= 120 GROUP BY ALL HAVING count(*) = 120)"""


@query("skl06_volatility_regime", f"""WITH {_REGIME} SELECT symbol, round(cur, 6) AS annualized_volatility, round(pct, 6) AS volatility_regime_percentile, (CASE WHEN pct <= 0.2 THEN 0 WHEN pct >= 0.8 THEN 2 ELSE 1 END)::DOUBLE AS volatility_regime_code,
  (CASE WHEN cur > prev * 1.05 THEN 1 WHEN cur < prev * 0.95 THEN -1 ELSE 0 END)::DOUBLE AS volatility_trend FROM p""")
def _skl06(spark, sf_dir):
    return rounded(risk.volatility_regime(P.walk(spark, sf_dir)))


QUERIES["win26_volatility_percentile"], SQL["win26_volatility_percentile"] = QUERIES["skl06_volatility_regime"], SQL["skl06_volatility_regime"]

_LABEL = _R + """, lab AS (SELECT *, CASE WHEN idx >= 20 THEN CASE WHEN roll >= 0.05 THEN 2 WHEN roll <= -0.05 THEN 0 ELSE 1 END ELSE 1 END AS label FROM r), nx AS (
  SELECT *, lead(label) OVER w AS nxt, lag(label) OVER w AS prv FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY day)
), cells AS (SELECT DISTINCT symbol, o.origin, t.target FROM lab, (VALUES (0), (1), (2)) o(origin), (VALUES (0), (1), (2)) t(target)), cnt AS (
  SELECT symbol, label AS origin, nxt AS target, count(*) AS c FROM nx WHERE idx >= 20 AND nxt IS NOT NULL GROUP BY ALL
), tm AS (
  SELECT symbol, origin, target, CASE WHEN sum(coalesce(c, 0)) OVER (PARTITION BY symbol, origin) > 0 THEN coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY symbol, origin) ELSE 1/3::DOUBLE END AS probability
  FROM cells LEFT JOIN cnt USING (symbol, origin, target)
)"""


@query("agg15_transition_matrix", f"WITH {_LABEL} SELECT symbol, origin, target, round(probability, 6) AS probability FROM tm")
def _agg15(spark, sf_dir):
    return rounded(risk.transitions(risk.regimes(P.walk(spark, sf_dir))))


_STAT = _LABEL + """, m AS (SELECT symbol, list(probability ORDER BY origin, target) AS p FROM tm GROUP BY symbol), pw AS (
  SELECT symbol, p, list_reduce(range(1000), lambda a, i: {'a': a.a * p[1] + a.b * p[4] + a.c * p[7], 'b': a.a * p[2] + a.b * p[5] + a.c * p[8], 'c': a.a * p[3] + a.b * p[6] + a.c * p[9]}, {'a': 1/3::DOUBLE, 'b': 1/3::DOUBLE, 'c': 1/3::DOUBLE}) AS z FROM m)"""


@query("mat01_stationary", f"WITH {_STAT} SELECT symbol, round(z.a, 6) AS bear, round(z.b, 6) AS sideways, round(z.c, 6) AS bull FROM pw")
def _mat01(spark, sf_dir):
    return rounded(risk.stationary(risk.transitions(risk.regimes(P.walk(spark, sf_dir)))))


_FORWARD = _LABEL + """, ct AS (SELECT *, CASE WHEN idx > 20 THEN prv END AS frm FROM nx), run AS (
  SELECT *, """ + ", ".join(f"sum(({'frm = ' + str(i)} {c})::INT) OVER w AS {p}{i}" for p, c in (("u", "AND label = 2"), ("d", "AND label = 0"), ("t", "")) for i in range(3)) + """
  FROM ct WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)
), sg AS (SELECT symbol, day, idx, close, CASE WHEN coalesce([t0, t1, t2][label + 1], 0) > 0 THEN (coalesce([u0, u1, u2][label + 1], 0) - coalesce([d0, d1, d2][label + 1], 0)) / [t0, t1, t2][label + 1]::DOUBLE ELSE 0 END AS signal FROM run)"""


@query("win24_markov_signal", f"WITH {_FORWARD} SELECT symbol, day, round(signal, 6) AS signal FROM sg WHERE idx >= 252")
def _win24(spark, sf_dir):
    rows = risk.walk_forward(risk.regimes(P.walk(spark, sf_dir)))
    return rounded(rows.where("idx >= 252").select("symbol", "day", "signal"))


@query("win25_markov_backtest", f"""WITH {_FORWARD}, bt AS (SELECT symbol, day, idx, lag(signal) OVER w * (lead(close) OVER w / close - 1) AS r FROM sg WINDOW w AS (PARTITION BY symbol ORDER BY day)), eq AS (
  SELECT *, product(1 + r) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING) AS e FROM bt WHERE idx >= 252 AND r IS NOT NULL
), dw AS (SELECT *, 1 - e / greatest(1, max(e) OVER (PARTITION BY symbol ORDER BY day ROWS UNBOUNDED PRECEDING)) AS dd FROM eq)
SELECT symbol, round(avg(r) / stddev_pop(r) * sqrt(252), 6) AS sharpe, round(greatest(0, max(dd)), 6) AS max_drawdown, count(*) AS n_trades FROM dw GROUP BY symbol""")
def _win25(spark, sf_dir):
    return risk.walk_forward_backtest(risk.walk_forward(risk.regimes(P.walk(spark, sf_dir))), idle=float("nan"))


@query("skl08_markov", f"""WITH {_STAT}, now AS (SELECT symbol, arg_max(label, day) AS regime, count(*) AS n FROM lab GROUP BY symbol), o AS (
  SELECT n.symbol, n.regime, n.n, p[regime * 3 + 3] - p[regime * 3 + 1] AS signal, z, p FROM now n JOIN pw USING (symbol) WHERE n.n >= 30)
SELECT symbol, regime, n, round(signal, 6) AS signal, round(z.a, 6) AS bear, round(z.b, 6) AS sideways, round(z.c, 6) AS bull, round(p[1], 6) AS persistence_bear, round(p[5], 6) AS persistence_sideways, round(p[9], 6) AS persistence_bull,
  CASE WHEN signal > 0.3 THEN 'bullish' WHEN signal < -0.3 THEN 'bearish' ELSE 'neutral' END AS reading FROM o""")
def _skl08(spark, sf_dir):
    return rounded(risk.markov(P.walk(spark, sf_dir)))


_ALIGNED = P.WALK_SQL + """, k AS (SELECT day FROM walk GROUP BY day HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM walk) ORDER BY day DESC LIMIT 121), al AS (
  SELECT * FROM (SELECT symbol, day, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1, 10) AS ret FROM walk WHERE day IN (SELECT day FROM k)) WHERE ret IS NOT NULL
), pr AS (
  SELECT l.symbol AS a, r.symbol AS b, covar_samp(l.ret, r.ret) AS covariance, CASE WHEN l.symbol = r.symbol THEN 1 ELSE coalesce(corr(l.ret, r.ret), 0) END AS correlation FROM al l JOIN al r USING (day) WHERE l.symbol <= r.symbol GROUP BY l.symbol, r.symbol)"""


@query("join01_alignment", f"WITH {_ALIGNED} SELECT symbol, day, round(ret, 6) AS ret FROM al")
def _join01(spark, sf_dir):
    return rounded(alignment.aligned(P.walk(spark, sf_dir)))


@query("agg07_covariance", f"WITH {_ALIGNED} SELECT a, b, round(covariance * 10000, 6) AS covariance FROM pr")
def _agg07(spark, sf_dir):
    return alignment.pairs(alignment.aligned(P.walk(spark, sf_dir))).select("a", "b", F.round(F.col("covariance") * 10000, 6).alias("covariance"))


@query("agg08_correlation", f"WITH {_ALIGNED} SELECT a, b, round(correlation, 6) AS correlation FROM pr")
def _agg08(spark, sf_dir):
    return rounded(alignment.pairs(alignment.aligned(P.walk(spark, sf_dir))).select("a", "b", "correlation"))


@query("skl09_correlation_analysis", f"WITH {_ALIGNED} SELECT round(avg(correlation), 6) AS average_correlation, round(max(correlation), 6) AS max_correlation, count(*) AS pairs FROM pr WHERE a < b")
def _skl09(spark, sf_dir):
    return rounded(alignment.correlation_summary(alignment.pairs(alignment.aligned(P.walk(spark, sf_dir)))))


QUERIES["join20_pairs"], SQL["join20_pairs"] = QUERIES["agg08_correlation"], SQL["agg08_correlation"]


@query("mat02_simple_weights", f"""WITH {_ALIGNED}, v AS (SELECT symbol, 1 / greatest(stddev_samp(ret), 1e-8) AS raw FROM al GROUP BY symbol)
SELECT 'inverse_volatility' AS method, symbol, round(raw / sum(raw) OVER (), 6) AS weight FROM v UNION ALL SELECT 'equal_weight', symbol, round(1 / count(*) OVER (), 6) FROM v""")
def _mat02(spark, sf_dir):
    r = alignment.aligned(P.walk(spark, sf_dir))
    both = [rounded(alignment.simple_weights(r, m)).withColumn("method", F.lit(m)) for m in ("inverse_volatility", "equal_weight")]
    return both[0].unionByName(both[1])


@query("mat03_risk_parity")
def _mat03(spark, sf_dir):
    return rounded(alignment.optimised_weights(alignment.pairs(alignment.aligned(P.walk(spark, sf_dir))), "risk_parity"))


@query("mat04_maximum_diversification")
def _mat04(spark, sf_dir):
    return rounded(alignment.optimised_weights(alignment.pairs(alignment.aligned(P.walk(spark, sf_dir))), "maximum_diversification"))


@query("mat06_risk_contribution", f"""WITH {_ALIGNED}, w AS (SELECT symbol, 1 / greatest(stddev_samp(ret), 1e-8) AS raw FROM al GROUP BY symbol), ww AS (SELECT symbol, raw / sum(raw) OVER () AS weight FROM w), f AS (SELECT a, b, covariance FROM pr UNION ALL SELECT b, a, covariance FROM pr WHERE a < b), m AS (
  SELECT a AS symbol, sum(covariance * weight) AS m FROM f JOIN ww ON b = symbol GROUP BY a), c AS (SELECT symbol, weight, weight * m AS c FROM m JOIN ww USING (symbol))
SELECT symbol, round(weight, 6) AS weight, round(c / sum(c) OVER (), 6) AS risk_contribution, round(sqrt((sum(c) OVER ()) * 252), 6) AS volatility FROM c""")
def _mat06(spark, sf_dir):
    r = alignment.aligned(P.walk(spark, sf_dir))
    out = alignment.contributions(alignment.pairs(r), alignment.simple_weights(r, "inverse_volatility"))
    return rounded(out.withColumn("volatility", F.sqrt(F.col("variance") * 252)).drop("variance"))


@query("skl10_asset_allocation")
def _skl10(spark, sf_dir):
    m = alignment.pairs(alignment.aligned(P.walk(spark, sf_dir)))
    out = alignment.contributions(m, alignment.optimised_weights(m, "risk_parity"))
    return rounded(out.withColumn("volatility", F.sqrt(F.col("variance") * 252)).drop("variance"))


@query("win38_levels_to_returns", f"WITH {P.WALK_SQL}, lv AS (SELECT symbol, day, CASE WHEN day(day) = 11 THEN NULL ELSE close END AS value FROM walk) SELECT * FROM (SELECT symbol, lag(day) OVER w AS start_date, day AS end_date, round(value / lag(value) OVER w - 1, 6) AS value FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE value IS NOT NULL")
def _win38(spark, sf_dir):
    levels = P.walk(spark, sf_dir).select("symbol", "day", F.when(F.dayofmonth("day") != 11, F.col("close")).alias("value"))
    return rounded(alignment.from_levels(levels))


@query("join02_interval_equality", f"WITH {P.RETURNS_SQL} SELECT start_date, end_date, round(sum(value), 6) AS total FROM rets GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT symbol) FROM rets)")
def _join02(spark, sf_dir):
    rows = alignment.intervals_in_common(P.returns(spark, sf_dir))
    return rounded(rows.select("start_date", "end_date", F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, x: a + x).alias("total")))


QUERIES["set01_intersect"], SQL["set01_intersect"] = QUERIES["join02_interval_equality"], SQL["join02_interval_equality"]


@query("join04_panel_merge", f"""WITH {P.RETURNS_SQL}, a AS (SELECT start_date, end_date, max(value) FILTER (symbol = 'ASIA') AS x, max(value) FILTER (symbol = 'EUROPE') AS y FROM rets WHERE symbol IN ('ASIA', 'EUROPE') GROUP BY ALL HAVING count(*) = 2), b AS (SELECT start_date, end_date, value AS z FROM rets WHERE symbol = 'AFRICA')
SELECT start_date, end_date, round(x, 6) AS asia, round(y, 6) AS europe, round(z, 6) AS africa FROM a JOIN b USING (start_date, end_date)""")
def _join04(spark, sf_dir):
    r = P.returns(spark, sf_dir)
    merged = alignment.merge_panels([alignment.intervals_in_common(r.where("symbol in ('ASIA', 'EUROPE')")), alignment.intervals_in_common(r.where("symbol = 'AFRICA'"))])
    return rounded(merged.select("start_date", "end_date", *[F.col("values")[x].alias(x.lower()) for x in ("ASIA", "EUROPE", "AFRICA")]))


@query("join05_panel_projection", f"WITH {P.RETURNS_SQL} SELECT start_date, end_date, round(sum(value) FILTER (symbol IN ('ASIA', 'AMERICA')), 6) AS total, 2 AS kept FROM rets GROUP BY ALL HAVING count(*) = 5")
def _join05(spark, sf_dir):
    rows = alignment.keep_keys(alignment.intervals_in_common(P.returns(spark, sf_dir)), ["ASIA", "AMERICA"])
    return rounded(rows.select("start_date", "end_date", F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("values").alias("kept")))


@query("join06_fx_conversion", f"""WITH {P.RETURNS_SQL}, fx AS (SELECT day AS date, close / 100 AS level FROM walk WHERE symbol = 'EUROPE' AND day(day) <> 15)
SELECT symbol, start_date, end_date, round((1 + value) * e.level / s.level - 1, 6) AS value FROM rets JOIN fx s ON start_date = s.date JOIN fx e ON end_date = e.date WHERE symbol <> 'EUROPE'""")
def _join06(spark, sf_dir):
    fx = P.walk(spark, sf_dir).where("symbol = 'EUROPE' and dayofmonth(day) <> 15").select(F.col("day").alias("date"), (F.col("close") / 100).alias("level"))
    return rounded(alignment.converted(P.returns(spark, sf_dir).where("symbol <> 'EUROPE'"), fx).select("symbol", "start_date", "end_date", "value"))


@query("join07_previous_session", f"WITH {P.WALK_SQL}, s AS (SELECT DISTINCT day FROM walk) SELECT day, lag(day) OVER (ORDER BY day) AS previous FROM s")
def _join07(spark, sf_dir):
    from pyspark.sql import window as W

    return P.walk(spark, sf_dir).select("day").distinct().select("day", F.lag("day").over(W.Window.orderBy("day")).alias("previous"))


@query("join08_next_session", f"WITH {P.WALK_SQL}, s AS (SELECT DISTINCT day FROM walk), f AS (SELECT last_day(d::DATE) AS formation FROM range(DATE '1993-01-01', DATE '1997-12-02', INTERVAL 1 MONTH) t(d)) SELECT formation, (SELECT min(day) FROM s WHERE day > formation) AS entry FROM f")
def _join08(spark, sf_dir):
    months = spark.sql("SELECT last_day(d) AS formation FROM (SELECT explode(sequence(DATE '1993-01-01', DATE '1997-12-01', INTERVAL 1 MONTH)) AS d)")
    return alignment.next_session(months, P.walk(spark, sf_dir).select("day").distinct())


@query("agg11_compounded", f"WITH {P.RETURNS_SQL} SELECT symbol, round(product(1 + value) - 1, 6) AS total FROM rets GROUP BY symbol")
def _agg11(spark, sf_dir):
    return rounded(P.returns(spark, sf_dir).groupBy("symbol").agg((F.product(1 + F.col("value")) - 1).alias("total")))


_MONTHLY = P.RETURNS_SQL + """, ss AS (SELECT DISTINCT end_date AS day FROM rets WHERE symbol IN ('ASIA', 'EUROPE')), ex AS (SELECT last_day(day) AS month, count(*) AS e FROM ss GROUP BY ALL), mo AS (
  SELECT symbol, month, value FROM (SELECT symbol, last_day(end_date) AS month, count(DISTINCT end_date) AS n, product(1 + value) - 1 AS value FROM rets GROUP BY ALL) JOIN ex USING (month) WHERE n = e)"""


@query("agg12_complete_months", f"WITH {_MONTHLY} SELECT symbol, month, round(value, 6) AS value FROM mo")
def _agg12(spark, sf_dir):
    r = P.returns(spark, sf_dir)
    sessions = r.where("symbol in ('ASIA', 'EUROPE')").select(F.col("end_date").alias("day")).distinct()
    return rounded(alignment.monthly(r, sessions))


@query("src27_weekdays", "SELECT CAST(d AS DATE) AS day FROM range(DATE '2023-01-01', DATE '2024-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) <= 5")
def _src27(spark, sf_dir):
    return alignment.weekdays("2023-01-01", "2023-12-31", spark)


@query("fn05_06_formation_calendar", "SELECT last_day(d::DATE) AS formation, last_day((d + INTERVAL 1 MONTH)::DATE) AS following FROM range(DATE '1992-01-01', DATE '1998-12-02', INTERVAL 1 MONTH) t(d)")
def _fn06(spark, sf_dir):
    return spark.sql("SELECT f AS formation, last_day(add_months(f, 1)) AS following FROM (SELECT last_day(d) AS f FROM (SELECT explode(sequence(DATE '1992-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS d))")


@query("set02_union_set03_except", f"WITH {P.WALK_SQL}, a AS (SELECT DISTINCT day FROM walk WHERE symbol = 'ASIA'), b AS (SELECT DISTINCT day FROM walk WHERE symbol = 'EUROPE') SELECT 'union' AS what, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _set02(spark, sf_dir):
    w = P.walk(spark, sf_dir)
    a, b = (w.where(F.col("symbol") == x).select("day").distinct() for x in ("ASIA", "EUROPE"))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.join(b, "day", "left_anti"), "except"))
