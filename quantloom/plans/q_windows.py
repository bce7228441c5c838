"""Queries of bars: validity, trailing windows, weekly bars and recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import frames as fr
from quantloom.operators import indicators, validation
from quantloom.plans import panels as P

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The trailing indicators in SQL, over a table ``bars``.
FEATURES_SQL = P.BARS_SQL + """, f0 AS (
  SELECT *, row_number() OVER w AS n, round(close / lag(close) OVER w - 1, 10) AS ret, round(ln(close / lag(close) OVER w), 10) AS log_ret,
    close - lag(close) OVER w AS change, abs(close - lag(close) OVER w) AS move,
    CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
    coalesce(sign(close - lag(close) OVER w) * volume, 0) AS obv_step,
    max(high) OVER (w ROWS 8 PRECEDING) AS hi9, min(low) OVER (w ROWS 8 PRECEDING) AS lo9
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)
), f1 AS (
  SELECT *,
    CASE WHEN n >= 9 THEN CASE WHEN hi9 = lo9 THEN 50 ELSE (close - lo9) / (hi9 - lo9) * 100 END END AS rsv,
    CASE WHEN n >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma20,
    CASE WHEN n >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS sma50,
    CASE WHEN n >= 20 THEN stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS sdp,
    CASE WHEN n >= 20 THEN stddev_samp(close) OVER (w ROWS 19 PRECEDING) END AS sds,
    sum(obv_step) OVER (w ROWS UNBOUNDED PRECEDING) AS obv,
    CASE WHEN n >= 31 THEN CASE WHEN sum(move) OVER (w ROWS 29 PRECEDING) = 0 THEN 1 ELSE abs(close - lag(close, 30) OVER w) / sum(move) OVER (w ROWS 29 PRECEDING) END END AS efficiency,
    CASE WHEN n >= 64 THEN stddev_samp(log_ret) OVER (w ROWS 62 PRECEDING) * sqrt(252) END AS vol_log_63,
    CASE WHEN n >= 21 THEN stddev_samp(log_ret) OVER (w ROWS 19 PRECEDING) * sqrt(252) END AS vol_log_20,
    CASE WHEN n >= 21 THEN stddev_samp(ret) OVER (w ROWS 19 PRECEDING) * sqrt(252) END AS vol_simple_20,
    avg(volume) FILTER (change > 0) OVER (w ROWS 9 PRECEDING) AS up_v, avg(volume) FILTER (change < 0) OVER (w ROWS 9 PRECEDING) AS down_v,
    lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS momentum_12_1, close / lag(close, 10) OVER w - 1 AS momentum_10,
    CASE WHEN n >= 20 THEN volume / greatest(avg(volume) OVER (w ROWS 19 PRECEDING), 1e-12) END AS volume_ratio,
    round(coalesce(close / lag(close, 20) OVER w - 1, 0), 10) AS roll_20,
    CASE WHEN n >= 21 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS channel_high,
    CASE WHEN n >= 21 THEN min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS channel_low,
    close / max(close) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
    CASE WHEN n >= 14 THEN avg(tr) OVER (w ROWS 13 PRECEDING) END AS atr_simple
  FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY day)
), f2 AS (
  SELECT *, sma20 AS boll_middle, sma20 - 2 * sdp AS boll_lower, sma20 + 2 * sdp AS boll_upper, sma20 - 2 * sds AS boll_lower_s, sma20 + 2 * sds AS boll_upper_s,
    CASE WHEN n < 11 THEN NULL WHEN down_v IS NULL THEN CASE WHEN up_v IS NULL THEN 1 ELSE 2 END WHEN up_v IS NULL THEN 0.5 WHEN down_v = 0 THEN 2 ELSE up_v / down_v END AS up_down,
    CASE WHEN n >= 11 THEN avg(rsv) OVER (w ROWS 2 PRECEDING) WHEN n >= 9 THEN rsv END AS k,
    CASE WHEN n >= 9 THEN avg(rsv) OVER (w ROWS 2 PRECEDING) END AS k_head,
    CASE WHEN n >= 21 THEN (obv - lag(obv, 20) OVER w) / greatest(sum(volume) OVER (w ROWS 19 PRECEDING), 1) END AS obv_trend,
    CASE WHEN n > 20 THEN CASE WHEN roll_20 >= 0.05 THEN 2 WHEN roll_20 <= -0.05 THEN 0 ELSE 1 END ELSE 1 END AS regime
  FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY day)
), f3 AS (
  SELECT *, CASE WHEN n >= 11 THEN avg(k_head) OVER (w ROWS 2 PRECEDING) END AS d FROM f2 WINDOW w AS (PARTITION BY symbol ORDER BY day)
), features AS (SELECT *, 3 * k - 2 * d AS j FROM f3)"""

#: Query name: indicator columns.
_TRAILING = {
    "win01_sma": ["sma20"],
    "win02_sma_series": ["sma20", "sma50"],
    "win07_bollinger": ["boll_lower", "boll_middle", "boll_upper", "boll_lower_s", "boll_upper_s"],
    "win08_true_range": ["tr"],
    "win11_kdj": ["k", "d", "j"],
    "win13_on_balance_volume": ["obv"],
    "win14_obv_trend": ["obv_trend"],
    "win15_efficiency_ratio": ["efficiency"],
    "win16_volatility_log": ["vol_log_63"],
    "win17_volatility_simple": ["vol_simple_20"],
    "win18_up_down_volume": ["up_down"],
    "win19_momentum_12_1": ["momentum_12_1"],
    "win20_momentum_n": ["momentum_10"],
    "win22_rolling_return": ["roll_20"],
    "win23_regime_label": ["regime"],
    "win27_volume_ratio": ["volume_ratio"],
    "win33_prior_channel": ["channel_high", "channel_low"],
    "agg06_drawdown_series": ["drawdown"],
    "fn09_returns": ["ret", "log_ret"],
}


def _trailing(columns):
    def run(spark, sf_dir):
        out = indicators.trailing(P.bars(spark, sf_dir))
        return out.select("symbol", "day", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns])

    return run


for _name, _columns in _TRAILING.items():
    QUERIES[_name] = _trailing(_columns)
    SQL[_name] = f"WITH {FEATURES_SQL} SELECT symbol, day, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in _columns)} FROM features"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_VALID_SQL = "close > 0 AND isfinite(close) AND coalesce(open > 0, true) AND coalesce(high > 0, true) AND coalesce(low > 0, true) AND coalesce(volume >= 0, true) AND coalesce(high >= low, true) AND coalesce(high >= close, true) AND coalesce(low <= close, true) AND coalesce(low <= open, true) AND coalesce(open <= high, true)"


def _marred(spark, sf_dir):
    """bars() with some rows made invalid, incomplete or repeated, for the checks of validity."""
    b = P.bars(spark, sf_dir).withColumn("d", F.dayofmonth("day"))
    b = b.withColumn("high", F.when(F.col("d") == 3, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(F.col("d") == 5, None).otherwise(F.col("volume")))
    b = b.withColumn("close", F.when(F.col("d") == 7, F.lit(float("nan"))).otherwise(F.col("close")))
    return b.union(b.where("d = 9")).drop("d")


_MARRED_SQL = P.BARS_SQL + """, m AS (
  SELECT symbol, day, open, CASE WHEN day(day) = 3 THEN low - 1 ELSE high END AS high, low, CASE WHEN day(day) = 7 THEN 'nan'::DOUBLE ELSE close END AS close, CASE WHEN day(day) = 5 THEN NULL ELSE volume END AS volume FROM bars
), marred AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE day(day) = 9)"""


@query("flt01_bar_validity", f"WITH {_MARRED_SQL} SELECT symbol, day, ({_VALID_SQL}) AS valid, (open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND volume IS NOT NULL) AS complete FROM marred")
def _flt01(spark, sf_dir):
    return _marred(spark, sf_dir).select("symbol", "day", validation.valid_bar().alias("valid"), validation.complete_bar().alias("complete"))


@query("flt02_validate_dedupe", f"WITH {_MARRED_SQL}, v AS (SELECT *, count(*) OVER (PARTITION BY symbol, day) AS c FROM marred WHERE {_VALID_SQL}) SELECT symbol, day, round(close, 6) AS close FROM v WHERE c = 1")
def _flt02(spark, sf_dir):
    return validation.validated(_marred(spark, sf_dir)).select("symbol", "day", F.round("close", 6).alias("close"))


@query("flt02_quality_flags", f"""WITH {_MARRED_SQL}, o AS (SELECT *, ({_VALID_SQL}) AS ok FROM marred), k AS (SELECT *, ok AND sum(ok::INT) OVER (PARTITION BY symbol, day) = 1 AS kept FROM o)
SELECT symbol, count(*) AS rows, sum(kept::INT)::BIGINT AS kept, bool_or(NOT kept) AS discarded, bool_or(kept AND volume IS NULL) AS incomplete FROM k GROUP BY symbol""")
def _flt02b(spark, sf_dir):
    return validation.bar_quality(_marred(spark, sf_dir))


@query("flt04_instrument", f"WITH {P.BARS_SQL} SELECT count(*) AS n FROM bars WHERE upper(symbol) = 'ASIA'")
def _flt04(spark, sf_dir):
    rows = P.bars(spark, sf_dir).withColumn("market", F.when(F.dayofmonth("day") % 2 == 0, " us ").otherwise(""))
    return rows.where(validation.instrument("asia", "US")).agg(F.count("*").alias("n"))


@query("flt05_series_tail", f"WITH {P.WALK_SQL} SELECT symbol, day, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM walk) WHERE r <= 120")
def _flt05(spark, sf_dir):
    return validation.tail(P.walk(spark, sf_dir), 120).select("symbol", "day", F.round("close", 6).alias("close"))


@query("flt06_start_index", f"WITH {P.WALK_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS n FROM walk) SELECT symbol, min(n) AS start_index FROM i WHERE day >= DATE '1995-01-01' GROUP BY symbol")
def _flt06(spark, sf_dir):
    rows = P.walk(spark, sf_dir).withColumn("n", (fr.Series().number - 1).cast("bigint"))
    return rows.where("day >= DATE '1995-01-01'").groupBy("symbol").agg(F.min("n").alias("start_index"))


@query("flt07_daily_gate", f"WITH {P.WALK_SQL}, g AS (SELECT symbol, (day - lag(day) OVER (PARTITION BY symbol ORDER BY day))::DOUBLE AS gap FROM walk) SELECT symbol, quantile_cont(gap, 0.5) AS median_gap, quantile_cont(gap, 0.5) BETWEEN 20 / 24.0 AND 4 AS is_daily FROM g GROUP BY symbol")
def _flt07(spark, sf_dir):
    return validation.daily(P.walk(spark, sf_dir))


@query("flt19_outcome_adapter", f"WITH {P.BARS_SQL} SELECT symbol, day, close AS value, high, low, 'high_low' AS basis FROM bars")
def _flt19(spark, sf_dir):
    return validation.outcomes_of(P.bars(spark, sf_dir))


_WEEKS_SQL = P.BARS_SQL + """, weeks AS (
  SELECT symbol, isoyear(day) AS iso_year, weekofyear(day) AS iso_week, arg_min(open, day) AS open, max(high) AS high, min(low) AS low, arg_max(close, day) AS close, sum(volume) AS volume, max(day) AS day
  FROM bars GROUP BY symbol, isoyear(day), weekofyear(day))"""


@query("agg13_weekly_bars", f"WITH {_WEEKS_SQL} SELECT symbol, iso_year::INT AS iso_year, iso_week::INT AS iso_week, open, high, low, close, volume, day FROM weeks")
def _agg13(spark, sf_dir):
    return indicators.weekly(P.bars(spark, sf_dir))


@query("win21_weekly_alignment", f"""WITH {_WEEKS_SQL}, a AS (SELECT symbol, day, row_number() OVER w AS n, avg(close) OVER (w ROWS 4 PRECEDING) AS m5, avg(close) OVER (w ROWS 9 PRECEDING) AS m10, avg(close) OVER (w ROWS 19 PRECEDING) AS m20, avg(close) OVER (w ROWS 29 PRECEDING) AS m30
  FROM weeks WINDOW w AS (PARTITION BY symbol ORDER BY day)), z AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r FROM a)
SELECT symbol, CASE WHEN n >= 30 THEN m5 < m10 AND m10 < m20 AND m20 < m30 AND (m30 - m5) / m30 >= 0.01 END AS bearish, CASE WHEN n >= 30 THEN round_even((m30 - m5) / m30, 4) END AS alignment_strength FROM z WHERE r = 1""")
def _win21(spark, sf_dir):
    return indicators.weekly_alignment(indicators.weekly(P.bars(spark, sf_dir)))


def _fold_sql(values: str, n: int, alpha: str) -> str:
    return f"list_reduce(({values})[{n + 1}:], lambda a, x: a + (x - a) * ({alpha}), list_sum(({values})[1:{n}]) / {n})"


_LISTS_SQL = FEATURES_SQL + """, l AS (
  SELECT symbol, list(close ORDER BY day)::DOUBLE[] AS c, list(tr ORDER BY day)::DOUBLE[] AS t, list(greatest(change, 0) ORDER BY day) FILTER (change IS NOT NULL)::DOUBLE[] AS g,
    list(greatest(-change, 0) ORDER BY day) FILTER (change IS NOT NULL)::DOUBLE[] AS ls FROM features GROUP BY symbol)"""
_G, _L = _fold_sql("g", 14, "1/14::DOUBLE"), _fold_sql("ls", 14, "1/14::DOUBLE")
_LATEST_SQL = f"WITH {_LISTS_SQL} SELECT symbol, round({_fold_sql('c', 20, '2/21::DOUBLE')}, 6) AS ema20, round(100 - 100 / (1 + {_G} / {_L}), 6) AS rsi14, round({_fold_sql('t', 14, '1/14::DOUBLE')}, 6) AS atr14 FROM l"


@query("win03_04_09_latest_fold", _LATEST_SQL)
def _latest(spark, sf_dir):
    return indicators.latest(P.bars(spark, sf_dir)).select("symbol", *[F.round(c, 6).alias(c) for c in ("ema20", "rsi14", "atr14")])


def _last_rows(df, columns):
    out = df.groupBy("symbol").agg(*[F.max_by(c, "day").alias(c) for c in columns])
    return out.select("symbol", *[F.round(c, 6).alias(c) for c in columns])


@query("win03_04_09_series_last", _LATEST_SQL)
def _series_last(spark, sf_dir):
    return _last_rows(indicators.recurrences(P.bars(spark, sf_dir)), ("ema20", "rsi14", "atr14"))


#: EMA, RSI, ATR and directional series bar by bar, in SQL.
RECURRENT_SQL = FEATURES_SQL.replace("bars AS (", "bars AS MATERIALIZED (") + """, steps AS MATERIALIZED (
  SELECT symbol, day, n, close, high, low, open, tr, greatest(change, 0)::DOUBLE AS up, greatest(-change, 0)::DOUBLE AS dn FROM features
), seeds AS (
  SELECT symbol, avg(close) FILTER (n <= 5) AS e5, avg(close) FILTER (n <= 10) AS e10, avg(close) FILTER (n <= 12) AS e12, avg(close) FILTER (n <= 20) AS e20, avg(close) FILTER (n <= 26) AS e26,
    avg(up) FILTER (n BETWEEN 2 AND 15) AS g14, avg(dn) FILTER (n BETWEEN 2 AND 15) AS l14, avg(up) FILTER (n BETWEEN 2 AND 7) AS g6, avg(dn) FILTER (n BETWEEN 2 AND 7) AS l6,
    avg(tr) FILTER (n <= 14) AS a14, avg(tr) FILTER (n <= 20) AS a20, avg(tr) FILTER (n <= 60) AS a60 FROM steps GROUP BY symbol
), lists AS MATERIALIZED (
  SELECT symbol, list({'close': close, 'up': up, 'dn': dn, 'tr': tr} ORDER BY n) AS b, max(n) AS size FROM steps GROUP BY symbol
), rec(symbol, i, e5, e10, e12, e20, e26, g14, l14, g6, l6, a14, a20, a60) AS (
  WITH RECURSIVE r AS (
    SELECT s.symbol, 1 AS i, e5, e10, e12, e20, e26, g14, l14, g6, l6, a14, a20, a60 FROM seeds s
    UNION ALL
    SELECT r.symbol, r.i + 1, """ + ", ".join(
    f"CASE WHEN r.i + 1 > {n} THEN {v} + (l.b[r.i + 1].{x} - {v}) * {a}::DOUBLE ELSE {v} END"
    for v, n, x, a in (("e5", 5, "close", 2 / 6), ("e10", 10, "close", 2 / 11), ("e12", 12, "close", 2 / 13), ("e20", 20, "close", 2 / 21), ("e26", 26, "close", 2 / 27), ("g14", 15, "up", 1 / 14), ("l14", 15, "dn", 1 / 14), ("g6", 7, "up", 1 / 6), ("l6", 7, "dn", 1 / 6), ("a14", 14, "tr", 1 / 14), ("a20", 20, "tr", 1 / 20), ("a60", 60, "tr", 1 / 60))
) + """ FROM r JOIN lists l ON l.symbol = r.symbol WHERE r.i < l.size
  ) SELECT * FROM r
), recurrent AS MATERIALIZED (
  SELECT s.*, CASE WHEN n >= 5 THEN e5 END AS ema5, CASE WHEN n >= 10 THEN e10 END AS ema10, CASE WHEN n >= 20 THEN e20 END AS ema20,
    CASE WHEN n >= 15 THEN CASE WHEN l14 = 0 THEN CASE WHEN g14 > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g14 / l14) END END AS rsi14,
    CASE WHEN n >= 7 THEN CASE WHEN l6 = 0 THEN CASE WHEN g6 > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + g6 / l6) END END AS rsi6,
    CASE WHEN n >= 26 THEN e12 - e26 END AS macd, CASE WHEN n >= 14 THEN a14 END AS atr14, CASE WHEN n >= 20 THEN a20 END AS atr20, CASE WHEN n >= 60 THEN a60 END AS atr60
  FROM steps s JOIN rec r ON r.symbol = s.symbol AND r.i = s.n)"""


def _recurrent(name, columns):
    @query(name, f"WITH {RECURRENT_SQL} SELECT symbol, day, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM recurrent")
    def run(spark, sf_dir):
        return indicators.recurrences(P.bars(spark, sf_dir)).select("symbol", "day", *[F.round(c, 6).alias(c) for c in columns])


_recurrent("win03_ema_series", ["ema5", "ema10", "ema20"])
_recurrent("win04_wilder_rsi", ["rsi6", "rsi14"])
_recurrent("win05_macd_line", ["macd"])
_recurrent("win09_wilder_atr", ["atr14", "atr20", "atr60"])


@query("win06_macd_signal", f"""WITH {RECURRENT_SQL}, m AS (SELECT symbol, list(macd ORDER BY n) FILTER (macd IS NOT NULL) AS v FROM recurrent GROUP BY symbol), s AS (SELECT symbol, v[-1] AS macd, {_fold_sql('v', 9, '2/10::DOUBLE')} AS signal FROM m)
SELECT symbol, round(macd, 6) AS macd, round(signal, 6) AS macd_signal, round(macd - signal, 6) AS macd_hist FROM s""")
def _win06(spark, sf_dir):
    return _last_rows(indicators.recurrences(P.bars(spark, sf_dir)), ("macd", "macd_signal", "macd_hist"))


@query("win12_adx", f"""WITH {FEATURES_SQL}, dm AS (
  SELECT symbol, n, tr, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM features WINDOW w AS (PARTITION BY symbol ORDER BY day)
), l AS (
  SELECT symbol, list({{'t': tr::DOUBLE, 'p': (CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END)::DOUBLE, 'm': (CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END)::DOUBLE}} ORDER BY n) AS b FROM dm WHERE n > 1 GROUP BY symbol
), f AS (
  SELECT symbol, list_reduce(b[15:], lambda a, x: {{'t': (a.t * 13 + x.t) / 14, 'p': (a.p * 13 + x.p) / 14, 'm': (a.m * 13 + x.m) / 14,
      'dx': list_append(a.dx, abs((a.p * 13 + x.p) - (a.m * 13 + x.m)) / ((a.p * 13 + x.p) + (a.m * 13 + x.m)) * 100)}},
    {{'t': list_avg(list_transform(b[1:14], lambda x: x.t)), 'p': list_avg(list_transform(b[1:14], lambda x: x.p)), 'm': list_avg(list_transform(b[1:14], lambda x: x.m)), 'dx': []::DOUBLE[]}}) AS z FROM l
)
SELECT symbol, round(list_reduce(z.dx[15:], lambda a, x: (a * 13 + x) / 14, list_avg(z.dx[1:14])), 6) AS adx, round(z.p / z.t * 100, 6) AS plus_di, round(z.m / z.t * 100, 6) AS minus_di FROM f""")
def _win12(spark, sf_dir):
    return _last_rows(indicators.recurrences(P.bars(spark, sf_dir)), ("adx", "plus_di", "minus_di"))


@query("win28_cross_over", f"WITH {FEATURES_SQL}, c AS (SELECT symbol, day, round(sma20, 8) AS l, round(sma50, 8) AS r FROM features) SELECT * FROM (SELECT symbol, day, coalesce(lag(l) OVER w <= lag(r) OVER w AND l > r, false) AS up, coalesce(lag(l) OVER w >= lag(r) OVER w AND l < r, false) AS down FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE up OR down")
def _win28(spark, sf_dir):
    s = fr.Series()
    f = indicators.trailing(P.bars(spark, sf_dir)).select("symbol", "day", F.round("sma20", 8).alias("l"), F.round("sma50", 8).alias("r"))
    up, down = fr.crossed(s, "l", "r")
    return f.select("symbol", "day", up.alias("up"), down.alias("down")).where("up or down")


@query("win29_threshold_cross", f"WITH {RECURRENT_SQL}, c AS (SELECT symbol, day, round(rsi14, 8) AS v FROM recurrent), e AS (SELECT symbol, day, coalesce(v <= 48 AND (lag(v) OVER w IS NULL OR lag(v) OVER w > 48), false) AS fell, coalesce(v >= 52 AND (lag(v) OVER w IS NULL OR lag(v) OVER w < 52), false) AS rose FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)) SELECT * FROM e WHERE fell OR rose")
def _win29(spark, sf_dir):
    s = fr.Series()
    f = indicators.recurrences(P.bars(spark, sf_dir)).select("symbol", "day", F.round("rsi14", 8).alias("v"))
    fell, rose = fr.entered(s, "v", 48, 52)
    return f.select("symbol", "day", fell.alias("fell"), rose.alias("rose")).where("fell or rose")
