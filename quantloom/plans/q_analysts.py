"""Queries of the composite analysts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import analysts
from quantloom.plans import panels as P
from quantloom.plans.q_risk import rounded
from quantloom.plans.q_windows import FEATURES_SQL, RECURRENT_SQL, _fold_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_LAST = RECURRENT_SQL + """, mh AS (SELECT symbol, list(macd ORDER BY n) FILTER (macd IS NOT NULL) AS v FROM recurrent GROUP BY symbol), sg AS (SELECT symbol, v[-1] - """ + _fold_sql("v", 9, "2/10::DOUBLE") + """ AS macd_hist, """ + _fold_sql("v", 9, "2/10::DOUBLE") + """ AS macd_signal FROM mh), tech AS (
  SELECT f.*, r.ema20, r.rsi14, r.macd, r.atr14, first_value(f.close) OVER (PARTITION BY f.symbol ORDER BY f.day) AS c0, avg(f.volume) OVER (PARTITION BY f.symbol ORDER BY f.day ROWS 19 PRECEDING) AS v1, avg(f.volume) OVER (PARTITION BY f.symbol ORDER BY f.day ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING) AS v0, row_number() OVER (PARTITION BY f.symbol ORDER BY f.day DESC) AS back
  FROM features f JOIN recurrent r ON r.symbol = f.symbol AND r.n = f.n)"""


@query("skl02_technical", f"WITH {_LAST} SELECT symbol, round(close / c0 - 1, 6) AS price_return, {', '.join(f'round({c}, 6) AS {c}' for c in 'sma20 ema20 boll_lower boll_middle boll_upper rsi14 macd macd_signal macd_hist atr14 momentum_10 vol_simple_20'.split())}, round(v1 / v0 - 1, 6) AS volume_trend FROM tech JOIN sg USING (symbol) WHERE back = 1")
def _skl02(spark, sf_dir):
    return rounded(analysts.technical(P.bars(spark, sf_dir)))


@query("agg22_volume_trend", f"WITH {_LAST} SELECT symbol, round(v1 / v0 - 1, 6) AS volume_trend FROM tech WHERE back = 1")
def _agg22(spark, sf_dir):
    return rounded(analysts.technical(P.bars(spark, sf_dir)).select("symbol", "volume_trend"))


@query("skl04_technical_basic")
def _skl04(spark, sf_dir):
    return rounded(analysts.technical_basic(P.bars(spark, sf_dir)))


def _gappy(spark, sf_dir):
    return P.bars(spark, sf_dir).withColumn("volume", F.when(F.dayofmonth("day") != 13, F.col("volume")))


_GAPPY = P.BARS_SQL + """, g0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS src FROM bars), g1 AS (SELECT * FROM g0 WHERE day(day) <> 13), g2 AS (
  SELECT *, row_number() OVER w - 1 AS idx, coalesce(src - lag(src) OVER w = 1, false) AS follows, lag(close) OVER w AS pc FROM g1 WINDOW w AS (PARTITION BY symbol ORDER BY day)
), g3 AS (SELECT *, sum((NOT follows)::INT) OVER (PARTITION BY symbol ORDER BY day) AS island, CASE WHEN follows THEN greatest(high - low, abs(high - pc), abs(low - pc)) ELSE high - low END AS tr FROM g2), g4 AS (
  SELECT *, CASE WHEN count(*) OVER w = 14 THEN round(avg(tr) OVER w, 8) END AS atr FROM g3 WINDOW w AS (PARTITION BY symbol, island ORDER BY day ROWS 13 PRECEDING))"""


@query("win10_causal_atr", f"WITH {_GAPPY} SELECT symbol, day, follows, round(atr, 6) AS atr FROM g4")
def _win10(spark, sf_dir):
    return rounded(analysts.with_gaps(_gappy(spark, sf_dir)).select("symbol", "day", "follows", "atr"))


QUERIES["pas02_consecutive_mask"], SQL["pas02_consecutive_mask"] = QUERIES["win10_causal_atr"], SQL["win10_causal_atr"]


@query("pas01_candle_events", f"""WITH {_GAPPY}, e AS (SELECT symbol, day, open o, high h, low l, close c, atr a, CASE WHEN follows THEN lag(open) OVER w END po, CASE WHEN follows THEN lag(high) OVER w END ph, CASE WHEN follows THEN lag(low) OVER w END pl, CASE WHEN follows THEN lag(close) OVER w END pc FROM g4 WINDOW w AS (PARTITION BY symbol ORDER BY day)), m AS (
  SELECT *, h - l AS s, abs(c - o) AS b, h - greatest(o, c) AS u, least(o, c) - l AS d FROM e WHERE h > l)
SELECT symbol, day, CASE WHEN d / s >= 0.6 AND u / s < 0.15 THEN 'bullish_rejection' ELSE 'bearish_rejection' END AS event FROM m WHERE s >= round(0.4 * a, 8) AND b / s < 0.3 AND ((d / s >= 0.6 AND u / s < 0.15) OR (u / s >= 0.6 AND d / s < 0.15))
UNION ALL SELECT symbol, day, 'inside_bar' FROM m WHERE h < ph AND l > pl
UNION ALL SELECT symbol, day, 'bullish_engulfing' FROM m WHERE s >= round(0.3 * a, 8) AND b > abs(pc - po) AND pc < po AND c > o AND o <= pc AND c >= po
UNION ALL SELECT symbol, day, 'bearish_engulfing' FROM m WHERE s >= round(0.3 * a, 8) AND b > abs(pc - po) AND pc > po AND c < o AND o >= pc AND c <= po""")
def _pas01(spark, sf_dir):
    return analysts.candle_events(analysts.with_gaps(_gappy(spark, sf_dir)))


_PIVOTS = _GAPPY + """, v AS (SELECT *, count(*) OVER a AS na, count(*) OVER b AS nb, max(high) OVER a AS ha, max(high) OVER b AS hb, min(low) OVER a AS la, min(low) OVER b AS lb FROM g4
  WINDOW a AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), pv AS (
  SELECT symbol, day, idx, 'high' AS kind, high AS price FROM v WHERE na = 3 AND nb = 3 AND high > ha AND high > hb UNION ALL SELECT symbol, day, idx, 'low', low FROM v WHERE na = 3 AND nb = 3 AND low < la AND low < lb
), pl AS (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY idx) AS was FROM pv)"""


@query("win30_31_pivots", f"WITH {_PIVOTS} SELECT symbol, day, kind, price, CASE WHEN was IS NULL THEN NULL WHEN kind = 'high' THEN CASE WHEN price > was THEN 'HH' ELSE 'LH' END ELSE CASE WHEN price > was THEN 'HL' ELSE 'LL' END END AS label FROM pl")
def _win30(spark, sf_dir):
    return analysts.pivots(analysts.with_gaps(_gappy(spark, sf_dir))).select("symbol", "day", "kind", "price", "label")


@query("pas03_structure", f"""WITH {_PIVOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY idx DESC) AS r FROM pl), d AS (SELECT symbol, max(price - was) FILTER (kind = 'high') AS h, max(price - was) FILTER (kind = 'low') AS l FROM r WHERE r = 1 GROUP BY symbol)
SELECT symbol, CASE WHEN h IS NULL OR l IS NULL THEN 'unavailable' WHEN h > 0 AND l > 0 THEN 'uptrend' WHEN h < 0 AND l < 0 THEN 'downtrend' ELSE 'mixed' END AS structure FROM d""")
def _pas03(spark, sf_dir):
    return analysts.structure(analysts.pivots(analysts.with_gaps(_gappy(spark, sf_dir))))


_ZONES = _PIVOTS + """, sc AS (SELECT symbol, arg_max(close, day) AS close, 900.0::DOUBLE AS atr14 FROM g4 GROUP BY symbol), zl AS (SELECT symbol, list({'price': price, 'idx': idx, 'kind': kind, 'day': day} ORDER BY price, idx, kind, day) AS p FROM pv GROUP BY symbol), zf AS (
  SELECT symbol, atr14, close, list_reduce(p, lambda a, x: CASE WHEN len(a.now) > 0 AND abs(x.price - a.total / len(a.now)) <= round(atr14 * 0.5, 8) THEN {'total': a.total + x.price, 'now': list_append(a.now, x), 'done': a.done}
    ELSE {'total': x.price, 'now': [x], 'done': CASE WHEN len(a.now) > 0 THEN list_append(a.done, a.now) ELSE a.done END} END, {'total': 0::DOUBLE, 'now': p[1:0], 'done': [p][1:0]}) AS z FROM zl JOIN sc USING (symbol)
), ze AS (SELECT symbol, atr14, close, unnest(list_append(z.done, z.now)) AS c FROM zf), zz AS (
  SELECT symbol, close, CASE WHEN len(list_distinct(list_transform(c, lambda x: x.kind))) > 1 THEN 'flip' WHEN list_contains(list_transform(c, lambda x: x.kind), 'high') THEN 'resistance' ELSE 'support' END AS kind, list_min(list_transform(c, lambda x: x.price)) - atr14 * 0.1 AS lower, list_avg(list_transform(c, lambda x: x.price)) AS midpoint, list_max(list_transform(c, lambda x: x.price)) + atr14 * 0.1 AS upper, len(c)::INT AS touch_count, list_max(list_transform(c, lambda x: x.day)) AS last_touched FROM ze WHERE len(c) >= 2
)"""


@query("pas04_zones", f"WITH {_ZONES} SELECT symbol, kind, round(lower, 4) AS lower, round(midpoint, 4) AS midpoint, round(upper, 4) AS upper, touch_count, last_touched FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY touch_count DESC, last_touched DESC, abs(midpoint - close)) AS r FROM zz) WHERE r <= 8")
def _pas04(spark, sf_dir):
    rows = analysts.with_gaps(_gappy(spark, sf_dir))
    scale = rows.groupBy("symbol").agg(F.max_by("close", "day").alias("close")).withColumn("atr14", F.lit(900.0))
    return rounded(analysts.zones(analysts.pivots(rows), scale), 4)


QUERIES["srt02_zone_ranking"], SQL["srt02_zone_ranking"] = QUERIES["pas04_zones"], SQL["pas04_zones"]


@query("skl07_price_action")
def _skl07(spark, sf_dir):
    from quantloom.operators import indicators, validation

    bars = validation.tail(P.bars(spark, sf_dir), 252)
    rows = analysts.with_gaps(bars)
    found = analysts.pivots(rows)
    scale = analysts.last_values(indicators.recurrences(bars), ["atr14", "close"])
    nearest = analysts.zones(found, scale).groupBy("symbol").agg(F.count("*").alias("zones"))
    events = analysts.candle_events(rows).groupBy("symbol").agg(F.count("*").alias("events"))
    return analysts.structure(found).join(nearest, "symbol", "left").join(events, "symbol", "left").fillna(0)


def _worth(spark, sf_dir):
    b = P.bars(spark, sf_dir)
    return analysts.worth_buy(b, analysts.relative_strength(b, b.where("symbol = 'AMERICA'")))


@query("skl11_worth_buy_stocks")
def _skl11(spark, sf_dir):
    return rounded(_worth(spark, sf_dir), 4)


_ALPHA = FEATURES_SQL + """, al AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM features)"""


@query("wbs01_alpha_composite", f"WITH {_ALPHA} SELECT symbol, round_even(coalesce((greatest(-0.5, least(0.5, momentum_12_1)) + 0.5) * 100 * 0.55, 0) + coalesce(efficiency * 100 * (0.10 / 0.65), 0), 2) AS composite FROM al WHERE back = 1")
def _wbs01(spark, sf_dir):
    return analysts.worth_buy(P.bars(spark, sf_dir)).select("symbol", "composite")


@query("wbs02_risk_veto", f"""WITH {_ALPHA}, m AS (SELECT symbol, close, back, avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING) AS m60, avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS 199 PRECEDING) AS m200, vol_log_63 FROM al), t AS (SELECT symbol, close / max(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS dd FROM al WHERE back <= 252), d AS (SELECT symbol, min(dd) AS dd FROM t GROUP BY symbol),
wk AS (SELECT symbol, isoyear(day) AS y, weekofyear(day) AS w, arg_max(close, day) AS close, max(day) AS day FROM bars GROUP BY ALL), wa AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS r, avg(close) OVER (w ROWS 4 PRECEDING) AS a5, avg(close) OVER (w ROWS 9 PRECEDING) AS a10, avg(close) OVER (w ROWS 19 PRECEDING) AS a20, avg(close) OVER (w ROWS 29 PRECEDING) AS a30 FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, least(100, CASE WHEN close < m60 AND m60 < m200 THEN 30 WHEN close < m60 THEN 15 ELSE 0 END + CASE WHEN dd < -0.2 THEN 25 WHEN dd < -0.1 THEN 10 ELSE 0 END + CASE WHEN a5 < a10 AND a10 < a20 AND a20 < a30 AND (a30 - a5) / a30 >= 0.01 THEN 20 ELSE 0 END + CASE WHEN vol_log_63 > 0.5 THEN 10 ELSE 0 END)::DOUBLE AS risk
FROM m JOIN d USING (symbol) JOIN wa USING (symbol) WHERE back = 1 AND r = 1""")
def _wbs02(spark, sf_dir):
    return analysts.worth_buy(P.bars(spark, sf_dir)).select("symbol", "risk")


for _n, _cols in (("wbs03_confirmation", ["blocks"]), ("wbs05_entry_class", ["entry_class"]), ("wbs06_reversal_count", ["reversal_signals"]), ("wbs07_verdict", ["verdict"])):
    QUERIES[_n] = lambda spark, sf_dir, cols=_cols: _worth(spark, sf_dir).select("symbol", *cols)


@query("wbs04_levels", f"""WITH {RECURRENT_SQL}, m AS (SELECT symbol, close, n, row_number() OVER (PARTITION BY symbol ORDER BY n DESC) AS back, avg(close) OVER (w ROWS 59 PRECEDING) AS m60, min(low) OVER (w ROWS 19 PRECEDING) AS l20, max(high) OVER (w ROWS 251 PRECEDING) AS h252, atr14 FROM recurrent WINDOW w AS (PARTITION BY symbol ORDER BY n))
SELECT symbol, close AS entry_price, round_even(least(m60, l20) - atr14, 2) AS stop_price, h252 AS target_price FROM m WHERE back = 1""")
def _wbs04(spark, sf_dir):
    return analysts.worth_buy(P.bars(spark, sf_dir)).select("symbol", "entry_price", "stop_price", "target_price")


@query("join18_relative_strength", f"""WITH {P.BARS_SQL}, r AS (SELECT symbol, {', '.join(f'close / lag(close, {n}) OVER w - 1 AS r{n}' for n in (21, 63, 126))}, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)), l AS (SELECT * FROM r WHERE back = 1), b AS (SELECT r21 AS b21, r63 AS b63, r126 AS b126 FROM l WHERE symbol = 'AMERICA')
SELECT symbol, round(({' + '.join(f'greatest(0, least(1, (r{n} - b{n} + 0.2) / 0.4)) * 100' for n in (21, 63, 126))}) / 3, 6) AS relative_strength FROM l, b""")
def _join18(spark, sf_dir):
    b = P.bars(spark, sf_dir)
    return rounded(analysts.relative_strength(b, b.where("symbol = 'AMERICA'")))
