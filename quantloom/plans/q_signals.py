"""Queries of signals and their outcomes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quantloom.operators import evaluation as ev
from quantloom.operators import signals
from quantloom.plans import panels as P
from quantloom.plans.q_risk import _FORWARD, rounded
from quantloom.plans.q_windows import FEATURES_SQL, RECURRENT_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = re.sub(r"\bat\b", '"at"', sql)  # a keyword in some places
        return f

    return put


def _side(long: str, short: str) -> str:
    return f"CASE WHEN {long} THEN 'long' WHEN {short} THEN 'short' END AS direction"


_CROSS = FEATURES_SQL + """, rel AS (SELECT symbol, day, sign(round(sma20, 8) - round(sma50, 8)) AS rel FROM features), ma AS (
  SELECT * FROM (SELECT symbol, day AS at, """ + _side("lag(rel) OVER w <= 0 AND rel > 0", "lag(rel) OVER w >= 0 AND rel < 0") + """ FROM rel WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE direction IS NOT NULL)"""


@query("sig01_ma_crossover", f"WITH {_CROSS} SELECT * FROM ma")
def _sig01(spark, sf_dir):
    return signals.moving_average_crossover(P.bars(spark, sf_dir))


@query("sig02_turtle")
def _sig02(spark, sf_dir):
    return signals.turtle(P.bars(spark, sf_dir))


@query("sig03_gap", f"WITH {RECURRENT_SQL} SELECT * FROM (SELECT symbol, day AS at, {_side('open < lag(low) OVER w - 0.5 * lag(round(atr14, 8)) OVER w', 'open > lag(high) OVER w + 0.5 * lag(round(atr14, 8)) OVER w')} FROM recurrent WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE direction IS NOT NULL")
def _sig03(spark, sf_dir):
    return signals.gap(P.bars(spark, sf_dir))


@query("sig04_dolphin", f"""WITH {RECURRENT_SQL}, c AS (SELECT symbol, day, coalesce(round(ema5, 8) > round(ema20, 8) AND close > max(high) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false) AS l,
  coalesce(round(ema5, 8) < round(ema20, 8) AND close < min(low) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), false) AS s FROM recurrent WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT * FROM (SELECT symbol, day AS at, {_side('l AND NOT coalesce(lag(l) OVER w, false)', 's AND NOT coalesce(lag(s) OVER w, false)')} FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE direction IS NOT NULL""")
def _sig04(spark, sf_dir):
    return signals.dolphin(P.bars(spark, sf_dir))


_SESSIONS = P.TICKS_SQL + """, ses AS (SELECT symbol, session, arg_min(open, ts) AS s_open, max(high) AS sh, min(low) AS sl, arg_max(close, ts) AS sc FROM ticks GROUP BY ALL), prv AS (
  SELECT symbol, session, s_open, lag(sh) OVER w AS h1, lag(sl) OVER w AS l1, lag(sc) OVER w AS c1, lag(sh, 2) OVER w AS h2, lag(sl, 2) OVER w AS l2 FROM ses WINDOW w AS (PARTITION BY symbol ORDER BY session)
), b AS (SELECT * FROM ticks JOIN prv USING (symbol, session))"""
_FIRST = "SELECT symbol, min(ts)::TIMESTAMP AS at, arg_min(direction, ts) AS direction FROM d WHERE direction IS NOT NULL GROUP BY symbol, session"


def _utc(df):
    return df.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("agg14_session_bars", f"WITH {P.TICKS_SQL} SELECT symbol, session, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM ticks GROUP BY ALL")
def _agg14(spark, sf_dir):
    return signals.sessions(P.ticks(spark, sf_dir))


QUERIES["fn08_session_date"] = lambda spark, sf_dir: _utc(P.ticks(spark, sf_dir).select("symbol", F.col("ts").alias("at"), "session"))
SQL["fn08_session_date"] = f"WITH {P.TICKS_SQL} SELECT symbol, ts::TIMESTAMP AS at, session FROM ticks"


@query("sig05_r_breaker", f"""WITH {_SESSIONS}, x AS (SELECT *, round((h1 + l1 + c1) / 3 + 0.35 * (h1 - l1), 8) AS up, round((h1 + l1 + c1) / 3 - 0.35 * (h1 - l1), 8) AS lo,
  bool_or(low <= round((h1 + l1 + c1) / 3 - (h1 - l1), 8)) OVER w AS deep, bool_or(high >= round((h1 + l1 + c1) / 3 + (h1 - l1), 8)) OVER w AS top FROM b WHERE h1 IS NOT NULL WINDOW w AS (PARTITION BY symbol, session ORDER BY ts)),
d AS (SELECT *, {_side('(deep AND NOT top AND close > lo) OR (NOT deep AND NOT top AND close >= up)', '(top AND NOT deep AND close < up) OR (NOT deep AND NOT top AND close <= lo)')} FROM x) {_FIRST}""")
def _sig05(spark, sf_dir):
    return _utc(signals.r_breaker(P.ticks(spark, sf_dir)))


@query("sig06_dual_thrust", f"WITH {_SESSIONS}, d AS (SELECT *, {_side('close >= round(s_open + 0.5 * greatest(h1 - l1, h2 - l2), 8)', 'close <= round(s_open - 0.5 * greatest(h1 - l1, h2 - l2), 8)')} FROM b WHERE h2 IS NOT NULL) {_FIRST}")
def _sig06(spark, sf_dir):
    return _utc(signals.dual_thrust(P.ticks(spark, sf_dir)))


@query("sig07_fairy_four_price", f"WITH {_SESSIONS}, d AS (SELECT *, {_side('close > h1', 'close < l1')} FROM b WHERE h1 IS NOT NULL) {_FIRST}")
def _sig07(spark, sf_dir):
    return _utc(signals.fairy_four_price(P.ticks(spark, sf_dir)))


@query("sig08_ema_momentum", f"WITH {RECURRENT_SQL}, c AS (SELECT symbol, day, sign(round(ema5, 8) - round(ema20, 8)) AS rel FROM recurrent) SELECT * FROM (SELECT symbol, day AS at, {_side('lag(rel) OVER w <= 0 AND rel > 0', 'lag(rel) OVER w >= 0 AND rel < 0')} FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE direction IS NOT NULL")
def _sig08(spark, sf_dir):
    return signals.ema_momentum(P.bars(spark, sf_dir))


@query("sig09_escalator")
def _sig09(spark, sf_dir):
    return signals.escalator(P.bars(spark, sf_dir))


@query("sig10_checkmate", f"""WITH {RECURRENT_SQL}, c AS (SELECT *, CASE WHEN n >= 41 THEN max(high) OVER (w ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) END AS top, CASE WHEN n >= 41 THEN min(low) OVER (w ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) END AS bot FROM recurrent WINDOW w AS (PARTITION BY symbol ORDER BY day)),
e AS (SELECT symbol, day AS at, {_side('close > top', 'close < bot')} FROM c WHERE round(atr20, 8) > round(1.1 * atr60, 8)), f AS (SELECT *, lag(direction) OVER (PARTITION BY symbol ORDER BY at) AS was FROM e WHERE direction IS NOT NULL) SELECT symbol, at, direction FROM f WHERE was IS NULL OR was <> direction""")
def _sig10(spark, sf_dir):
    return signals.checkmate(P.bars(spark, sf_dir))


@query("sig11_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in signals.CATALOGUE) + ") t(number, name, kind)")
def _sig11(spark, sf_dir):
    return spark.createDataFrame(list(signals.CATALOGUE), "number int, name string, kind string")


@query("sig12_sma_actions", f"WITH {FEATURES_SQL}, c AS (SELECT symbol, day, round(sma20, 8) AS l, round(sma50, 8) AS r FROM features) SELECT * FROM (SELECT symbol, day AS at, CASE WHEN lag(l) OVER w <= lag(r) OVER w AND l > r THEN 'add_long' WHEN lag(l) OVER w >= lag(r) OVER w AND l < r THEN 'exit_long' END AS action FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE action IS NOT NULL")
def _sig12(spark, sf_dir):
    return signals.sma_cross_actions(P.bars(spark, sf_dir))


@query("sig13_macd_actions")
def _sig13(spark, sf_dir):
    return signals.macd_cross_actions(P.bars(spark, sf_dir))


@query("sig14_rsi_actions", f"WITH {RECURRENT_SQL}, c AS (SELECT symbol, day, round(rsi14, 8) AS v FROM recurrent) SELECT * FROM (SELECT symbol, day AS at, CASE WHEN v <= 48 AND (lag(v) OVER w IS NULL OR lag(v) OVER w > 48) THEN 'add_long' WHEN v >= 52 AND (lag(v) OVER w IS NULL OR lag(v) OVER w < 52) THEN 'exit_long' END AS action FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)) WHERE action IS NOT NULL")
def _sig14(spark, sf_dir):
    return signals.rsi_reversion_actions(P.bars(spark, sf_dir), 48, 52)


@query("sig15_markov_actions", f"""WITH {_FORWARD}, c AS (SELECT symbol, day, CASE WHEN round(signal, 10) > 0.3 THEN 'add_long' WHEN round(signal, 10) <= 0 THEN 'exit_long' END AS wish FROM sg WHERE idx >= 252), d AS (SELECT *, coalesce(lag(wish) OVER (PARTITION BY symbol ORDER BY day), 'exit_long') AS was FROM c WHERE wish IS NOT NULL)
SELECT symbol, day AS at, wish AS action FROM d WHERE wish <> was""")
def _sig15(spark, sf_dir):
    return signals.markov_actions(P.walk(spark, sf_dir))


# ---- outcomes ----------------------------------------------------------------------------------------------------

_PATH = _CROSS + """, pt AS (SELECT symbol, day AS at, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS idx, close AS value, open AS execution, high AS upper, low AS lower FROM bars), en AS (
  SELECT e.symbol, e.at, e.direction, q.idx AS entry_idx, q.at AS entry_at, q.execution AS entry FROM ma e JOIN pt p USING (symbol, at) JOIN pt q ON q.symbol = p.symbol AND q.idx = p.idx + 1
), path AS (
  SELECT en.*, p.idx - entry_idx AS step, p.at AS p_at,
    round(CASE WHEN direction = 'long' THEN p.value / entry - 1 ELSE -(p.value / entry - 1) END, 10) AS chg,
    round(CASE WHEN direction = 'long' THEN p.upper / entry - 1 ELSE -(p.lower / entry - 1) END, 10) AS fav,
    round(CASE WHEN direction = 'long' THEN p.lower / entry - 1 ELSE -(p.upper / entry - 1) END, 10) AS adv
  FROM en JOIN pt p ON p.symbol = en.symbol AND p.idx BETWEEN entry_idx + 1 AND entry_idx + 63
)"""
_FIXED = _PATH + """, fx AS (SELECT symbol, at, direction, entry_idx, entry_at, entry, arg_max(p_at, step) AS exit_at, arg_max(chg, step) AS change, arg_max(chg, step) / 0.03 AS r_multiple, greatest(0, max(fav)) AS max_favorable, least(0, min(adv)) AS max_adverse FROM path WHERE step <= 21 GROUP BY ALL HAVING max(step) = 21)"""
_BARRIER = _PATH + """, h AS (SELECT *, min(step) FILTER (fav >= 0.05 OR adv <= -0.03) OVER w AS hit, max(step) OVER w AS there FROM path WINDOW w AS (PARTITION BY symbol, at)), g AS (SELECT *, coalesce(hit, 63) AS ex FROM h WHERE hit IS NOT NULL OR there = 63), tb AS (
  SELECT symbol, at, direction, entry_idx, entry_at, entry, hit, ex, max(p_at) FILTER (step = ex) AS exit_at, max(chg) FILTER (step = ex) AS mark, bool_or(step = ex AND fav >= 0.05) AS won, bool_or(step = ex AND adv <= -0.03) AS lost, greatest(0, max(fav)) AS max_favorable, least(0, min(adv)) AS max_adverse
  FROM g WHERE step <= ex GROUP BY ALL
), br AS (SELECT symbol, at, direction, entry_idx, entry_at, entry, exit_at, CASE WHEN hit IS NULL THEN mark WHEN lost THEN -0.03 ELSE 0.05 END AS change, max_favorable, max_adverse, CASE WHEN hit IS NULL THEN 'time_limit' WHEN lost THEN 'stop_loss' ELSE 'profit_target' END AS exit_reason, ex AS duration, hit IS NOT NULL AND won AND lost AS ambiguous FROM tb)"""


def _events(spark, sf_dir):
    b = P.bars(spark, sf_dir)
    return ev.points(b), signals.moving_average_crossover(b)


@query("evl01_fixed_horizon", f"WITH {_FIXED} SELECT symbol, at, direction, entry_at, exit_at, round(change, 6) AS change, round(r_multiple, 6) AS r_multiple, round(max_favorable, 6) AS max_favorable, round(max_adverse, 6) AS max_adverse FROM fx")
def _evl01(spark, sf_dir):
    out = ev.fixed_horizon(*_events(spark, sf_dir))
    return rounded(out.select("symbol", "at", "direction", "entry_at", "exit_at", "change", "r_multiple", "max_favorable", "max_adverse"))


for _n in ("join09_signal_entry", "win32_excursions", "fn11_directional_change"):
    QUERIES[_n], SQL[_n] = QUERIES["evl01_fixed_horizon"], SQL["evl01_fixed_horizon"]


@query("evl02_triple_barrier", f"WITH {_BARRIER} SELECT symbol, at, direction, entry_at, exit_at, round(change::DOUBLE, 6) AS change, exit_reason, duration::INT AS duration, ambiguous, round(max_favorable, 6) AS max_favorable, round(max_adverse, 6) AS max_adverse FROM br")
def _evl02(spark, sf_dir):
    out = ev.triple_barrier(*_events(spark, sf_dir))
    return rounded(out.select("symbol", "at", "direction", "entry_at", "exit_at", "change", "exit_reason", "duration", "ambiguous", "max_favorable", "max_adverse"))


@query("evl03_non_overlapping", f"""WITH {_FIXED}, l AS (SELECT symbol, list(entry_idx ORDER BY entry_idx) AS e FROM fx GROUP BY symbol), k AS (SELECT symbol, list_reduce(e, lambda a, x: CASE WHEN x > a.last + 21 THEN {{'last': x, 'kept': list_append(a.kept, x)}} ELSE a END, {{'last': (-1000000000)::BIGINT, 'kept': []::BIGINT[]}}) AS z FROM l)
SELECT symbol, unnest(z.kept)::BIGINT AS entry_idx FROM k""")
def _evl03(spark, sf_dir):
    return ev.non_overlapping(ev.fixed_horizon(*_events(spark, sf_dir)), 21).select("symbol", F.col("entry_idx").cast("bigint").alias("entry_idx"))


@query("agg16_summary", f"""WITH {_FIXED}, o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r_multiple DESC, at) AS best FROM fx), s AS (
  SELECT symbol, count(*) AS event_count, count(*) FILTER (change > 0) AS win_count, count(*) FILTER (change < 0) AS loss_count, count(*) FILTER (change = 0) AS breakeven_count, avg(change) FILTER (change > 0) AS average_win, abs(avg(change) FILTER (change < 0)) AS average_loss,
    avg(r_multiple) FILTER (r_multiple > 0) AS average_win_r, abs(avg(r_multiple) FILTER (r_multiple < 0)) AS average_loss_r, avg(change) AS expected_value, avg(r_multiple) AS expected_r,
    sum(r_multiple) FILTER (r_multiple > 0) / abs(sum(r_multiple) FILTER (r_multiple < 0)) AS profit_factor, sum(r_multiple) FILTER (r_multiple > 0 AND best <= 5) / sum(r_multiple) FILTER (r_multiple > 0) AS top_five_win_contribution FROM o GROUP BY symbol
), t AS (SELECT *, win_count / event_count AS win_rate, average_win_r / average_loss_r AS reward_risk_ratio, (1 - breakeven_count / event_count) * average_loss_r / (average_win_r + average_loss_r) AS break_even_win_rate FROM s)
SELECT symbol, event_count, win_count, loss_count, breakeven_count, {', '.join(f'round({c}, 6) AS {c}' for c in 'average_win average_loss average_win_r average_loss_r expected_value expected_r profit_factor top_five_win_contribution win_rate reward_risk_ratio break_even_win_rate'.split())},
  round(win_rate - break_even_win_rate, 6) AS edge_over_break_even, round(greatest(0, (win_rate + {ev.Z95 ** 2} / (2 * event_count) - {ev.Z95} * sqrt(win_rate * (1 - win_rate) / event_count + {ev.Z95 ** 2} / (4 * event_count * event_count))) / (1 + {ev.Z95 ** 2} / event_count)), 6) AS win_rate_lower_95 FROM t""")
def _agg16(spark, sf_dir):
    return rounded(ev.summarise(ev.fixed_horizon(*_events(spark, sf_dir))))


for _n in ("agg17_wilson", "agg18_change_statistics", "agg20_top_five", "skl13_signal_evaluation"):
    QUERIES[_n], SQL[_n] = QUERIES["agg16_summary"], SQL["agg16_summary"]

_SPLIT = [("development", "1992-01-01", "1996-12-31"), ("holdout", "1997-01-01", "1999-12-31")]


@query("evl06_period_split", f"""WITH {_FIXED}, p AS (SELECT *, CASE WHEN at BETWEEN DATE '1992-01-01' AND DATE '1996-12-31' THEN 'development' WHEN at BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN 'holdout' END AS period, CASE WHEN at <= DATE '1996-12-31' THEN DATE '1996-12-31' ELSE DATE '1999-12-31' END AS pend FROM fx)
SELECT symbol, period, count(*) FILTER (exit_at <= pend) AS kept, count(*) FILTER (exit_at > pend) AS purged, round(avg(r_multiple) FILTER (exit_at <= pend), 6) AS expected_r FROM p WHERE period IS NOT NULL GROUP BY symbol, period""")
def _evl06(spark, sf_dir):
    out = ev.period_of(ev.fixed_horizon(*_events(spark, sf_dir)), _SPLIT)
    return rounded(out.groupBy("symbol", "period").agg(F.count_if(~F.col("purged")).alias("kept"), F.count_if("purged").alias("purged"), F.avg(F.when(~F.col("purged"), F.col("r_multiple"))).alias("expected_r")))


QUERIES["join12_period_range"], SQL["join12_period_range"] = QUERIES["evl06_period_split"], SQL["evl06_period_split"]


@query("evl04_block_bootstrap")
def _evl04(spark, sf_dir):
    return rounded(ev.block_bootstrap(ev.non_overlapping(ev.fixed_horizon(*_events(spark, sf_dir)), 21)))


@query("evl05_matched_baseline")
def _evl05(spark, sf_dir):
    pts, events = _events(spark, sf_dir)
    both = F.explode(F.array(F.lit("long"), F.lit("short")))
    every = ev.fixed_horizon(pts, pts.select("symbol", "at", both.alias("direction")))
    return rounded(ev.matched_baseline(every, events))
