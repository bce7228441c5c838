"""Causal entry signals of many instruments: (symbol, at, direction). No row depends on a later bar."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.functions import frames as fr
from quantloom.operators import indicators, risk

DAILY = fr.Series()
INTRADAY = fr.Series("symbol", "ts")


def _events(rows: DataFrame, long: Column, short: Column, at: str = "day") -> DataFrame:
    direction = F.when(long, "long").when(short, "short")
    return rows.select("symbol", F.col(at).alias("at"), direction.alias("direction")).where("direction is not null")


def _near(c: str | Column) -> Column:
    """Indicator values as they are compared: without the last digits, in which engines and orders of summing differ."""
    return F.round(c, 8)


def moving_average_crossover(prices: DataFrame, fast: int = 20, slow: int = 50, s: fr.Series = DAILY) -> DataFrame:
    """The sign of fast minus slow changes from the bar before, once both exist."""
    rows = prices.select("symbol", s.order, F.signum(_near(fr.sma(s, "close", fast)) - _near(fr.sma(s, "close", slow))).alias("rel"))
    before = s.lag("rel")
    rows = rows.select("*", before.alias("was"))
    return _events(rows, (F.col("was") <= 0) & (F.col("rel") > 0), (F.col("was") >= 0) & (F.col("rel") < 0), s.order)


def gap(bars: DataFrame, share: float = 0.5, s: fr.Series = DAILY) -> DataFrame:
    """Against an opening gap beyond the bar before by a share of its average true range."""
    rows = indicators.recurrences(bars).select("symbol", "day", "open", s.lag("low").alias("pl"), s.lag("high").alias("ph"), s.lag(_near("atr14")).alias("pa"))
    return _events(rows, F.col("open") < F.col("pl") - share * F.col("pa"), F.col("open") > F.col("ph") + share * F.col("pa"))


def dolphin(bars: DataFrame, back: int = 2, s: fr.Series = DAILY) -> DataFrame:
    """Close beyond the last ``back`` bars with the trend of two exponential averages; only where that begins."""
    rows = indicators.recurrences(bars)
    trend = F.signum(_near("ema5") - _near("ema20"))
    long = (trend > 0) & (F.col("close") > F.max("high").over(s.before(back)))
    short = (trend < 0) & (F.col("close") < F.min("low").over(s.before(back)))
    rows = rows.select("*", F.coalesce(long, F.lit(False)).alias("l"), F.coalesce(short, F.lit(False)).alias("s"))
    rows = rows.select("symbol", "day", "l", "s", F.coalesce(s.lag("l"), F.lit(False)).alias("pl"), F.coalesce(s.lag("s"), F.lit(False)).alias("ps"))
    return _events(rows, F.col("l") & ~F.col("pl"), F.col("s") & ~F.col("ps"))


def ema_momentum(bars: DataFrame, s: fr.Series = DAILY) -> DataFrame:
    rows = indicators.recurrences(bars).select("symbol", "day", F.signum(_near("ema5") - _near("ema20")).alias("rel"))
    rows = rows.select("*", s.lag("rel").alias("was"))
    return _events(rows, (F.col("was") <= 0) & (F.col("rel") > 0), (F.col("was") >= 0) & (F.col("rel") < 0))


def sessions(bars: DataFrame) -> DataFrame:
    """(symbol, session, open, high, low, close) of each session of intraday bars."""
    return bars.groupBy("symbol", "session").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))


def _with_sessions(bars: DataFrame) -> DataFrame:
    w = W.Window.partitionBy("symbol").orderBy("session")
    known = sessions(bars).select("symbol", "session", F.col("open").alias("s_open"), *[F.lag(c, k).over(w).alias(f"p{k}_{c}") for c in ("high", "low", "close") for k in (1, 2)])
    return bars.join(known, ["symbol", "session"])


def _first(rows: DataFrame, long: Column, short: Column) -> DataFrame:
    """The first signal of each session."""
    found = rows.withColumn("direction", F.when(long, "long").when(short, "short")).where("direction is not null")
    return found.groupBy("symbol", "session").agg(F.min("ts").alias("at"), F.min_by("direction", "ts").alias("direction")).select("symbol", "at", "direction")


def r_breaker(bars: DataFrame, share: float = 0.35) -> DataFrame:
    """Breakouts of pivot lines of the session before, or reversals after a move of its whole range."""
    rows = _with_sessions(bars).where("p1_high is not null")
    pivot, width = (F.col("p1_high") + F.col("p1_low") + F.col("p1_close")) / 3, F.col("p1_high") - F.col("p1_low")
    w = W.Window.partitionBy("symbol", "session").orderBy("ts").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumns({"upper": F.round(pivot + share * width, 8), "lower": F.round(pivot - share * width, 8)})
    rows = rows.withColumns({"deep": F.bool_or(F.col("low") <= F.round(pivot - width, 8)).over(w), "top": F.bool_or(F.col("high") >= F.round(pivot + width, 8)).over(w)})
    c, neither = F.col("close"), ~F.col("deep") & ~F.col("top")
    long = (F.col("deep") & ~F.col("top") & (c > F.col("lower"))) | (neither & (c >= F.col("upper")))
    short = (F.col("top") & ~F.col("deep") & (c < F.col("upper"))) | (neither & (c <= F.col("lower")))
    return _first(rows, long, short)


def dual_thrust(bars: DataFrame, coefficient: float = 0.5) -> DataFrame:
    rows = _with_sessions(bars).where("p2_high is not null")
    reach = coefficient * F.greatest(F.col("p1_high") - F.col("p1_low"), F.col("p2_high") - F.col("p2_low"))
    return _first(rows, F.col("close") >= F.round(F.col("s_open") + reach, 8), F.col("close") <= F.round(F.col("s_open") - reach, 8))


def fairy_four_price(bars: DataFrame) -> DataFrame:
    rows = _with_sessions(bars).where("p1_high is not null")
    return _first(rows, F.col("close") > F.col("p1_high"), F.col("close") < F.col("p1_low"))


def checkmate(bars: DataFrame, back: int = 40, ratio: float = 1.1, s: fr.Series = DAILY) -> DataFrame:
    """Breakouts while the short average true range exceeds the long one; sides alternate."""
    rows = indicators.recurrences(bars).withColumns(dict(zip(("top", "bottom"), fr.channel(s, back), strict=True)))
    rows = rows.where(_near("atr20") > F.round(ratio * F.col("atr60"), 8))
    found = _events(rows, F.col("close") > F.col("top"), F.col("close") < F.col("bottom"))
    w = W.Window.partitionBy("symbol").orderBy("at")
    return found.withColumn("was", F.lag("direction").over(w)).where("was is null or was <> direction").drop("was")


def _stateful(rows: DataFrame, columns: list[str], step) -> DataFrame:
    """Signals that depend on an open position: one ordered pass an instrument over precomputed columns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        at, side = step(*[pdf[c].to_numpy(float) for c in columns])
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "at": pdf.day.to_numpy()[at], "direction": np.where(np.array(side, int) > 0, "long", "short")})

    kind = rows.schema["day"].dataType.simpleString()
    return rows.select("symbol", "day", *columns).groupBy("symbol").applyInPandas(run, f"symbol string, at {kind}, direction string")


def turtle(bars: DataFrame, entry: int = 20, leave: int = 10, s: fr.Series = DAILY) -> DataFrame:
    """Breakouts of the entry channel when flat; flat again beyond the opposite side of the exit channel."""
    eh, el = fr.channel(s, entry)
    xh, xl = fr.channel(s, leave)
    rows = bars.withColumns({"eh": eh, "el": el, "xh": xh, "xl": xl})

    def step(close, eh, el, xh, xl):
        side, at, out = 0, [], []
        for i in np.flatnonzero(~np.isnan(eh)).tolist():
            if side and (close[i] < xl[i] if side > 0 else close[i] > xh[i]):
                side = 0
            if not side:
                side = int(close[i] > eh[i]) - int(close[i] < el[i])
                if side:
                    at.append(i)
                    out.append(side)
        return at, out

    return _stateful(rows, ["close", "eh", "el", "xh", "xl"], step)


def escalator(bars: DataFrame, back: int = 20, stop: float = 3.0, s: fr.Series = DAILY) -> DataFrame:
    """Channel breakouts left at a stop that trails the best price by a multiple of the average true range."""
    top, bottom = fr.channel(s, back)
    rows = indicators.recurrences(bars).withColumns({"top": top, "bottom": bottom})

    def step(close, high, low, atr, top, bottom):
        side, best, at, out = 0, 0.0, [], []
        for i in np.flatnonzero(~np.isnan(top)).tolist():
            if side and not np.isnan(atr[i]):
                best = max(best, high[i]) if side > 0 else min(best, low[i])
                if side * (close[i] - best) < -stop * atr[i]:
                    side = 0
            if not side:
                side = int(close[i] > top[i]) - int(close[i] < bottom[i])
                if side:
                    best = high[i] if side > 0 else low[i]
                    at.append(i)
                    out.append(side)
        return at, out

    return _stateful(rows, ["close", "high", "low", "atr14", "top", "bottom"], step)


# ---- strategies of the tranche backtest: (symbol, at, action) -----------------------------------------------------


def _actions(rows: DataFrame, add: Column, leave: Column) -> DataFrame:
    return rows.select("symbol", F.col("day").alias("at"), F.when(add, "add_long").when(leave, "exit_long").alias("action")).where("action is not null")


def sma_cross_actions(prices: DataFrame, fast: int = 20, slow: int = 50, s: fr.Series = DAILY) -> DataFrame:
    rows = prices.select("symbol", "day", _near(fr.sma(s, "close", fast)).alias("l"), _near(fr.sma(s, "close", slow)).alias("r"))
    up, down = fr.crossed(s, "l", "r")
    return _actions(rows.select("symbol", "day", up.alias("u"), down.alias("d")), F.col("u"), F.col("d"))


def macd_cross_actions(bars: DataFrame, s: fr.Series = DAILY) -> DataFrame:
    rows = indicators.recurrences(bars).select("symbol", "day", _near("macd").alias("l"), _near("macd_signal").alias("r"))
    up, down = fr.crossed(s, "l", "r")
    return _actions(rows.select("symbol", "day", up.alias("u"), down.alias("d")), F.col("u"), F.col("d"))


def rsi_reversion_actions(bars: DataFrame, low: float = 30, high: float = 70, s: fr.Series = DAILY) -> DataFrame:
    rows = indicators.recurrences(bars).select("symbol", "day", _near("rsi14").alias("v"))
    fell, rose = fr.entered(s, "v", low, high)
    return _actions(rows.select("symbol", "day", fell.alias("u"), rose.alias("d")), F.col("u"), F.col("d"))


def markov_actions(prices: DataFrame, min_train: int = 252, enter: float = 0.3, leave: float = 0.0, s: fr.Series = DAILY) -> DataFrame:
    """In above ``enter`` when out, out at or below ``leave`` when in: of equal wishes in a row only the first acts."""
    rows = risk.walk_forward(risk.regimes(prices)).where(F.col("idx") >= min_train)
    rows = rows.withColumn("v", F.round("signal", 10)).withColumn("wish", F.when(F.col("v") > enter, "add_long").when(F.col("v") <= leave, "exit_long")).where("wish is not null")
    rows = rows.withColumn("was", F.coalesce(s.lag("wish"), F.lit("exit_long"))).where("wish <> was")
    return rows.select("symbol", F.col("day").alias("at"), F.col("wish").alias("action"))


#: Strategies by name; Martingale sizes positions and has no entry signal of its own.
CATALOGUE = (
    (1, "turtle", "daily"), (2, "gap", "daily"), (3, "dolphin", "intraday"), (4, "martingale", "not evaluable"), (5, "r_breaker", "intraday"),
    (6, "dual_thrust", "intraday"), (7, "fairy_four_price", "intraday"), (8, "ema_momentum", "daily"), (9, "escalator", "daily"), (10, "checkmate", "daily"),
)
