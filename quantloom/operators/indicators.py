"""Technical indicators of many instruments at once.

Window indicators are plain window expressions over one order. Recurrences (exponential averages, Wilder's averages,
positions) are computed by :func:`recurrences` for all bars, in one grouped pass, or by :func:`latest` for the last
bar, as folds inside the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.functions import frames as fr

BARS = fr.Series()


def trailing(bars: DataFrame, s: fr.Series = BARS) -> DataFrame:
    """``bars`` with the trailing-window indicators of (open, high, low, close, volume)."""
    n = s.number
    with_steps = bars.withColumns({
        "n": n,
        "ret": F.round(fr.simple_return(s, "close"), 10),
        "log_ret": F.round(fr.log_return(s, "close"), 10),
        "change": F.col("close") - s.lag("close"),
        "move": F.abs(F.col("close") - s.lag("close")),
        "tr": F.coalesce(fr.true_range(s), F.col("high") - F.col("low")),
        "obv_step": fr.obv_step(s),
        "hi9": F.max("high").over(s.last(9)),
        "lo9": F.min("low").over(s.last(9)),
    })
    rsv = F.when(n >= 9, F.when(F.col("hi9") == F.col("lo9"), 50.0).otherwise(F.try_divide(F.col("close") - F.col("lo9"), F.col("hi9") - F.col("lo9")) * 100))
    up, low = fr.channel(s, 20)
    bl, bm, bu = fr.bollinger(s, "close")
    sl, _, su = fr.bollinger(s, "close", sample=True)
    out = with_steps.withColumns({
        "rsv": rsv,
        "sma20": fr.sma(s, "close", 20),
        "sma50": fr.sma(s, "close", 50),
        "boll_lower": bl, "boll_middle": bm, "boll_upper": bu, "boll_lower_s": sl, "boll_upper_s": su,
        "obv": F.sum("obv_step").over(s.so_far),
        "efficiency": fr.efficiency(s, "move"),
        "vol_log_63": fr.volatility(s, "log_ret", 63),
        "vol_log_20": fr.volatility(s, "log_ret", 20),
        "vol_simple_20": fr.volatility(s, "ret", 20),
        "up_down": fr.up_down_ratio(s, "change"),
        "momentum_12_1": F.when(n >= 253, s.lag("close", 21) / s.lag("close", 252) - 1),
        "momentum_10": fr.simple_return(s, "close", 10),
        "volume_ratio": fr.full(s, 20, F.col("volume") / F.greatest(F.avg("volume").over(s.last(20)), F.lit(1e-12))),
        "roll_20": F.round(F.coalesce(fr.simple_return(s, "close", 20), F.lit(0.0)), 10),
        "channel_high": up, "channel_low": low,
        "drawdown": fr.drawdown(s),
        "atr_simple": fr.full(s, 14, F.avg("tr").over(s.last(14))),
    })
    out = out.withColumns({
        "k": F.when(n >= 11, F.avg("rsv").over(s.last(3))).when(n >= 9, F.col("rsv")),
        # an early %K is the mean of what there is, once three raw values exist
        "k_head": F.when(n >= 9, F.avg("rsv").over(s.last(3))),
        "obv_trend": F.when(n >= 21, (F.col("obv") - s.lag("obv", 20)) / F.greatest(F.sum("volume").over(s.last(20)), F.lit(1.0))),
        "regime": F.when(n > 20, fr.regime_label(F.col("roll_20"))).otherwise(1),
    })
    out = out.withColumn("d", F.when(n >= 11, F.avg("k_head").over(s.last(3))))
    return out.withColumn("j", 3 * F.col("k") - 2 * F.col("d"))


def weekly(bars: DataFrame, key: str = "symbol", day: str = "day") -> DataFrame:
    """ISO-week bars; missing volumes count as nothing."""
    year, week = F.expr(f"extract(YEAROFWEEK FROM {day})"), F.weekofyear(day)
    return bars.groupBy(key, year.alias("iso_year"), week.alias("iso_week")).agg(
        F.min_by("open", day).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", day).alias("close"), F.sum("volume").alias("volume"), F.max(day).alias("day")
    )


def weekly_alignment(weeks: DataFrame, s: fr.Series = BARS) -> DataFrame:
    """The latest week's averages of 5, 10, 20 and 30 closes: whether they rise in that order by 1 % at least."""
    wide = weeks.select(s.key, s.order, *[fr.sma(s, "close", n).alias(f"ma{n}") for n in (5, 10, 20, 30)])
    last = W.Window.partitionBy(s.key).orderBy(F.col(s.order).desc())
    strength = (F.col("ma30") - F.col("ma5")) / F.col("ma30")
    one = wide.withColumn("__r", F.row_number().over(last)).where("__r = 1")
    return one.select(s.key, F.when(F.col("ma30").isNotNull(), (F.col("ma5") < F.col("ma10")) & (F.col("ma10") < F.col("ma20")) & (F.col("ma20") < F.col("ma30")) & (strength >= 0.01)).alias("bearish"), F.bround(strength, 4).alias("alignment_strength"))


# ---- recurrences -------------------------------------------------------------------------------------------------


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential average with weight ``alpha``, started by the mean of the first ``n``; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        e = float(np.mean(x[:n]))
        out[n - 1] = e
        for i, v in enumerate(x[n:].tolist(), n):
            e += (v - e) * alpha
            out[i] = e
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1 / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    change = np.diff(close)
    gain, loss = wilder(np.maximum(change, 0), n), wilder(np.maximum(-change, 0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), 100 - 100 / (1 + gain / loss))
    return np.r_[np.nan, np.where(np.isnan(gain), np.nan, value)] if len(close) else value


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    line = ema(close, fast) - ema(close, slow)
    out = np.full(len(close), np.nan)
    if len(close) >= slow:
        out[slow - 1 :] = ema(line[slow - 1 :], signal)
    return line, out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    tr = high - low
    if len(tr) > 1:
        tr[1:] = np.maximum.reduce([tr[1:], np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1])])
    return tr


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ADX, +DI, -DI) up to each bar; null before 2n + 1 bars. Bars without range or movement are passed over."""
    size = len(close)
    adx, plus, minus = (np.full(size, np.nan) for _ in range(3))
    if size < 2 * n + 1:
        return adx, plus, minus
    up, down = np.diff(high), -np.diff(low)
    pdm, mdm = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr, pdm, mdm = (wilder(x, n) for x in (true_range(high, low, close)[1:], pdm, mdm))
    last_p = last_m = average = np.nan
    dx: list[float] = []
    for i in range(n, size - 1):
        if tr[i] != 0:
            last_p, last_m = pdm[i] / tr[i] * 100, mdm[i] / tr[i] * 100
            if last_p + last_m != 0:
                dx.append(abs(last_p - last_m) / (last_p + last_m) * 100)
                average = float(np.mean(dx)) if len(dx) <= n else (average * (n - 1) + dx[-1]) / n
        if i + 1 >= 2 * n:
            adx[i + 1], plus[i + 1], minus[i + 1] = average, last_p, last_m
    return adx, plus, minus


RECURRENT = ("ema5", "ema10", "ema12", "ema20", "ema26", "rsi6", "rsi14", "macd", "macd_signal", "macd_hist", "atr14", "atr20", "atr60", "adx", "plus_di", "minus_di")


def recurrences(bars: DataFrame, key: str = "symbol", day: str = "day", keep: tuple[str, ...] = ()) -> DataFrame:
    """``bars`` (key, day, open, high, low, close, volume, and the columns in ``keep``) with all recurrent indicators: one
    pass an instrument. Rows that windows of the instrument have already brought together are not dealt again.

    A recurrence needs an instrument's bars in order, so one instrument is one task's group; instruments spread.
    """
    columns = [key, day, "open", "high", "low", "close", "volume", *keep]
    rows = bars.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {c} double" for c in RECURRENT)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day).reset_index(drop=True)
        h, lo, c = (pdf[x].to_numpy(float) for x in ("high", "low", "close"))
        tr = true_range(h, lo, c)
        line, signal = macd(c)
        adx, plus, minus = directional(h, lo, c)
        values = (ema(c, 5), ema(c, 10), ema(c, 12), ema(c, 20), ema(c, 26), rsi(c, 6), rsi(c, 14), line, signal, line - signal, wilder(tr, 14), wilder(tr, 20), wilder(tr, 60), adx, plus, minus)
        return pdf.assign(**{name: pd.Series(v).astype("Float64").where(~np.isnan(v)) for name, v in zip(RECURRENT, values, strict=True)})

    return rows.groupBy(key).applyInPandas(run, schema)


def fold_average(values: Column, n: int, alpha: float) -> Column:
    """The last value of smooth() over an array column; null for fewer than ``n`` values. Stays inside the JVM."""
    start = F.aggregate(F.slice(values, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    rest = F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))
    return F.when(F.size(values) >= n, F.aggregate(rest, start, lambda a, x: a + (x - a) * alpha))


def latest(bars: DataFrame, key: str = "symbol", day: str = "day") -> DataFrame:
    """Per instrument the last EMA20, RSI14 and ATR14, by folds over its ordered bars."""
    s = fr.Series(key, day)
    rows = bars.select(key, day, "close", F.coalesce(F.col("close") - s.lag("close"), F.lit(None).cast("double")).alias("change"), F.coalesce(fr.true_range(s), F.col("high") - F.col("low")).alias("tr"))
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(day, "close", "change", "tr"))).alias("b"))
    change = F.filter(F.col("b.change"), lambda x: x.isNotNull())
    gain = fold_average(F.transform(change, lambda x: F.greatest(x, F.lit(0.0))), 14, 1 / 14)
    loss = fold_average(F.transform(change, lambda x: F.greatest(-x, F.lit(0.0))), 14, 1 / 14)
    wide = one.select(key, fold_average(F.col("b.close"), 20, 2 / 21).alias("ema20"), gain.alias("g"), loss.alias("l"), fold_average(F.col("b.tr"), 14, 1 / 14).alias("atr14"))
    return wide.select(key, "ema20", F.when(F.col("l") == 0, F.when(F.col("g") > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.try_divide("g", "l"))).alias("rsi14"), "atr14")
