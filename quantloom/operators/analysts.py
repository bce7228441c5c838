"""Composite analysts: technical, technical-basic, price action and the worth-buy score, one row an instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.functions import frames as fr
from quantloom.operators import indicators, validation

DAILY = fr.Series()


def ladder(*steps: tuple[Column, float], otherwise: float) -> Column:
    out = F
    for condition, value in steps:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def last_values(rows: DataFrame, columns: list[str], key: str = "symbol", day: str = "day") -> DataFrame:
    """The latest row's columns of each instrument; one partial aggregate, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), day).alias("z")).select(key, "z.*")


def _joined(bars: DataFrame) -> DataFrame:
    """Window and recurrent indicators side by side: one exchange and sort by instrument serves both."""
    rows = indicators.trailing(bars)
    return indicators.recurrences(rows, keep=tuple(c for c in rows.columns if c not in ("symbol", "day", "open", "high", "low", "close", "volume")))


def technical(bars: DataFrame, s: fr.Series = DAILY) -> DataFrame:
    """The latest technical indicators; each is null until its own history is there."""
    rows = _joined(bars).withColumn("first", F.first("close").over(s.so_far))
    rows = rows.withColumn("volume_trend", F.when(F.col("n") >= 40, F.try_divide(F.avg("volume").over(s.last(20)), F.avg("volume").over(s.w.rowsBetween(-39, -20))) - 1))
    rows = rows.withColumn("price_return", F.when(F.col("n") >= 2, F.col("close") / F.col("first") - 1))
    columns = ["price_return", "sma20", "ema20", "boll_lower", "boll_middle", "boll_upper", "rsi14", "macd", "macd_signal", "macd_hist", "atr14", "momentum_10", "vol_simple_20", "volume_trend"]
    return last_values(rows, columns)


def technical_basic(bars: DataFrame) -> DataFrame:
    """Four sub-scores of trend, momentum, band and volume, their mean, and its reading; from 50 complete bars."""
    rows = _joined(validation.validated(bars).where(validation.complete_bar()))
    one = last_values(rows, ["n", "close", "ema12", "ema26", "rsi14", "adx", "plus_di", "minus_di", "obv_trend", "volume_ratio", "boll_lower_s", "boll_middle", "boll_upper_s", "macd"]).where("n >= 50")
    c = F.col
    trend = ladder(((c("close") > c("ema12")) & (c("macd") > 0) & (F.coalesce("plus_di", F.lit(0.0)) > F.coalesce("minus_di", F.lit(0.0))), 100.0), (c("close") > c("ema26"), 60.0), otherwise=20.0)
    momentum = ladder((c("rsi14").between(50, 70), 100.0), (c("rsi14").between(40, 80), 60.0), otherwise=20.0)
    band = ladder((c("close").between(c("boll_middle"), c("boll_upper_s")), 80.0), ((c("close") >= c("boll_lower_s")) & (c("close") < c("boll_middle")), 55.0), otherwise=25.0)
    volume = ladder((c("obv_trend") > 0, 60.0), otherwise=20.0) + ladder((c("volume_ratio") >= 1, 40.0), otherwise=20.0)
    score = (trend + momentum + band + volume) / 4
    out = one.select("symbol", score.alias("score"), "ema12", "ema26", "rsi14", F.coalesce("adx", F.lit(0.0)).alias("adx"), "boll_middle", "boll_upper_s", "boll_lower_s", "obv_trend", "volume_ratio")
    return out.withColumn("signal", F.when(F.col("score") >= 70, "bullish").when(F.col("score") < 40, "bearish").otherwise("neutral"))


# ---- price action -------------------------------------------------------------------------------------------------


def with_gaps(bars: DataFrame, s: fr.Series = DAILY) -> DataFrame:
    """Complete bars with ``idx`` from 0, ``follows`` (no incomplete bar lies between it and the bar before), and the
    gap-aware mean true range of 14 bars, which starts anew after a gap."""
    rows = bars.withColumn("src", s.number).where(validation.complete_bar())
    rows = rows.withColumns({"idx": s.number - 1, "follows": F.coalesce(F.col("src") - s.lag("src") == 1, F.lit(False))})
    rows = rows.withColumn("island", F.sum((~F.col("follows")).cast("int")).over(s.so_far))
    previous = F.when(F.col("follows"), s.lag("close"))
    tr = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - previous), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - previous), F.lit(0.0)))
    rows = rows.withColumn("tr", tr)
    w = W.Window.partitionBy(s.key, "island").orderBy(s.order).rowsBetween(-13, 0)
    return rows.withColumn("atr", F.when(F.count("*").over(w) == 14, F.round(F.avg("tr").over(w), 8)))


def candle_events(rows: DataFrame, s: fr.Series = DAILY) -> DataFrame:
    """(symbol, day, event): rejections, inside bars and engulfings of with_gaps() rows; a bar may have several."""
    c = F.col
    p = {n: F.when(c("follows"), s.lag(n)) for n in ("open", "high", "low", "close")}
    rows = rows.select(s.key, s.order, "open", "high", "low", "close", "atr", *[v.alias(f"p_{n}") for n, v in p.items()])
    size, body = c("high") - c("low"), F.abs(c("close") - c("open"))
    upper, lower = c("high") - F.greatest("open", "close"), F.least("open", "close") - c("low")
    large = size >= F.round(0.4 * c("atr"), 8)
    slim = body / size < 0.3
    was = F.abs(c("p_close") - c("p_open"))
    wide = (size >= F.round(0.3 * c("atr"), 8)) & (body > was)
    bull = wide & (c("p_close") < c("p_open")) & (c("close") > c("open")) & (c("open") <= c("p_close")) & (c("close") >= c("p_open"))
    bear = wide & (c("p_close") > c("p_open")) & (c("close") < c("open")) & (c("open") >= c("p_close")) & (c("close") <= c("p_open"))
    found = F.array(
        F.when(large & slim & (lower / size >= 0.6) & (upper / size < 0.15), "bullish_rejection").when(large & slim & (upper / size >= 0.6) & (lower / size < 0.15), "bearish_rejection"),
        F.when((c("high") < c("p_high")) & (c("low") > c("p_low")), "inside_bar"),
        F.when(bull, "bullish_engulfing").when(bear, "bearish_engulfing"),
    )
    return rows.where(size > 0).select(s.key, s.order, F.explode(F.array_compact(found)).alias("event"))


def pivots(rows: DataFrame, strength: int = 3, s: fr.Series = DAILY) -> DataFrame:
    """(symbol, day, idx, kind, price, label): strict extremes among ``strength`` bars on both sides, labelled against
    the pivot of the same kind before; an equal one counts as lower."""
    ahead, back = s.w.rowsBetween(1, strength), s.before(strength)
    full = (F.count("*").over(ahead) == strength) & (F.count("*").over(back) == strength)
    rows = rows.withColumns({"is_high": full & (F.col("high") > F.greatest(F.max("high").over(ahead), F.max("high").over(back))), "is_low": full & (F.col("low") < F.least(F.min("low").over(ahead), F.min("low").over(back)))})
    one = F.array_compact(F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    found = rows.select(s.key, s.order, "idx", F.explode(one).alias("p")).select(s.key, s.order, "idx", "p.kind", "p.price")
    before = F.lag("price").over(W.Window.partitionBy(s.key, "kind").orderBy("idx"))
    rising = F.col("price") > before
    label = F.when(before.isNull(), None).when(F.col("kind") == "high", F.when(rising, "HH").otherwise("LH")).otherwise(F.when(rising, "HL").otherwise("LL"))
    return found.withColumn("label", label)


def structure(found: DataFrame, key: str = "symbol") -> DataFrame:
    """uptrend, downtrend or mixed by the last two highs and lows; unavailable without two of each."""
    w = W.Window.partitionBy(key, "kind").orderBy(F.col("idx").desc())
    last = found.withColumn("r", F.row_number().over(w)).where("r <= 2")
    pick = lambda kind, r: F.max(F.when((F.col("kind") == kind) & (F.col("r") == r), F.col("price")))
    one = last.groupBy(key).agg((pick("high", 1) - pick("high", 2)).alias("h"), (pick("low", 1) - pick("low", 2)).alias("l"))
    state = F.when(F.col("h").isNull() | F.col("l").isNull(), "unavailable").when((F.col("h") > 0) & (F.col("l") > 0), "uptrend").when((F.col("h") < 0) & (F.col("l") < 0), "downtrend").otherwise("mixed")
    return one.select(key, state.alias("structure"))


def zones(found: DataFrame, scale: DataFrame, most: int = 8, key: str = "symbol") -> DataFrame:
    """Clusters of pivot prices, each within half an average true range of its cluster's running mean: a fold over the
    ordered prices. At least two touches; the ``most`` best by touches, recency and nearness to the close.

    ``scale`` has (symbol, atr14, close).
    """
    one = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("price", "idx", "kind", "day"))).alias("p")).join(scale, key)
    kind = one.schema["p"].dataType.elementType.simpleString()
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast(f"array<{kind}>").alias("now"), F.array().cast(f"array<array<{kind}>>").alias("done"))

    def step(acc, x):
        near = (F.size(acc["now"]) > 0) & (F.abs(x["price"] - acc["total"] / F.size(acc["now"])) <= F.round(F.col("atr14") * 0.5, 8))
        closed = F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        grown = F.struct((acc["total"] + x["price"]).alias("total"), F.concat(acc["now"], F.array(x)).alias("now"), acc["done"].alias("done"))
        return F.when(near, grown).otherwise(F.struct(x["price"].alias("total"), F.array(x).alias("now"), closed.alias("done")))

    folded = one.where("atr14 > 0").withColumn("z", F.aggregate("p", start, step))
    each = folded.select(key, "atr14", "close", F.explode(F.concat("z.done", F.array("z.now"))).alias("c")).where(F.size("c") >= 2)
    kinds = F.array_distinct(F.col("c.kind"))
    each = each.select(
        key, "close", F.when(F.size(kinds) > 1, "flip").when(F.array_contains(kinds, "high"), "resistance").otherwise("support").alias("kind"),
        F.greatest(F.array_min("c.price") - F.col("atr14") * 0.1, F.lit(1e-12)).alias("lower"), (F.aggregate("c.price", F.lit(0.0), lambda a, x: a + x) / F.size("c")).alias("midpoint"),
        (F.array_max("c.price") + F.col("atr14") * 0.1).alias("upper"), F.size("c").alias("touch_count"), F.array_max("c.day").alias("last_touched"),
    )
    w = W.Window.partitionBy(key).orderBy(F.col("touch_count").desc(), F.col("last_touched").desc(), F.abs(F.col("midpoint") - F.col("close")))
    return each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r", "close")


# ---- worth-buy ----------------------------------------------------------------------------------------------------


def worth_buy(bars: DataFrame, benchmark: DataFrame | None = None, s: fr.Series = DAILY) -> DataFrame:
    """Composite score, risk score, blocks, levels, entry class, reversal count and verdict of each instrument.

    Without a benchmark the efficiency part takes 0.10 / 0.65 while the momentum part keeps 0.55. ``benchmark`` is
    (symbol, relative_strength) with the mean score against the benchmarks; instruments it lacks have none. An
    instrument with fewer than 30 complete bars has the verdict cannot_score, no scores and no levels.
    """
    rows = _joined(validation.validated(bars).where(validation.complete_bar()))
    rows = rows.withColumns({
        "ma10": fr.sma(s, "close", 10), "ma60": fr.sma(s, "close", 60), "ma200": fr.sma(s, "close", 200),
        "hist3": s.lag("macd_hist", 2), "obv30": s.lag("obv", 29), "prev": s.lag("close"),
        "low20": F.min("low").over(s.last(20)), "low10": F.min("low").over(s.last(10)), "high30": F.max("high").over(s.last(30)), "high252": F.max("high").over(s.last(252)), "vol_before": F.avg("volume").over(s.before(20)),
        "peak": F.max("close").over(s.last(252)),
    })
    rows = rows.withColumns({"ma10_prev": s.lag("ma10"), "ma20_prev": s.lag("sma20")})
    day_dd = validation.tail(bars.where(validation.complete_bar()), 252).withColumn("dd", fr.drawdown(s)).groupBy("symbol").agg(F.when(F.count("*") >= 2, F.min("dd")).alias("dd252"))
    keep = ["n", "close", "prev", "high", "low", "volume", "ma10", "ma10_prev", "sma20", "ma20_prev", "ma60", "ma200", "rsi6", "rsi14", "macd", "macd_signal", "macd_hist", "hist3", "k", "d", "j", "adx", "plus_di", "minus_di", "up_down", "obv", "obv30", "efficiency", "momentum_12_1", "vol_log_63", "atr14", "low20", "low10", "high30", "high252", "vol_before"]
    one = last_values(rows, keep).where("n >= 30").join(day_dd, "symbol", "left")
    one = one.join(indicators.weekly_alignment(indicators.weekly(bars.where(validation.complete_bar()))).select("symbol", "bearish"), "symbol", "left")
    one = one.join(benchmark, "symbol", "left") if benchmark is not None else one.withColumn("relative_strength", F.lit(None).cast("double"))
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    with_bench = F.lit(benchmark is not None)
    momentum = F.coalesce((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), c("momentum_12_1"))) + 0.5) * 100 * 0.55, F.lit(0.0))
    efficiency = F.coalesce(c("efficiency") * 100 * F.when(with_bench, 0.10).otherwise(0.10 / 0.65), F.lit(0.0))
    composite = F.bround(momentum + efficiency + F.coalesce(c("relative_strength") * 0.35, F.lit(0.0)), 2)
    broken = yes((c("close") < c("ma60")) & (c("ma60") < c("ma200")))
    risk = ladder((broken, 30.0), (yes((c("close") < c("ma60")) & c("ma200").isNotNull()), 15.0), otherwise=0.0) + ladder((yes(c("dd252") < -0.20), 25.0), (yes(c("dd252") < -0.10), 10.0), otherwise=0.0)
    risk = F.least(F.lit(100.0), risk + ladder((yes(c("bearish")), 20.0), otherwise=0.0) + ladder((yes(c("vol_log_63") > 0.5), 10.0), otherwise=0.0))
    blocks = F.array_compact(F.array(*[F.when(yes(x), n) for n, x in (
        ("macd_bearish", c("macd") < c("macd_signal")), ("macd_histogram_declining", c("macd_hist") < c("hist3")), ("rsi_overbought", c("rsi14") > 70), ("rsi_oversold", c("rsi14") < 30),
        ("kdj_overbought", c("j") > 100), ("kdj_bearish_cross", c("k") < c("d")), ("adx_ranging", c("adx") < 20), ("di_bearish", c("adx").isNotNull() & (c("minus_di") > c("plus_di"))),
        ("distribution_volume", c("up_down") < 0.7), ("obv_declining", c("obv") < c("obv30")),
    )]))
    reversal = sum((yes(x).cast("int") for x in (
        (c("high") > c("low")) & (c("close") > (c("high") + c("low")) / 2), (c("vol_before") > 0) & (c("volume") > c("vol_before") * 1.5), (c("close") > c("ma10")) & (c("prev") <= c("ma10_prev")),
        (c("close") > c("sma20")) & (c("prev") <= c("ma20_prev")), c("k") > c("d"), c("macd_hist") > c("hist3"),
    )), F.lit(0))
    depth = (c("close") - c("high30")) / c("high30")
    stretched = c("atr14").isNotNull() & c("sma20").isNotNull() & (((c("close") - c("sma20")) / c("atr14") > 2.2) | (c("rsi14") > 75))
    pullback = (depth < -0.04) & (c("low10") < c("sma20"))
    trend = (c("close") > c("sma20")) & (c("macd") > c("macd_signal")) & (c("adx") > 25)
    entry = ladder((broken & yes((depth < -0.12) & (c("rsi6") > 50)), 5), (broken, 0), (yes(stretched), 1), (yes(pullback) & (reversal >= 2), 4), (yes(pullback), 2), (yes(trend), 3), otherwise=2)
    out = one.withColumns({"composite": composite, "risk": risk, "blocks": blocks, "reversal_signals": reversal, "entry_class": entry.cast("int")})
    n, critical = F.size("blocks"), F.arrays_overlap("blocks", F.array(F.lit("rsi_overbought"), F.lit("kdj_overbought")))
    free = ~F.coalesce(critical, F.lit(False))
    verdict = (
        F.when((c("composite") >= 70) & (c("risk") < 30) & free & (n <= 1), "buy").when((c("composite") >= 50) & (c("risk") < 50) & free & (n <= 2), "watch").when((c("risk") >= 50) | (n >= 3), "no")
        .when((c("composite") >= 40) & (c("risk") < 40), "watch").when(c("risk") >= 40, "reduce_risk").otherwise("no")
    )
    stop = F.least(F.coalesce("ma60", "low20"), c("low20")) - F.coalesce("atr14", F.lit(0.0))
    scored = out.select("symbol", "composite", "risk", F.concat_ws(",", "blocks").alias("blocks"), "reversal_signals", "entry_class", c("close").alias("entry_price"), F.bround(stop, 2).alias("stop_price"), c("high252").alias("target_price"), verdict.alias("verdict"))
    return bars.select("symbol").distinct().join(scored, "symbol", "left").withColumn("verdict", F.coalesce("verdict", F.lit("cannot_score")))


def relative_strength(prices: DataFrame, benchmark: DataFrame, s: fr.Series = DAILY) -> DataFrame:
    """(symbol, relative_strength): mean over 21, 63 and 126 bars of the scaled return in excess of the benchmark's."""
    spans = (21, 63, 126)
    moves = lambda df: last_values(df.select(s.key, s.order, *[(F.col("close") / s.lag("close", n) - 1).alias(f"r{n}") for n in spans]), [f"r{n}" for n in spans])
    base = moves(benchmark).agg(*[F.avg(f"r{n}").alias(f"b{n}") for n in spans])
    both = moves(prices).join(F.broadcast(base))  # one row
    score = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"r{n}") - F.col(f"b{n}") + 0.2) / 0.4)) * 100
    return both.select("symbol", (sum((score(n) for n in spans), F.lit(0.0)) / len(spans)).alias("relative_strength"))
