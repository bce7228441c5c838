"""Return statistics, volatility regimes and Markov regimes of many instruments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.functions import frames as fr

MIN_RETURNS = 30


def with_returns(prices: DataFrame, s: fr.Series = fr.Series()) -> DataFrame:
    """Rounded to ten places, so that equal moves are equal in every comparison."""
    return prices.withColumns({"ret": F.round(fr.simple_return(s, "close"), 10), "log_ret": F.round(fr.log_return(s, "close"), 10)})


def max_drawdown(prices: DataFrame, key: str = "symbol", s: fr.Series = fr.Series()) -> DataFrame:
    return prices.select(key, fr.drawdown(s).alias("dd")).groupBy(key).agg(F.when(F.count("*") >= 2, F.min("dd")).alias("max_drawdown"))


def risk_statistics(prices: DataFrame, key: str = "symbol", year: int = 252, s: fr.Series = fr.Series()) -> DataFrame:
    """Nine historical risk statistics of each instrument that has MIN_RETURNS returns.

    Value at risk is the interpolated 5 % quantile, its shortfall the mean of the returns at or below it. A constant
    series has skewness and kurtosis 0.
    """
    rows = with_returns(prices, s).withColumn("dd", fr.drawdown(s))
    tail = rows.where("ret is not null").groupBy(key).agg(F.percentile("ret", F.lit(0.05)).alias("q05"))
    joined = rows.join(tail.withColumn("q05", F.round("q05", 10)), key)
    root = F.sqrt(F.lit(float(year)))
    r = F.col("ret")
    out = joined.groupBy(key).agg(
        F.count("ret").alias("n"),
        (F.stddev_samp(r) * root).alias("annualized_volatility"),
        (F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), 2)))) * root).alias("downside_volatility"),
        F.min("dd").alias("max_drawdown"),
        F.greatest(F.lit(0.0), -F.first("q05")).alias("historical_var_95"),
        F.greatest(F.lit(0.0), -F.avg(F.when(r <= F.col("q05"), r))).alias("historical_cvar_95"),
        F.coalesce(F.skewness(r), F.lit(0.0)).alias("return_skewness"),
        F.coalesce(F.kurtosis(r), F.lit(0.0)).alias("return_excess_kurtosis"),
        F.max(r).alias("best_daily_return"),
        F.min(r).alias("worst_daily_return"),
    )
    return out.where(F.col("n") >= MIN_RETURNS)


METRICS = ("annualized_volatility", "downside_volatility", "max_drawdown", "historical_var_95", "historical_cvar_95", "return_skewness", "return_excess_kurtosis", "best_daily_return", "worst_daily_return")


def unpivot(wide: DataFrame, metrics: tuple[str, ...], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Long (keys, metric, value) observations, values rounded half-even to ten places, missing ones left out."""
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = wide.selectExpr(*keys, f"stack({len(metrics)}, {stack}) as (metric, value)")
    return long.where("value is not null").withColumn("value", F.bround("value", 10))


def volatility_regime(prices: DataFrame, key: str = "symbol", window: int = 20, lookback: int = 120, year: int = 252, s: fr.Series = fr.Series()) -> DataFrame:
    """Percentile of the latest realised volatility among the last ``lookback``, its regime code and its trend."""
    rows = with_returns(prices, s).withColumn("vol", F.round(fr.volatility(s, "log_ret", window, year), 10)).where("vol is not null")
    rows = rows.withColumn("back", F.row_number().over(W.Window.partitionBy(key).orderBy(F.col(s.order).desc()))).where(F.col("back") <= lookback)
    one = rows.groupBy(key).agg(F.count("*").alias("n"), F.min_by("vol", "back").alias("current"), F.max(F.when(F.col("back") == 2, F.col("vol"))).alias("previous"), F.collect_list("vol").alias("all"))
    below = F.size(F.filter("all", lambda v: v < F.col("current")))
    tied = F.size(F.filter("all", lambda v: v == F.col("current")))
    out = one.where(F.col("n") == lookback).withColumn("percentile", (below + (tied - 1) / 2) / (F.col("n") - 1))
    code = F.when(F.col("percentile") <= 0.2, 0.0).when(F.col("percentile") >= 0.8, 2.0).otherwise(1.0)
    trend = F.when(F.col("current") > F.col("previous") * 1.05, 1.0).when(F.col("current") < F.col("previous") * 0.95, -1.0).otherwise(0.0)
    return out.select(key, F.col("current").alias("annualized_volatility"), F.col("percentile").alias("volatility_regime_percentile"), code.alias("volatility_regime_code"), trend.alias("volatility_trend"))


def regimes(prices: DataFrame, window: int = 20, bull: float = 0.05, bear: float = -0.05, s: fr.Series = fr.Series()) -> DataFrame:
    """``prices`` with idx (from 0), the rolling return and the regime label, which is 1 before the window is full."""
    rows = prices.withColumn("idx", s.number - 1).withColumn("roll", F.round(F.coalesce(fr.simple_return(s, "close", window), F.lit(0.0)), 10))
    return rows.withColumn("label", F.when(F.col("idx") >= window, fr.regime_label(F.col("roll"), bull, bear)).otherwise(1))


def transitions(labelled: DataFrame, key: str = "symbol", window: int = 20, s: fr.Series = fr.Series()) -> DataFrame:
    """(key, origin, target, probability), nine rows an instrument; a regime never left has even probabilities."""
    rows = labelled.withColumn("next", F.lead("label").over(s.w)).where((F.col("idx") >= window) & F.col("next").isNotNull())
    counts = rows.groupBy(key, F.col("label").alias("origin"), F.col("next").alias("target")).agg(F.count("*").alias("c"))
    cells = labelled.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("origin")).select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("target"))
    full = cells.join(counts, [key, "origin", "target"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = F.sum("c").over(W.Window.partitionBy(key, "origin"))
    return full.select(key, "origin", "target", F.when(total > 0, F.col("c") / total).otherwise(F.lit(1.0) / 3).alias("probability"))


def stationary(matrix: DataFrame, key: str = "symbol", most: int = 1000, tolerance: float = 1e-10) -> DataFrame:
    """Stationary probabilities of each instrument's 3x3 matrix by power iteration, a fold inside the JVM."""
    cell = lambda i, j: F.max(F.when((F.col("origin") == i) & (F.col("target") == j), F.col("probability")))
    wide = matrix.groupBy(key).agg(*[cell(i, j).alias(f"p{i}{j}") for i in range(3) for j in range(3)])
    third = F.lit(1.0) / 3
    start = F.struct(third.alias("a"), third.alias("b"), third.alias("c"), F.lit(False).alias("done"))

    def step(x: Column, _: Column) -> Column:
        new = [sum((x[n] * F.col(f"p{i}{j}") for i, n in enumerate("abc")), F.lit(0.0)) for j in range(3)]
        delta = sum((F.abs(v - x[n]) for v, n in zip(new, "abc", strict=True)), F.lit(0.0))
        kept = [F.when(x["done"], x[n]).otherwise(v).alias(n) for v, n in zip(new, "abc", strict=True)]
        return F.struct(*kept, (x["done"] | (delta < tolerance)).alias("done"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return wide.select(key, done.alias("z")).select(key, F.col("z.a").alias("bear"), F.col("z.b").alias("sideways"), F.col("z.c").alias("bull"))


def walk_forward(labelled: DataFrame, window: int = 20, s: fr.Series = fr.Series()) -> DataFrame:
    """``labelled`` with ``signal``: P(bull) - P(bear) from the transitions seen up to each bar, given its label.

    Transition counts are running sums over one window, so the whole series costs one pass.
    """
    before = F.lag("label").over(s.w)
    seen = (F.col("idx") > window) & before.isNotNull()
    rows = labelled.withColumn("__from", F.when(seen, before))
    up = [F.sum(F.when((F.col("__from") == i) & (F.col("label") == 2), 1).otherwise(0)).over(s.so_far).alias(f"u{i}") for i in range(3)]
    down = [F.sum(F.when((F.col("__from") == i) & (F.col("label") == 0), 1).otherwise(0)).over(s.so_far).alias(f"d{i}") for i in range(3)]
    every = [F.sum(F.when(F.col("__from") == i, 1).otherwise(0)).over(s.so_far).alias(f"t{i}") for i in range(3)]
    wide = rows.select("*", *up, *down, *every)
    pick = lambda p: F.element_at(F.array(*[F.col(f"{p}{i}") for i in range(3)]), F.col("label") + 1)
    signal = F.when(pick("t") > 0, (pick("u") - pick("d")) / pick("t")).otherwise(0.0)
    return wide.withColumn("signal", signal).drop("__from", *[f"{p}{i}" for p in "udt" for i in range(3)])


def walk_forward_backtest(signals: DataFrame, key: str = "symbol", min_train: int = 252, s: fr.Series = fr.Series(), idle: float = 0.0) -> DataFrame:
    """Sharpe ratio (population, 252 days), drawdown and number of steps when each bar's position is the signal of the
    bar before and earns the next bar's move. Steps that all earn the same have an infinite ratio of the mean's sign,
    and the ratio ``idle`` if they earn nothing, as when no position was ever taken."""
    rows = signals.select(key, s.order, "idx", (F.lag("signal").over(s.w) * (F.lead("close").over(s.w) / F.col("close") - 1)).alias("r"))
    rows = rows.where((F.col("idx") >= min_train) & F.col("r").isNotNull())
    rows = rows.withColumn("equity", F.product(1 + F.col("r")).over(s.so_far))
    rows = rows.withColumn("dd", 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(s.so_far)))
    mean, deviation = F.avg("r"), F.stddev_pop("r")
    even = F.when(mean > 0, float("inf")).when(mean < 0, float("-inf")).otherwise(idle)
    return rows.groupBy(key).agg(F.round(F.when(deviation > 0, mean / deviation * F.sqrt(F.lit(252.0))).otherwise(even), 6).alias("sharpe"), F.round(F.greatest(F.lit(0.0), F.max("dd")), 6).alias("max_drawdown"), F.count("*").alias("n_trades"))


def markov(prices: DataFrame, key: str = "symbol", window: int = 20, bull: float = 0.05, bear: float = -0.05, s: fr.Series = fr.Series()) -> DataFrame:
    """Per instrument: current regime, signal, stationary probabilities, persistence, and the reading of the signal."""
    labelled = regimes(prices, window, bull, bear, s)
    matrix = transitions(labelled, key, window, s)
    now = labelled.groupBy(key).agg(F.max_by("label", s.order).alias("regime"), F.count("*").alias("n"))
    p = lambda target: F.max(F.when(F.col("target") == target, F.col("probability")))
    row = matrix.join(now.select(key, "regime"), key).where("origin = regime").groupBy(key).agg((p(2) - p(0)).alias("signal"))
    stay = matrix.groupBy(key).agg(*[F.max(F.when((F.col("origin") == i) & (F.col("target") == i), F.col("probability"))).alias(f"persistence_{n}") for i, n in enumerate(("bear", "sideways", "bull"))])
    out = now.where("n >= 30").join(row, key).join(stationary(matrix, key), key).join(stay, key)
    return out.withColumn("reading", F.when(F.col("signal") > 0.3, "bullish").when(F.col("signal") < -0.3, "bearish").otherwise("neutral"))
