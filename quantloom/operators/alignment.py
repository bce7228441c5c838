"""Joins of time series: alignment, intervals, currencies, next sessions, levels; and portfolio statistics on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.functions import frames as fr


def aligned(prices: DataFrame, lookback: int = 120, key: str = "symbol", day: str = "day") -> DataFrame:
    """The last ``lookback`` + 1 times that every instrument has, and the returns between these.

    Times are counted once for all instruments, by an aggregate whose size doesn't grow with them.
    """
    everyone = prices.select(key).distinct().agg(F.count("*").alias("k"))
    common = prices.groupBy(day).agg(F.count_distinct(key).alias("c")).join(F.broadcast(everyone), F.col("c") == F.col("k"))  # one row
    last = common.orderBy(F.col(day).desc()).limit(lookback + 1).select(day)
    s = fr.Series(key, day)
    return prices.join(last, day, "left_semi").select(key, day, F.round(fr.simple_return(s, "close"), 10).alias("ret")).where("ret is not null")


def pairs(returns: DataFrame, key: str = "symbol", day: str = "day") -> DataFrame:
    """(a, b, covariance, correlation) of all pairs a <= b; a constant series correlates 0 with others and 1 with itself.

    The rows of one time meet in one group, so the cost is the times and the square of the instruments of each.
    """
    a, b = returns.select(day, F.col(key).alias("a"), F.col("ret").alias("x")), returns.select(day, F.col(key).alias("b"), F.col("ret").alias("y"))
    both = a.join(b, day).where("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("covariance"), F.corr("x", "y").alias("correlation"))
    return both.withColumn("correlation", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("correlation", F.lit(0.0))))


def correlation_summary(matrix: DataFrame) -> DataFrame:
    off = matrix.where("a < b")
    return off.agg(F.avg("correlation").alias("average_correlation"), F.max("correlation").alias("max_correlation"), F.count("*").alias("pairs"))


def simple_weights(returns: DataFrame, method: str, key: str = "symbol") -> DataFrame:
    """Equal or inverse-volatility weights."""
    v = returns.groupBy(key).agg(F.stddev_samp("ret").alias("vol"))
    raw = F.lit(1.0) if method == "equal_weight" else 1 / F.greatest(F.coalesce("vol", F.lit(0.0)), F.lit(1e-8))
    v = v.withColumn("raw", raw)
    return v.select(key, (F.col("raw") / F.sum("raw").over(W.Window.partitionBy())).alias("weight"))


def risk_parity(cov: np.ndarray, most: int = 50_000, tolerance: float = 1e-12) -> np.ndarray:
    """Long-only weights of equal risk contributions, by coordinate-wise roots of x_i (Sigma x)_i = 1/n."""
    n = len(cov)
    cov = cov + np.eye(n) * max(float(np.max(np.diag(cov))), 1e-12) * 1e-8
    x = 1 / np.sqrt(np.diag(cov))
    for _ in range(most):
        old = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.max(np.abs(x - old)) < tolerance * max(1.0, float(np.max(x))):
            break
    return x / x.sum()


def maximum_diversification(cov: np.ndarray) -> np.ndarray:
    """The long-only weights of the largest ratio of average to portfolio volatility, over all sets of assets held."""
    n = len(cov)
    vol = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    best, ratio = 1 / vol / (1 / vol).sum(), -np.inf
    ridge = max(float(np.max(np.diag(cov))), 1e-12) * 1e-8
    for held in range(1, 1 << n):
        at = np.flatnonzero([held >> i & 1 for i in range(n)])
        sub = cov[np.ix_(at, at)] + np.eye(len(at)) * ridge
        x = np.linalg.solve(sub, vol[at])
        if (x > 0).all():
            w = np.zeros(n)
            w[at] = x / x.sum()
            r = float(w @ vol / np.sqrt(w @ cov @ w))
            if r > ratio + 1e-12:
                best, ratio = w, r
    return best


MAX_ASSETS = 64


def optimised_weights(matrix: DataFrame, method: str, group: Column | None = None) -> DataFrame:
    """(portfolio, symbol, weight) of each portfolio's covariance pairs; one small matrix a group."""
    rows = matrix.withColumn("portfolio", F.lit("all") if group is None else group).select("portfolio", "a", "b", "covariance")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.a, *pdf.b})
        if len(names) > MAX_ASSETS or method == "maximum_diversification" and len(names) > 16:
            raise ValueError(f"{len(names)} assets in a portfolio")
        at = {x: i for i, x in enumerate(names)}
        cov = np.zeros((len(names), len(names)))
        for a, b, c in zip(pdf.a, pdf.b, pdf.covariance, strict=True):
            cov[at[a], at[b]] = cov[at[b], at[a]] = c
        w = risk_parity(cov) if method == "risk_parity" else maximum_diversification(cov)
        return pd.DataFrame({"portfolio": pdf.portfolio.iloc[0], "symbol": names, "weight": w})

    return rows.groupBy("portfolio").applyInPandas(run, "portfolio string, symbol string, weight double")


def contributions(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """(symbol, weight, risk_contribution): each asset's share of the portfolio's variance."""
    full = matrix.select("a", "b", "covariance").union(matrix.where("a < b").select("b", "a", "covariance"))
    w = weights.select("symbol", "weight")
    each = full.join(w.withColumnRenamed("symbol", "b").withColumnRenamed("weight", "wb"), "b").groupBy("a").agg(F.sum(F.col("covariance") * F.col("wb")).alias("m"))
    each = each.join(w.withColumnRenamed("symbol", "a"), "a").withColumn("c", F.col("weight") * F.col("m"))
    return each.select(F.col("a").alias("symbol"), "weight", (F.col("c") / F.sum("c").over(W.Window.partitionBy())).alias("risk_contribution"), F.sum("c").over(W.Window.partitionBy()).alias("variance"))


def intervals_in_common(returns: DataFrame, key: str = "symbol") -> DataFrame:
    """(start_date, end_date, values map) of the intervals that every series has exactly."""
    k = F.broadcast(returns.select(key).distinct().agg(F.count("*").alias("k")))  # one row
    one = returns.groupBy("start_date", "end_date").agg(F.count_distinct(key).alias("c"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "value")))).alias("values"))
    return one.join(k, F.col("c") == F.col("k")).select("start_date", "end_date", "values")


def merge_panels(panels: list[DataFrame]) -> DataFrame:
    """One panel of the periods that all have; a factor in two panels is an error."""
    out = panels[0]
    for p in panels[1:]:
        out = out.join(p.withColumnRenamed("values", "__v"), ["start_date", "end_date"]).withColumn("values", F.map_concat("values", "__v")).drop("__v")
    return out


def keep_keys(panel: DataFrame, keys: list[str]) -> DataFrame:
    return panel.withColumn("values", F.map_filter("values", lambda k, _: k.isin(keys)))


def converted(returns: DataFrame, fx: DataFrame) -> DataFrame:
    """Returns in another currency: both ends of an interval need a level, and none is carried on."""
    start, end = fx.select(F.col("date").alias("start_date"), F.col("level").alias("f0")), fx.select(F.col("date").alias("end_date"), F.col("level").alias("f1"))
    return returns.join(start, "start_date").join(end, "end_date").withColumn("value", (1 + F.col("value")) * F.col("f1") / F.col("f0") - 1).drop("f0", "f1")


def from_levels(levels: DataFrame, key: str = "symbol", day: str = "day", value: str = "value") -> DataFrame:
    """Interval returns of adjacent levels; a missing level breaks the chain on both sides."""
    s = fr.Series(key, day)
    rows = levels.select(key, s.lag(day).alias("start_date"), F.col(day).alias("end_date"), (F.col(value) / s.lag(value) - 1).alias("value"))
    return rows.where("value is not null")


def monthly(returns: DataFrame, sessions: DataFrame, key: str = "symbol") -> DataFrame:
    """Compounded returns of the months of which a series has every session (a column ``day``)."""
    expected = sessions.groupBy(F.last_day("day").alias("month")).agg(F.count("*").alias("expected"))
    got = returns.groupBy(key, F.last_day("end_date").alias("month")).agg(F.count_distinct("end_date").alias("n"), (F.product(1 + F.col("value")) - 1).alias("value"))
    return got.join(expected, "month").where("n = expected").select(key, "month", "value")


def weekdays(start: str, end: str, spark) -> DataFrame:
    """Monday to Friday."""
    days = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS day")
    return days.where("weekday(day) < 5")


def next_session(dates: DataFrame, sessions: DataFrame, date: str = "formation") -> DataFrame:
    """Each date with the first session after it: sessions and dates share one ordered window, so none is compared."""
    both = dates.select(F.col(date).alias("d"), F.lit(1).alias("kind")).union(sessions.select(F.col("day"), F.lit(0)))
    ahead = W.Window.orderBy(F.col("d").desc(), F.col("kind").desc()).rowsBetween(W.Window.unboundedPreceding, -1)
    entry = F.last(F.when(F.col("kind") == 0, F.col("d")), ignorenulls=True).over(ahead)
    return both.select("d", "kind", entry.alias("entry")).where("kind = 1").select(F.col("d").alias(date), "entry")


def turnover(weights: DataFrame, period: str = "period") -> DataFrame:
    """Half the absolute change of weights from the period before; 1 for the first."""
    periods = weights.select(period).distinct().withColumn("__prev", F.lag(period).over(W.Window.orderBy(period)))
    now = weights.join(periods, period)
    prev = weights.select(F.col(period).alias("__prev"), "symbol", F.col("weight").alias("__w0"))
    gone = prev.join(periods, "__prev").select(period, "symbol", F.lit(0.0).alias("weight"), "__w0")
    both = now.join(prev, ["__prev", "symbol"], "left").select(period, "symbol", "weight", F.coalesce("__w0", F.lit(0.0)).alias("__w0"))
    change = both.unionByName(gone.join(weights.select(period, "symbol"), [period, "symbol"], "left_anti")).groupBy(period).agg((F.sum(F.abs(F.col("weight") - F.col("__w0"))) / 2).alias("t"))
    return change.join(periods, period).select(period, F.when(F.col("__prev").isNull(), 1.0).otherwise(F.col("t")).alias("turnover"))
