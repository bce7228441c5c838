"""Outcomes of signals: fixed horizons, triple barriers, non-overlap, summaries, resampling."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

Z95 = 1.959963984540054


def points(bars: DataFrame, at: str = "day", entry: str | None = "open") -> DataFrame:
    """Outcome points numbered from 0: value is the close, execution the entry price, high and low as far as there."""
    w = W.Window.partitionBy("symbol").orderBy(at)
    execution = F.coalesce(F.col(entry), F.col("close")) if entry else F.col("close")
    return bars.select("symbol", F.col(at).alias("at"), (F.row_number().over(w) - 1).alias("idx"), F.col("close").alias("value"), execution.alias("execution"), F.coalesce("high", "close").alias("upper"), F.coalesce("low", "close").alias("lower"))


def change(entry: Column, mark: Column, direction: Column, relative: bool = True) -> Column:
    raw = mark / entry - 1 if relative else mark - entry
    return F.round(F.when(direction == "long", raw).otherwise(-raw), 10)


def barrier_value(entry: Column, move: Column, direction: Column, relative: bool = True) -> Column:
    signed = F.when(direction == "long", move).otherwise(-move)
    return entry * (1 + signed) if relative else entry + signed


def _entered(pts: DataFrame, events: DataFrame, lag: int) -> DataFrame:
    """Events with their entry: an event whose time is no point, or whose entry lies beyond the last, has none."""
    found = events.join(pts.select("symbol", "at", "idx"), ["symbol", "at"])
    entry = pts.select("symbol", F.col("idx").alias("entry_idx"), F.col("at").alias("entry_at"), F.col("execution").alias("entry"))
    return found.withColumn("entry_idx", F.col("idx") + lag).join(entry, ["symbol", "entry_idx"])


def _path(entered: DataFrame, pts: DataFrame, bars: int) -> DataFrame:
    """One row for each event and each of its next ``bars`` points: exploded by number, then joined by equality."""
    ahead = entered.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(bars)))).withColumn("p", F.col("entry_idx") + F.col("step"))
    return ahead.join(pts.select("symbol", F.col("idx").alias("p"), F.col("at").alias("p_at"), "value", "upper", "lower"), ["symbol", "p"])


def _sides(rows: DataFrame, relative: bool) -> DataFrame:
    long = F.col("direction") == "long"
    good, bad = F.when(long, F.col("upper")).otherwise(F.col("lower")), F.when(long, F.col("lower")).otherwise(F.col("upper"))
    return rows.withColumns({"fav": change(F.col("entry"), good, F.col("direction"), relative), "adv": change(F.col("entry"), bad, F.col("direction"), relative), "chg": change(F.col("entry"), F.col("value"), F.col("direction"), relative)})


_KEYS = ("symbol", "at", "direction", "entry_idx", "entry_at", "entry")


def fixed_horizon(pts: DataFrame, events: DataFrame, horizon: int = 21, lag: int = 1, risk: float = 0.03, relative: bool = True) -> DataFrame:
    """Events' outcomes at a fixed number of bars; those whose horizon isn't complete are left out."""
    rows = _sides(_path(_entered(pts, events, lag), pts, horizon), relative)
    out = rows.groupBy(*_KEYS).agg(
        F.max_by("p_at", "step").alias("exit_at"), F.max_by("chg", "step").alias("change"), F.max("step").alias("steps"),
        F.greatest(F.lit(0.0), F.max("fav")).alias("max_favorable"), F.least(F.lit(0.0), F.min("adv")).alias("max_adverse"),
    )
    return out.where(F.col("steps") == horizon).withColumn("r_multiple", F.col("change") / risk).withColumn("exit_reason", F.lit("fixed_horizon")).drop("steps")


def triple_barrier(pts: DataFrame, events: DataFrame, most: int = 63, lag: int = 1, target: float = 0.05, stop: float = 0.03, relative: bool = True) -> DataFrame:
    """Events' outcomes at the first bar that reaches target or stop, else at the time limit.

    A bar that reaches both counts as the stop. An event that reaches neither and lacks bars to the limit is left out.
    """
    rows = _sides(_path(_entered(pts, events, lag), pts, most), relative)
    hit = (F.col("fav") >= target) | (F.col("adv") <= -stop)
    w = W.Window.partitionBy("symbol", "at")
    rows = rows.withColumn("hit", F.min(F.when(hit, F.col("step"))).over(w)).withColumn("there", F.max("step").over(w))
    rows = rows.where(F.col("hit").isNotNull() | (F.col("there") == most)).withColumn("exit", F.coalesce("hit", F.lit(most))).where("step <= exit")
    last = F.col("step") == F.col("exit")
    out = rows.groupBy(*_KEYS, "hit", "exit").agg(
        F.max(F.when(last, F.col("p_at"))).alias("exit_at"), F.max(F.when(last, F.col("chg"))).alias("mark"), F.bool_or(last & (F.col("fav") >= target)).alias("won"), F.bool_or(last & (F.col("adv") <= -stop)).alias("lost"),
        F.greatest(F.lit(0.0), F.max("fav")).alias("max_favorable"), F.least(F.lit(0.0), F.min("adv")).alias("max_adverse"),
    )
    reason = F.when(F.col("hit").isNull(), "time_limit").when(F.col("lost"), "stop_loss").otherwise("profit_target")
    out = out.withColumn("exit_reason", reason).withColumn("change", F.when(F.col("exit_reason") == "stop_loss", -stop).when(F.col("exit_reason") == "profit_target", target).otherwise(F.col("mark")))
    ambiguous = F.col("hit").isNotNull() & F.col("won") & F.col("lost")
    return out.select(*_KEYS, "exit_at", "change", "max_favorable", "max_adverse", (F.col("change") / stop).alias("r_multiple"), "exit_reason", F.col("exit").alias("duration"), ambiguous.alias("ambiguous"))


def non_overlapping(outcomes: DataFrame, embargo: int) -> DataFrame:
    """Greedy choice in time order: an event is taken if its entry lies more than ``embargo`` bars after the last taken."""
    one = outcomes.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("entry_idx", "at"))).alias("e"))
    start = F.struct(F.lit(-(10**9)).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        take = x["entry_idx"].cast("bigint") > acc["last"] + embargo
        return F.when(take, F.struct(x["entry_idx"].cast("bigint").alias("last"), F.concat(acc["kept"], F.array(x["entry_idx"].cast("bigint"))).alias("kept"))).otherwise(acc)

    kept = one.select("symbol", F.explode(F.aggregate("e", start, step)["kept"]).alias("entry_idx"))
    return outcomes.join(kept, ["symbol", "entry_idx"], "left_semi")


def wilson_lower(wins: Column, n: Column) -> Column:
    z2, p = Z95 * Z95, wins / n
    return F.greatest(F.lit(0.0), (p + z2 / (2 * n) - Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n))


def summarise(outcomes: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts, win and loss averages, break-even rate, edge, profit factor and the share of the five best wins."""
    c, r = F.col("change"), F.col("r_multiple")
    w = W.Window.partitionBy(*by).orderBy(r.desc(), F.col("at"))
    rows = outcomes.withColumn("__best", F.row_number().over(w))
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("event_count"), F.count_if(c > 0).alias("win_count"), F.count_if(c < 0).alias("loss_count"), F.count_if(c == 0).alias("breakeven_count"),
        F.avg(F.when(c > 0, c)).alias("average_win"), F.abs(F.avg(F.when(c < 0, c))).alias("average_loss"), F.avg(win).alias("average_win_r"), F.abs(F.avg(loss)).alias("average_loss_r"),
        F.avg(c).alias("expected_value"), F.avg(r).alias("expected_r"), F.try_divide(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"),
        F.try_divide(F.sum(F.when(F.col("__best") <= 5, win)), F.sum(win)).alias("top_five_win_contribution"),
    )
    out = out.withColumn("win_rate", F.col("win_count") / F.col("event_count")).withColumn("reward_risk_ratio", F.try_divide("average_win_r", "average_loss_r"))
    flat = F.col("breakeven_count") / F.col("event_count")
    out = out.withColumn("break_even_win_rate", F.try_divide((1 - flat) * F.col("average_loss_r"), F.col("average_win_r") + F.col("average_loss_r")))
    return out.withColumn("edge_over_break_even", F.col("win_rate") - F.col("break_even_win_rate")).withColumn("win_rate_lower_95", wilson_lower(F.col("win_count"), F.col("event_count")))


def period_of(outcomes: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Outcomes with the period of their signal, and whether they are purged because they end after it."""
    name = F.coalesce(*[F.when(F.col("at").between(F.lit(a).cast("date"), F.lit(b).cast("date")), n) for n, a, b in periods])
    end = F.coalesce(*[F.when(F.col("at").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(b).cast("date")) for n, a, b in periods])
    return outcomes.withColumn("period", name).withColumn("purged", F.col("exit_at") > end).where("period is not null")


def block_bootstrap(outcomes: DataFrame, samples: int = 1000, seed: int = 7, key: str = "symbol") -> DataFrame:
    """Per instrument 2.5, 50 and 97.5 % of the mean R of circular block resamples, and the positive share.

    Blocks have the rounded square root of the number of outcomes; one small group an instrument, with a seeded
    generator, so reruns and lost tasks give the same figures.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("entry_idx").r_multiple.to_numpy(float)
        n, size = len(r), max(1, round(len(r) ** 0.5))
        rng = random.Random(seed)
        starts = np.array([[rng.randrange(n) for _ in range(-(-n // size))] for _ in range(samples)])
        index = ((starts[:, :, None] + np.arange(size)) % n).reshape(samples, -1)[:, :n]
        means = r[index].mean(axis=1)
        low, mid, high = np.quantile(means, [0.025, 0.5, 0.975])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [n], "block_length": [size], "lower_95": [low], "median": [mid], "upper_95": [high], "positive_fraction": [float((means > 0).mean())]})

    kind = outcomes.schema[key].dataType.simpleString()
    return outcomes.select(key, "entry_idx", "r_multiple").groupBy(key).applyInPandas(run, f"{key} {kind}, n bigint, block_length bigint, lower_95 double, median double, upper_95 double, positive_fraction double")


def matched_baseline(all_outcomes: DataFrame, events: DataFrame, trials: int = 100, seed: int = 7) -> DataFrame:
    """Per instrument mean R and its 95 % range over random draws of as many (time, direction) outcomes as events.

    ``all_outcomes`` holds the outcome of every eligible time in both directions, computed once; a draw only looks up.
    """
    n = events.groupBy(F.col("symbol").alias("wanted_symbol"), "direction").agg(F.count("*").alias("n"))

    def run(outcomes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(outcomes) or not len(wanted):
            return pd.DataFrame({"symbol": [], "trials": [], "mean_r": [], "lower_95": [], "upper_95": []})
        wanted, rng, means = wanted.sort_values("direction"), np.random.default_rng(seed), []
        by = {d: g.sort_values("at").r_multiple.to_numpy(float) for d, g in outcomes.groupby("direction")}
        for _ in range(trials):
            drawn = [rng.choice(by[d], min(int(k), len(by[d])), replace=False) for d, k in zip(wanted.direction, wanted.n, strict=True) if d in by]
            if drawn:
                means.append(float(np.concatenate(drawn).mean()))
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"symbol": [outcomes.symbol.iloc[0]], "trials": [len(means)], "mean_r": [float(np.mean(means))], "lower_95": [low], "upper_95": [high]})

    return all_outcomes.groupBy("symbol").cogroup(n.groupBy("wanted_symbol")).applyInPandas(run, "symbol string, trials bigint, mean_r double, lower_95 double, upper_95 double")
