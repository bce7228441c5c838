"""Tranche backtest: fixed-notional additions, first-in-first-out reductions, exits, stops; one pass an instrument.

Orders of a close are filled at the next open: entries at the open plus the spread; commission on both sides. Stops and
targets hang on each lot from the bar after its minimum holding, the stop before the target, filled at their price or at
a worse open. Sizes are multiples of 1e-8. Positions are state over ordered bars, so the simulation is a kernel.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

UNIT = 1e-8


@dataclass(frozen=True)
class Plan:
    budget: float = 1000.0
    tranche: float = 0.2
    cap: float = 0.8
    commission: float = 0.001
    spread: float = 0.0
    min_add: int = 1
    min_hold: int = 1
    stop: float | None = None
    target: float | None = None


@dataclass
class Lot:
    bar: int
    size: float
    price: float
    fee: float


def simulate(bars: pd.DataFrame, plan: Plan) -> tuple[list[dict], list[tuple]]:
    """(trades, equity by bar) of one instrument's bars with the columns action, open, high, low, close."""
    cash, lots, trades, curve = plan.budget, [], [], []
    want_add = want_exit = False
    reduce_by, last_add = 0, None

    def close(lot: Lot, bar: int, price: float, why: str) -> None:
        nonlocal cash
        fee = lot.size * price * plan.commission
        cash += lot.size * price - fee
        trades.append({"entry_bar": lot.bar, "exit_bar": bar, "size": lot.size, "entry_price": lot.price, "exit_price": price, "commission": lot.fee + fee, "pnl": lot.size * (price - lot.price) - lot.fee - fee, "reason": why})
        lots.remove(lot)

    for i, b in enumerate(bars.itertuples(index=False)):
        held = [x for x in lots if i - x.bar >= plan.min_hold]
        for x in held if want_exit else held[:reduce_by]:
            close(x, i, b.open, "strategy_exit" if want_exit else "strategy_reduce")
            reduce_by = max(0, reduce_by - 1)
        want_exit = want_exit and bool(lots)
        if want_add:
            price = b.open * (1 + plan.spread)
            size = int(plan.budget * plan.tranche / (price * (1 + plan.commission)) / UNIT) * UNIT
            if size > 0 and size * price * (1 + plan.commission) <= cash + 1e-9:
                fee = size * price * plan.commission
                cash -= size * price + fee
                lots.append(Lot(i, size, price, fee))
        want_add = False
        for x in [x for x in lots if i - x.bar >= plan.min_hold]:
            low, high = x.price * (1 - plan.stop) if plan.stop else None, x.price * (1 + plan.target) if plan.target else None
            if low is not None and b.low <= low:
                close(x, i, min(low, b.open), "stop_loss")
            elif high is not None and b.high >= high:
                close(x, i, max(high, b.open), "take_profit")
        if b.action == "exit_long" and lots:
            want_exit, reduce_by = True, 0
        elif b.action == "reduce_long" and lots:
            reduce_by = min(reduce_by + 1, len(lots))
        elif b.action == "add_long" and not want_exit and (last_add is None or i - last_add >= plan.min_add):
            deployed = sum(x.size * x.price for x in lots)
            if plan.budget * plan.cap - deployed + 1e-9 >= plan.budget * plan.tranche and cash + 1e-9 >= plan.budget * plan.tranche:
                want_add, last_add = True, i
        curve.append((i, cash + sum(x.size * b.close for x in lots), sum(x.size * x.price for x in lots)))
    for x in lots:
        trades.append({"entry_bar": x.bar, "exit_bar": None, "size": x.size, "entry_price": x.price, "exit_price": None, "commission": x.fee, "pnl": x.size * (float(bars.close.iloc[-1]) - x.price) - x.fee, "reason": "open"})
    return trades, curve


def flagged(bars: DataFrame, actions: DataFrame, day: str = "day") -> DataFrame:
    """Bars with the action of their close; actions at times that are no bar are lost, see unmatched()."""
    return bars.join(actions.withColumnRenamed("at", day), ["symbol", day], "left")


def unmatched(bars: DataFrame, actions: DataFrame, day: str = "day") -> DataFrame:
    return actions.withColumnRenamed("at", day).join(bars.select("symbol", day), ["symbol", day], "left_anti")


def _run(rows: DataFrame, plan: Plan, schema: str, pick) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day").reset_index(drop=True)
        return pick(pdf, *simulate(pdf, plan))

    return rows.select("symbol", "day", "open", "high", "low", "close", "action").groupBy("symbol").applyInPandas(run, schema)


_TRADES = "symbol string, entry_bar bigint, exit_bar bigint, size double, entry_price double, exit_price double, commission double, pnl double, reason string"


def trades(bars: DataFrame, actions: DataFrame, plan: Plan = Plan()) -> DataFrame:
    names = [x.split()[0] for x in _TRADES.split(", ")]

    def pick(pdf, made, _):
        out = pd.DataFrame(made, columns=names[1:]).assign(symbol=pdf.symbol.iloc[0])[names]
        return out.assign(exit_bar=out.exit_bar.astype("Int64"), exit_price=out.exit_price.astype("Float64"))

    return _run(flagged(bars, actions), plan, _TRADES, pick)


def equity(bars: DataFrame, actions: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(symbol, bar, day, close, equity, deployed)."""

    def pick(pdf, _, curve):
        return pd.DataFrame({"symbol": pdf.symbol, "bar": [x[0] for x in curve], "day": pdf.day, "close": pdf.close, "equity": [x[1] for x in curve], "deployed": [x[2] for x in curve]})

    return _run(flagged(bars, actions), plan, "symbol string, bar bigint, day date, close double, equity double, deployed double", pick)


def headline(curve: DataFrame, done: DataFrame) -> DataFrame:
    """Final equity, return, buy-and-hold, drawdown, Sharpe ratio, exposure, trades and win rate."""
    w = W.Window.partitionBy("symbol").orderBy("bar")
    rows = curve.withColumn("r", F.col("equity") / F.lag("equity").over(w) - 1).withColumn("dd", 1 - F.col("equity") / F.max("equity").over(w))
    one = rows.groupBy("symbol").agg(
        F.max_by("equity", "bar").alias("final_equity"), (F.max_by("equity", "bar") / F.min_by("equity", "bar") - 1).alias("return"), (F.max_by("close", "bar") / F.min_by("close", "bar") - 1).alias("buy_and_hold"),
        F.max("dd").alias("max_drawdown"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.avg("deployed").alias("mean_deployed"), F.max("deployed").alias("max_deployed"),
    )
    closed = F.col("reason") != "open"
    own = done.groupBy("symbol").agg(
        F.count_if(closed).alias("trades"), F.try_divide(F.count_if(closed & (F.col("pnl") > 0)), F.count_if(closed)).alias("win_rate"), F.sum("commission").alias("commissions"), F.sum(F.when(closed, F.col("pnl"))).alias("realised"), F.sum(F.when(~closed, F.col("pnl"))).alias("open_pnl"),
        F.try_divide(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.abs(F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))))).alias("profit_factor"),
    )
    return one.join(own, "symbol", "left")


def sampled(curve: DataFrame, done: DataFrame | None = None, most: int = 520) -> DataFrame:
    """At most ``most`` bars of each instrument: the ends, the entry and exit bars of the trades ``done``, and evenly
    spread others, places rounded half to even. If these alone are more, evenly spread ones of them."""
    by = W.Window.partitionBy("symbol")
    rows = curve.withColumns({"__must": (F.col("bar") == F.min("bar").over(by)) | (F.col("bar") == F.max("bar").over(by))})
    if done is not None:
        stamps = done.select("symbol", F.explode(F.array("entry_bar", "exit_bar")).alias("bar")).where("bar is not null").distinct()
        rows = rows.join(stamps.withColumn("__at", F.lit(True)), ["symbol", "bar"], "left").withColumn("__must", F.col("__must") | F.col("__at").isNotNull()).drop("__at")
    rows = rows.withColumn("__pos", F.row_number().over(W.Window.partitionBy("symbol", "__must").orderBy("bar")) - 1)
    count = rows.groupBy("symbol").agg(F.count_if("__must").alias("m"), F.count("*").alias("n"))
    sides = count.select("symbol", F.explode(F.array(*[F.struct(F.lit(must).alias("__must"), n.alias("n"), k.alias("k")) for must, n, k in (
        (True, F.col("m"), F.least("m", F.lit(most))), (False, F.col("n") - F.col("m"), F.least(F.col("n") - F.col("m"), F.greatest(most - F.col("m"), F.lit(0)))))])).alias("z")).select("symbol", "z.*").where("k > 0")
    even = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda i: F.when(F.col("k") == 1, F.floor(F.col("n") / 2)).otherwise(F.bround(i * (F.col("n") - 1) / F.greatest(F.col("k") - 1, F.lit(1)), 0)).cast("bigint"))
    places = sides.select("symbol", "__must", F.explode(even).alias("__pos")).distinct()
    return rows.join(places, ["symbol", "__must", "__pos"], "left_semi").select(*curve.columns)


def endpoints(df: DataFrame, order: str, head: int = 100, tail: int = 100, key: str = "symbol") -> DataFrame:
    """The first and the last rows of each instrument."""
    up, down = W.Window.partitionBy(key).orderBy(order), W.Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumns({"__u": F.row_number().over(up), "__d": F.row_number().over(down)}).where((F.col("__u") <= head) | (F.col("__d") <= tail)).drop("__u", "__d")
