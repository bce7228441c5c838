"""Row validity, duplicates, and contract checks of bars and return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

_OPTIONAL = ("open", "high", "low")


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_bar() -> Column:
    """A positive finite close; the other prices positive and finite and in order where present; no negative volume."""
    rules = [F.col("close").isNotNull() & finite(F.col("close")) & (F.col("close") > 0)]
    rules += [F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(True)) for c in _OPTIONAL]
    rules.append(F.coalesce(finite(F.col("volume")) & (F.col("volume") >= 0), F.lit(True)))
    order = ("high >= low", "high >= close", "low <= close", "low <= open", "open <= high")
    rules += [F.coalesce(F.expr(x), F.lit(True)) for x in order]
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return F.coalesce(out, F.lit(False))


def complete_bar() -> Column:
    return F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("volume").isNotNull()


def validated(bars: DataFrame, key: str = "symbol", order: str = "day") -> DataFrame:
    """Valid bars whose time occurs once among the instrument's valid ones; all copies of a repeated time go."""
    same = W.Window.partitionBy(key, order)
    return bars.where(valid_bar()).withColumn("__n", F.count("*").over(same)).where("__n = 1").drop("__n")


def bar_quality(bars: DataFrame, key: str = "symbol", order: str = "day") -> DataFrame:
    """Per instrument: rows, rows kept, whether any was discarded, whether any kept one lacks fields."""
    same = W.Window.partitionBy(key, order)
    valid = bars.withColumn("__ok", valid_bar())
    seen = valid.withColumn("__n", F.sum(F.col("__ok").cast("int")).over(same)).withColumn("__kept", F.col("__ok") & (F.col("__n") == 1))
    return seen.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.sum(F.col("__kept").cast("int")).alias("kept"),
        F.bool_or(~F.col("__kept")).alias("discarded"),
        F.coalesce(F.bool_or(F.col("__kept") & ~complete_bar()), F.lit(False)).alias("incomplete"),
    )


def instrument(symbol: str, market: str | None, symbol_col: str = "symbol", market_col: str = "market") -> Column:
    """Symbols are compared without case; a row without a market belongs to every market."""
    m = F.trim(F.col(market_col))
    same = F.upper(F.col(symbol_col)) == symbol.upper()
    return same if market is None else same & (m.isNull() | (m == "") | (F.upper(m) == market.upper()))


def tail(df: DataFrame, n: int, key: str = "symbol", order: str = "day") -> DataFrame:
    """The last ``n`` rows of each instrument."""
    w = W.Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def daily(df: DataFrame, key: str = "symbol", order: str = "day") -> DataFrame:
    """Per instrument the median gap in days, and whether it lies between 20 hours and 4 days."""
    w = W.Window.partitionBy(key).orderBy(order)
    seconds = F.unix_timestamp(F.col(order).cast("timestamp")) - F.unix_timestamp(F.lag(order).over(w).cast("timestamp"))
    gaps = df.select(key, (seconds / 86400.0).alias("gap"))
    return gaps.groupBy(key).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap")).withColumn("is_daily", F.col("median_gap").between(20 / 24, 4))


def return_violations(returns: DataFrame, key: str = "symbol") -> DataFrame:
    """Per series the rows that are empty or reversed, below -1, or overlap the one before."""
    w = W.Window.partitionBy(key).orderBy("start_date", "end_date")
    rows = returns.withColumn("__before", F.lag("end_date").over(w))
    bad = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return rows.groupBy(key).agg(
        bad(F.col("start_date") >= F.col("end_date")).alias("reversed"), bad(F.col("value") < -1).alias("below_minus_one"), bad(F.col("__before") > F.col("start_date")).alias("overlapping")
    )


def outcomes_of(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Bars as outcome points entered at the close; high and low if all of an instrument's bars have both. Some bars with
    both and some without are an error, as is a bar with only one of them."""
    w = W.Window.partitionBy(key)
    whole = F.col("high").isNotNull() & F.col("low").isNotNull()
    all_, any_ = F.min(whole.cast("int")).over(w) == 1, F.max((F.col("high").isNotNull() | F.col("low").isNotNull()).cast("int")).over(w) == 1
    both = F.when(any_ & ~all_, F.raise_error(F.concat(F.lit("mixed high and low coverage: "), F.col(key))).cast("boolean")).otherwise(all_)
    return bars.select(key, "day", F.col("close").alias("value"), F.when(both, F.col("high")).alias("high"), F.when(both, F.col("low")).alias("low"), F.when(both, "high_low").otherwise("observed_value").alias("basis"))
