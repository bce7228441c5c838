"""What a source must keep to, as counts of violations per instrument; studies' trims, panel joins and scaled designs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.operators.validation import finite

# Most rows of one answer, statement and valuation metrics, and period types.
MOST_PRICES, MOST_OUTCOMES, MOST_FACTS = 4096, 8192, 256
STATEMENT_METRICS = ("revenue", "net_income", "earnings", "operating_income", "shareholders_equity", "total_equity", "free_cash_flow", "total_debt", "ebitda", "gross_profit")
VALUATION_METRICS = ("market_cap", "enterprise_value")
PERIOD_TYPES = ("annual", "quarterly", "ttm")


def _count(bad: Column) -> Column:
    return F.count_if(F.coalesce(bad, F.lit(False)))


def auditable(reference: Column) -> Column:
    """A reference is a sha256 digest in lowercase hex."""
    return F.coalesce(reference.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def price_violations(prices: DataFrame, key: str = "symbol") -> DataFrame:
    """Per instrument: rows, rows with a number that isn't finite, without a time, or without an auditable reference, and
    whether there are more rows than one answer may have. Null numbers are no violation."""
    numbers = ("open", "high", "low", "close", "volume")
    infinite = F.lit(False)
    for c in numbers:
        infinite = infinite | F.coalesce(~finite(F.col(c)), F.lit(False))
    return prices.groupBy(key).agg(
        F.count("*").alias("rows"), _count(infinite).alias("not_finite"), _count(F.col("day").isNull()).alias("no_time"), _count(~auditable(F.col("reference"))).alias("no_reference"), (F.count("*") > MOST_PRICES).alias("too_many")
    )


def outcome_violations(points: DataFrame, key: str = "symbol", at: str = "day") -> DataFrame:
    """Per series: points, points whose time occurs again, points with only one of high and low, and points whose range
    doesn't fit the series' basis (a range with ``observed_value``, none with ``high_low``, or an unknown basis)."""
    high, low = F.col("high").isNotNull(), F.col("low").isNotNull()
    fits = F.when(F.col("basis") == "high_low", high & low).when(F.col("basis") == "observed_value", ~(high & low)).otherwise(False)
    per_time = points.groupBy(key, at).agg(F.count("*").alias("n"), _count(high != low).alias("half"), _count(~fits).alias("unfit"))
    return per_time.groupBy(key).agg(
        F.sum("n").alias("points"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.sum("half").alias("half_ranges"), F.sum("unfit").alias("basis_mismatch"), (F.sum("n") > MOST_OUTCOMES).alias("too_many")
    )


def fundamental_violations(facts: DataFrame, key: str = "symbol") -> DataFrame:
    """Per instrument the facts that break a rule: unknown metric, number, currency, period (role, type or an end that is
    missing or after the observation; statements only), valuation time (missing or after the observation; valuations only)."""
    statement, valuation = F.col("metric").isin(*STATEMENT_METRICS), F.col("metric").isin(*VALUATION_METRICS)
    sure = lambda c: F.coalesce(c, F.lit(False))
    period = sure(F.col("period_role").isin("current", "prior")) & sure(F.col("period_type").isin(*PERIOD_TYPES)) & sure(F.col("period_end") <= F.to_date("observed_at"))
    return facts.groupBy(key).agg(
        F.count("*").alias("rows"),
        _count(~sure(statement | valuation)).alias("unknown_metric"),
        _count(~sure(finite(F.col("value")))).alias("not_finite"),
        _count(~sure(F.col("currency").rlike("^[A-Z]{3}$"))).alias("bad_currency"),
        _count(statement & ~period).alias("bad_period"),
        _count(valuation & ~sure(F.col("valuation_as_of") <= F.col("observed_at"))).alias("bad_valuation_time"),
        (F.count("*") > MOST_FACTS).alias("too_many"),
    )


def evaluation_trimmed(points: DataFrame, events: DataFrame, end: Column, at: str = "at") -> tuple[DataFrame, DataFrame]:
    """The points up to the end of the evaluation's data, and the events; an event after that end is an error."""
    late = F.when(F.col(at) > end, F.raise_error(F.concat(F.lit("event after the end of the data: "), F.col("symbol"))).cast(events.schema[at].dataType)).otherwise(F.col(at))
    return points.where(F.col(at) <= end), events.withColumn(at, late)


def panel_joined(returns: DataFrame, panel: DataFrame, sessions: DataFrame | None = None, excess: bool = True) -> DataFrame:
    """Returns on the days of a research panel, with its ``risk_free``; without one a day falls out of excess returns.

    ``panel`` has (date, start_date, risk_free). With the ``sessions`` (column day) of a daily study, a return must start
    where the panel's interval does, or where that isn't stated at the session before.
    """
    rows = panel.where("risk_free is not null") if excess else panel
    if sessions is not None:
        before = sessions.select(F.col("day").alias("date"), F.lag("day").over(W.Window.orderBy("day")).alias("__before"))  # one calendar
        rows = rows.join(before, "date", "left").withColumn("__start", F.coalesce("start_date", "__before"))
    found = returns.join(rows.withColumnRenamed("date", "end_date").drop(*([] if "start_date" not in rows.columns else ["start_date"])), "end_date")
    if sessions is not None:
        found = found.where(F.col("start_date") == F.col("__start")).drop("__start", "__before")
    return found.withColumn("excess", F.col("value") - F.col("risk_free")) if excess else found


def with_metadata(universe: DataFrame, members: DataFrame, key: str = "symbol") -> DataFrame:
    """Every instrument of the universe with its supplied metadata, or an empty row of it; ``supplied`` tells which."""
    return universe.join(members.withColumn("supplied", F.lit(True)), key, "left").withColumn("supplied", F.coalesce("supplied", F.lit(False)))


def inspected(stock: DataFrame, legs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Levels of the stock and of every factor leg between two days, as delivered: nulls kept, neither aligned nor converted."""
    rows = stock.withColumn("kind", F.lit("stock")).unionByName(legs.withColumn("kind", F.lit("leg")))
    return rows.where(F.col("day").between(start, end))


def standardized(study: DataFrame, factors: list[str]) -> tuple[DataFrame, np.ndarray]:
    """Factors scaled to mean 0 and sample deviation 1, and the matrix that takes coefficients back to original units.

    Two aggregate rows leave the executors. A factor without spread, or factors of deficient rank, are an error.
    """
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    row = study.agg(*[F.avg(f).alias(f"m_{f}") for f in factors], *[F.stddev_samp(f).alias(f"s_{f}") for f in factors]).first()
    mean, scale = (np.array([row[f"{p}_{f}"] or 0.0 for f in factors]) for p in "ms")
    if (scale <= 1e-14).any():
        raise ValueError("rank deficient: a factor has no spread")
    corr = np.eye(len(factors))
    found = study.agg(*[F.corr(a, b) for a, b in pairs]).first() if pairs else ()
    for (a, b), r in zip(pairs, found):
        corr[factors.index(a), factors.index(b)] = corr[factors.index(b), factors.index(a)] = r
    if np.linalg.matrix_rank(corr, tol=1e-10) < len(factors):
        raise ValueError("rank deficient")
    transform = np.zeros((len(factors) + 1, len(factors) + 1))
    transform[0] = np.concatenate(([1.0], -mean / scale))
    transform[range(1, len(factors) + 1), range(1, len(factors) + 1)] = 1 / scale
    return study.withColumns({f: (F.col(f) - float(m)) / float(s) for f, m, s in zip(factors, mean, scale)}), transform


def attribution_order(order: list[str]) -> list[tuple[str, list[str]]]:
    """Each factor but the first with all before it: what it is made independent of, in turn."""
    return [(name, order[:i]) for i, name in enumerate(order) if i]
