"""Fundamental ratios from long facts, and filing counts and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def latest_facts(facts: DataFrame, aliases: dict[str, list[str]], key: str = "symbol") -> DataFrame:
    """Per instrument, role and wanted metric the first alias that has a finite value, its newest one."""
    rank = F.create_map(*[F.lit(x) for name, names in aliases.items() for i, n in enumerate(names) for x in (n, f"{name}:{i}")])
    rows = facts.withColumn("__a", rank[F.col("metric")]).where(F.col("__a").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    rows = rows.withColumn("name", F.split("__a", ":")[0]).withColumn("__p", F.split("__a", ":")[1].cast("int"))
    w = W.Window.partitionBy(key, "period_role", "name").orderBy("__p", F.col("period_end").desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, "period_role", "name", "value", "period_end", "currency")


# Each ratio's kind, numerator and denominator.
RATIOS = (
    ("revenue_growth", "growth", "revenue", "revenue"),
    ("earnings_growth", "growth", "net_income", "net_income"),
    ("operating_margin", "statement", "operating_income", "revenue"),
    ("net_margin", "statement", "net_income", "revenue"),
    ("return_on_equity", "statement", "net_income", "equity"),
    ("free_cash_flow_margin", "statement", "free_cash_flow", "revenue"),
    ("leverage", "statement", "total_debt", "equity"),
    ("price_to_earnings", "valuation", "market_cap", "net_income"),
    ("enterprise_value_to_ebitda", "valuation", "enterprise_value", "ebitda"),
    ("free_cash_flow_yield", "yield", "free_cash_flow", "market_cap"),
)
#: What two facts of one statement have in common.
STATEMENT = ("snapshot_ref", "period_end", "period_type", "period_ref", "currency")


def _sides(facts: DataFrame, kinds: tuple[str, ...], key: str) -> tuple[DataFrame, DataFrame]:
    """The numerators' and the denominators' facts, with the ratio's name as ``ratio``; other columns of the latter as d_*."""
    asked = F.broadcast(facts.sparkSession.createDataFrame([r for r in RATIOS if r[1] in kinds], "ratio string, kind string, numerator string, denominator string"))  # ten rows
    top = facts.join(asked.select("ratio", "kind", F.col("numerator").alias("metric")), "metric")
    bottom = facts.join(asked.select("ratio", F.col("denominator").alias("metric")), "metric")
    return top, bottom.select(F.col(key).alias("d_key"), F.col("ratio").alias("d_ratio"), *[F.col(c).alias(f"d_{c}") for c in facts.columns if c != key])


def _quotients(facts: DataFrame, kinds: tuple[str, ...], fits: Column, key: str) -> DataFrame:
    top, bottom = _sides(facts, kinds, key)
    both = top.join(bottom, (F.col(key) == F.col("d_key")) & (F.col("ratio") == F.col("d_ratio")) & fits)
    value = F.when(F.col("kind") == "growth", F.try_divide(F.col("value") - F.col("d_value"), F.col("d_value"))).otherwise(F.try_divide("value", "d_value"))
    return both.select(key, F.col("ratio").alias("metric"), value.alias("value")).where("value is not null")


def statement_ratios(facts: DataFrame, key: str = "symbol") -> DataFrame:
    """Ratios of two current facts of one statement: equal snapshot, period end, type, reference and currency."""
    same = [F.col(c) == F.col(f"d_{c}") for c in STATEMENT]
    fits = (F.col("period_role") == "current") & (F.col("d_period_role") == "current")
    for s in same:
        fits = fits & s
    return _quotients(facts, ("statement",), fits, key)


def growths(facts: DataFrame, key: str = "symbol") -> DataFrame:
    """Growth from a prior fact to a current one that names its period as the prior: equal snapshot, type and currency, and
    a later end."""
    fits = (F.col("period_role") == "current") & (F.col("d_period_role") == "prior") & (F.col("prior_period_ref") == F.col("d_period_ref")) & (F.col("period_end") > F.col("d_period_end"))
    for c in ("snapshot_ref", "period_type", "currency"):
        fits = fits & (F.col(c) == F.col(f"d_{c}"))
    return _quotients(facts, ("growth",), fits, key)


def valuations(facts: DataFrame, key: str = "symbol") -> DataFrame:
    """Market values against current statement facts of their snapshot and currency that ended by the valuation, which is
    no later than the market value's observation; a yield has the market value below."""

    def fits(market: str, statement: str) -> Column:
        m, s = (lambda c: F.col(market + c)), (lambda c: F.col(statement + c))
        return (s("period_role") == "current") & (m("snapshot_ref") == s("snapshot_ref")) & (m("currency") == s("currency")) & (s("period_end") <= m("valuation_as_of")) & (m("valuation_as_of") <= m("observed_at"))

    return _quotients(facts, ("valuation",), fits("", "d_"), key).unionByName(_quotients(facts, ("yield",), fits("d_", ""), key))


def newest(facts: DataFrame, key: str = "symbol") -> DataFrame:
    """The last observed fact of each metric and role; of those, the one of the latest period."""
    w = W.Window.partitionBy(key, "metric", "period_role").orderBy(F.col("observed_at").desc_nulls_last(), F.col("period_end").desc_nulls_last(), F.col("snapshot_ref").desc_nulls_last())
    return facts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def ratios(facts: DataFrame, key: str = "symbol") -> DataFrame:
    """Long (symbol, metric, value) of all ratios whose facts may be compared, and the free cash flow itself.

    ``facts`` has (symbol, metric, value, period_role, period_end, period_type, period_ref, prior_period_ref, snapshot_ref,
    currency, valuation_as_of, observed_at). A pair that doesn't match, a null in what must match, or a zero denominator
    leaves that ratio out and the others in.
    """
    rows = newest(facts, key)
    cash = rows.where("metric = 'free_cash_flow' and period_role = 'current'").select(key, "metric", "value")
    return statement_ratios(rows, key).unionByName(growths(rows, key)).unionByName(valuations(rows, key)).unionByName(cash)


def filing_summary(filings: DataFrame, as_of: Column, key: str = "symbol") -> DataFrame:
    """Filings, event filings, and days since the latest annual and quarterly one, amendments included."""
    last = lambda form: F.max(F.when(F.col("form").isin(form, f"{form}/A"), F.col("filing_date")))
    return filings.groupBy(key).agg(
        F.count("*").alias("filings"), F.count_if(F.col("form").isin("8-K", "8-K/A")).alias("events"), F.datediff(as_of, last("10-K")).alias("days_since_annual"), F.datediff(as_of, last("10-Q")).alias("days_since_quarterly")
    )


def parsed_evidence(rows: DataFrame, content: str = "content") -> DataFrame:
    """Filing JSON as columns; malformed text, other types and bad dates are left out."""
    said = F.from_json(content, "form string, filing_date string, accession_number string, is_amendment boolean")
    out = rows.withColumn("e", said).select("*", "e.form", F.try_to_date("e.filing_date").alias("filing_date"), "e.accession_number", F.coalesce("e.is_amendment", F.col("e.form").contains("/A")).alias("is_amendment")).drop("e")
    return out.where("form is not null and filing_date is not null")


def annual_periods(facts: DataFrame, key: tuple[str, ...] = ("symbol", "concept")) -> DataFrame:
    """Current and prior annual fact of each concept: the newest fiscal year and filing, then the year before it."""
    rows = facts.where(F.col("fp").isin("FY", "Q4"))
    w = W.Window.partitionBy(*key).orderBy(F.col("fy").desc(), F.col("filed").desc(), F.col("accn").desc())
    current = rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    prior = rows.join(current.select(*key, "fp", (F.col("fy") - 1).alias("fy")), [*key, "fp", "fy"])
    prior = prior.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return current.withColumn("period_role", F.lit("current")).unionByName(prior.withColumn("period_role", F.lit("prior")))


def free_cash_flow(facts: DataFrame, key: str = "symbol") -> DataFrame:
    """Operating cash less capital spending of the same frame."""
    op = facts.where("concept = 'operating_cash_flow'").select(key, "frame", F.col("val").alias("op"))
    capex = facts.where("concept = 'capital_expenditure'").select(key, "frame", F.col("val").alias("capex"))
    return op.join(capex, [key, "frame"]).select(key, "frame", (F.col("op") - F.abs("capex")).alias("free_cash_flow"))
