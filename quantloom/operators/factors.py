"""Factor regression on aligned interval returns: Gram matrices and lagged products by aggregates, small solves apart.

Sums of products grow with the square of the factors and not with the rows, so a study of any length reaches a solver
as one small row. Serially correlated products of residuals are window aggregates over the ordered rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.functions import special

def _order() -> W.WindowSpec:
    """One study's rows in time order; a study is one series, so its window is one partition."""
    return W.Window.orderBy("end_date")


def wide(returns: DataFrame, target: str, factors: list[str], key: str = "symbol") -> DataFrame:
    """(start_date, end_date, y, x1..xk) of the intervals that the target and all factors have."""
    names = [target, *factors]
    rows = returns.where(F.col(key).isin(names)).groupBy("start_date", "end_date").agg(*[F.max(F.when(F.col(key) == n, F.col("value"))).alias("y" if i == 0 else f"x{i}") for i, n in enumerate(names)])
    return rows.dropna()


def coverage(returns: DataFrame, names: list[str], key: str = "symbol") -> DataFrame:
    """Per series: intervals available, intervals expected by all, and those that alignment loses."""
    rows = returns.where(F.col(key).isin(names))
    expected = rows.select("start_date", "end_date").distinct().agg(F.count("*").alias("expected"))
    common = rows.groupBy("start_date", "end_date").agg(F.count_distinct(key).alias("k")).where(F.col("k") == len(names)).agg(F.count("*").alias("common"))
    one = rows.groupBy(key).agg(F.count("*").alias("available"))
    return one.join(F.broadcast(expected)).join(F.broadcast(common)).select(key, "available", "expected", (F.col("available") - F.col("common")).alias("alignment_loss"))  # one-row sides


def univariate(study: DataFrame, k: int) -> DataFrame:
    """(factor, n, beta, alpha, r2, pearson) of each factor alone."""
    parts = [study.agg(F.lit(f"x{i}").alias("factor"), F.count("*").alias("n"), F.regr_slope("y", f"x{i}").alias("beta"), F.regr_intercept("y", f"x{i}").alias("alpha"), F.regr_r2("y", f"x{i}").alias("r2"), pearson(F.col("y"), F.col(f"x{i}")).alias("pearson")) for i in range(1, k + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def pearson(a: Column, b: Column) -> Column:
    """Null if either side is constant; within [-1, 1]."""
    flat = (F.stddev_pop(a) <= 1e-14) | (F.stddev_pop(b) <= 1e-14)
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(a, b))))


def average_rank(column: str, *by: str) -> Column:
    """Ranks from 1, equal values sharing the mean of theirs."""
    value = F.col(column) + F.lit(0.0)  # the two zeros are one value
    return F.rank().over(W.Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.Window.partitionBy(*by, value)) - 1) / 2


def spearman(study: DataFrame, a: str, b: str) -> DataFrame:
    return study.select(average_rank(a).alias("ra"), average_rank(b).alias("rb")).agg(pearson(F.col("ra"), F.col("rb")).alias("spearman"))


def rolling_beta(study: DataFrame, window: int = 252) -> DataFrame:
    """Beta and correlation of the first factor over trailing rows, at the last row of each month."""
    w = _order().rowsBetween(1 - window, 0)
    rows = study.select("end_date", F.row_number().over(_order()).alias("n"), F.regr_slope("y", "x1").over(w).alias("beta"), F.corr("y", "x1").over(w).alias("pearson"))
    last = rows.withColumn("final", F.max("end_date").over(W.Window.partitionBy(F.last_day("end_date"))))
    return last.where((F.col("n") >= window) & (F.col("end_date") == F.col("final"))).select("end_date", "beta", "pearson")


def _month_ends(rows: DataFrame, window: int) -> DataFrame:
    """The last row of each month that has ``window`` rows up to it (column n)."""
    last = rows.withColumn("final", F.max("end_date").over(W.Window.partitionBy(F.last_day("end_date"))))
    return last.where((F.col("n") >= window) & (F.col("end_date") == F.col("final"))).drop("final")


def rolling_fit(study: DataFrame, factors: list[str], window: int = 252) -> DataFrame:
    """(end_date, term, estimate, r2): the whole model refitted on trailing rows at the last row of each month, the
    intercept included; windows that are rank deficient or have a constant target are skipped."""
    k = len(factors)
    w = _order().rowsBetween(1 - window, 0)
    names = ["1", *[f"x{i}" for i in range(1, k + 1)], "y"]
    col = lambda n: F.lit(1.0) if n == "1" else F.col(n)
    sums = [F.sum(col(a) * col(b)).over(w).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    rows = study.select("end_date", F.row_number().over(_order()).alias("n"), *sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = _matrix(row, k)
                xx, xy, n = m[:-1, :-1], m[:-1, -1], m[0, 0]
                scale = np.sqrt(np.diag(xx))
                syy = m[-1, -1] - m[0, -1] ** 2 / n
                if (scale <= 1e-14).any() or np.linalg.cond(xx / np.outer(scale, scale)) > 1e14 or math.sqrt(max(0.0, syy) / n) <= 1e-14:
                    continue
                beta = np.linalg.solve(xx / np.outer(scale, scale), xy / scale) / scale
                r2 = 1 - (m[-1, -1] - float(beta @ xy)) / syy
                out += [(row["end_date"], t, float(b), float(r2)) for t, b in zip(["intercept", *factors], beta, strict=True)]
            yield pd.DataFrame(out, columns=["end_date", "term", "estimate", "r2"])

    return _month_ends(rows, window).mapInPandas(solve, "end_date date, term string, estimate double, r2 double")


def rolling_correlations(study: DataFrame, factors: list[str], window: int = 252) -> DataFrame:
    """(end_date, factor, pearson, spearman) of y with each factor over trailing rows, at the last row of each month;
    null if either side is constant."""
    w = _order().rowsBetween(1 - window, 0)
    names = ["y", *[f"x{i}" for i in range(1, len(factors) + 1)]]
    rows = study.select("end_date", F.row_number().over(_order()).alias("n"), *[F.collect_list(c).over(w).alias(c) for c in names])

    def one(a, b):
        return None if a.std(ddof=0) <= 1e-14 or b.std(ddof=0) <= 1e-14 else float(np.clip(np.corrcoef(a, b)[0, 1], -1, 1))

    def correlate(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                y = pd.Series(row["y"])
                for i, f in enumerate(factors, 1):
                    x = pd.Series(row[f"x{i}"])
                    out.append((row["end_date"], f, one(y, x), one(y.rank(), x.rank())))
            yield pd.DataFrame(out, columns=["end_date", "factor", "pearson", "spearman"])

    return _month_ends(rows, window).mapInPandas(correlate, "end_date date, factor string, pearson double, spearman double")


def stability(rolling: DataFrame, *by: str) -> DataFrame:
    """Spread of the windows' betas; without a window, n is 0 and the rest null."""
    return rolling.groupBy(*by).agg(F.count("*").alias("n"), F.min("beta").alias("minimum"), F.max("beta").alias("maximum"), F.percentile("beta", F.lit(0.5)).alias("median"), F.max_by("beta", "end_date").alias("latest"), F.stddev_samp("beta").alias("deviation"), F.try_divide(F.count_if(F.col("beta") > 0), F.count("*")).alias("positive_share"))


def gram(study: DataFrame, k: int) -> DataFrame:
    """One row: n and the sums of all products of (1, x1..xk, y)."""
    names = ["1", *[f"x{i}" for i in range(1, k + 1)], "y"]
    col = lambda n: F.lit(1.0) if n == "1" else F.col(n)
    return study.agg(*[F.sum(col(a) * col(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i])


def _matrix(row, k: int) -> np.ndarray:
    m = np.zeros((k + 2, k + 2))
    for i in range(k + 2):
        for j in range(i, k + 2):
            m[i, j] = m[j, i] = row[f"s{i}_{j}"]
    return m


def coefficients(study: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(estimates with the intercept first, inverse of X'X, rows), solved from one row of sums."""
    m = _matrix(gram(study, k).first(), k)
    xx, xy = m[:-1, :-1], m[:-1, -1]
    scale = np.sqrt(np.diag(xx))
    if (scale <= 1e-14).any() or np.linalg.cond(xx / np.outer(scale, scale)) > 1e14:
        raise ValueError("rank deficient")
    inverse = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    return inverse @ xy, inverse, int(m[0, 0])


def with_residuals(study: DataFrame, beta: np.ndarray) -> DataFrame:
    fitted = F.lit(float(beta[0]))
    for i, b in enumerate(beta[1:], 1):
        fitted = fitted + F.lit(float(b)) * F.col(f"x{i}")
    return study.withColumn("e", F.col("y") - fitted)


def regression(study: DataFrame, factors: list[str], lags: int = 5) -> DataFrame:
    """(term, estimate, standard_error, t, p_value, lower_95, upper_95, r2, adjusted_r2, vif): least squares with
    Bartlett-weighted errors, the small-sample factor n / (n - k - 1), and t quantiles.

    Two passes over the rows: sums of products, then lagged products of residuals; only these sums leave the executors.
    """
    k = len(factors)
    beta, inverse, n = coefficients(study, k)
    rows = with_residuals(study, beta)
    names = ["c", *[f"x{i}" for i in range(1, k + 1)]]
    rows = rows.withColumn("c", F.lit(1.0)).select("end_date", "e", "y", *[(F.col(c) * F.col("e")).alias(f"u{i}") for i, c in enumerate(names)])
    pairs = [(i, j) for i in range(k + 1) for j in range(k + 1)]
    lagged = rows.select("*", *[F.lag(f"u{j}", m).over(_order()).alias(f"l{j}_{m}") for j in range(k + 1) for m in range(1, lags + 1)])
    sums = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}_0") for i, j in pairs]
    sums += [F.coalesce(F.sum(F.col(f"u{i}") * F.col(f"l{j}_{m}")), F.lit(0.0)).alias(f"m{i}_{j}_{m}") for i, j in pairs for m in range(1, lags + 1)]
    got = lagged.agg(F.sum(F.col("e") ** 2).alias("sse"), F.var_pop("y").alias("vy"), *sums).first()
    meat = np.array([[got[f"m{i}_{j}_0"] for j in range(k + 1)] for i in range(k + 1)])
    for m in range(1, lags + 1):
        g = np.array([[got[f"m{i}_{j}_{m}"] for j in range(k + 1)] for i in range(k + 1)])
        meat += (1 - m / (lags + 1)) * (g + g.T)
    covariance = inverse @ meat @ inverse * n / (n - k - 1)
    error = np.sqrt(np.diag(covariance))
    r2 = 1 - got["sse"] / (got["vy"] * n)
    df = n - k - 1
    t975 = special.t_quantile(0.975, df)
    vif = [None, *_vifs(study, k)]
    out = []
    for i, term in enumerate(["intercept", *factors]):
        t = beta[i] / error[i] if error[i] else None
        out.append((term, float(beta[i]), float(error[i]), None if t is None else float(t), None if t is None else float(special.t_two_sided(float(t), df)), float(beta[i] - t975 * error[i]), float(beta[i] + t975 * error[i]), float(r2), float(1 - (1 - r2) * (n - 1) / df), vif[i]))
    return study.sparkSession.createDataFrame(out, "term string, estimate double, standard_error double, t double, p_value double, lower_95 double, upper_95 double, r2 double, adjusted_r2 double, vif double")


def _vifs(study: DataFrame, k: int) -> list[float]:
    pairs = [(i, j) for i in range(1, k + 1) for j in range(i + 1, k + 1)]
    got = study.agg(F.lit(1).alias("one"), *[F.corr(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    c = np.eye(k)
    for i, j in pairs:
        c[i - 1, j - 1] = c[j - 1, i - 1] = got[f"c{i}_{j}"]
    return np.diag(np.linalg.inv(c)).tolist()


def residualised(study: DataFrame, target: int, controls: list[int]) -> DataFrame:
    """``study`` with x<target> replaced by its residual against the original control columns."""
    sub = study.select("start_date", "end_date", F.col(f"x{target}").alias("y"), *[F.col(f"x{c}").alias(f"x{i}") for i, c in enumerate(controls, 1)])
    beta, _, _ = coefficients(sub, len(controls))
    fitted = F.lit(float(beta[0]))
    for b, c in zip(beta[1:], controls, strict=True):
        fitted = fitted + F.lit(float(b)) * F.col(f"x{c}")
    return study.withColumn(f"x{target}", F.col(f"x{target}") - fitted)


def compare_models(study: DataFrame, factors: list[str], subsets: list[list[str]]) -> DataFrame:
    """(model, r2, adjusted_r2) of the full model and of subsets on the same rows, all solved from one Gram matrix."""
    k = len(factors)
    m = _matrix(gram(study, k).first(), k)
    n, sy, syy = m[0, 0], m[0, -1], m[-1, -1]
    out = []
    for names in [factors, *subsets]:
        at = [0, *[factors.index(f) + 1 for f in names]]
        xy = m[at, -1]
        sse = syy - float(xy @ np.linalg.solve(m[np.ix_(at, at)], xy))
        r2 = 1 - sse / (syy - sy * sy / n)
        out.append(("+".join(names), float(r2), float(1 - (1 - r2) * (n - 1) / (n - len(at)))))
    return study.sparkSession.createDataFrame(out, "model string, r2 double, adjusted_r2 double")


def relationships(study: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, partial_correlation, incremental_r2) of each factor given the others, from one Gram matrix."""
    k = len(factors)
    m = _matrix(gram(study, k).first(), k)
    n = m[0, 0]
    centred = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n
    p = np.linalg.inv(centred)
    full = 1 - 1 / (p[-1, -1] * centred[-1, -1])
    out = []
    for i, f in enumerate(factors):
        partial = -p[i, -1] / math.sqrt(p[i, i] * p[-1, -1])
        rest = [j for j in range(k + 1) if j != i]
        q = np.linalg.inv(centred[np.ix_(rest, rest)])
        out.append((f, float(partial), float(min(1, max(0, full - (1 - 1 / (q[-1, -1] * centred[-1, -1])))))))
    return study.sparkSession.createDataFrame(out, "factor string, partial_correlation double, incremental_r2 double")


def residual_diagnostics(rows: DataFrame, lags: int = 5) -> DataFrame:
    """Durbin-Watson, Ljung-Box and Jarque-Bera of the residual column e, with chi-squared probabilities."""
    lagged = rows.select("end_date", "e", *[F.lag("e", m).over(_order()).alias(f"e{m}") for m in range(1, lags + 1)])
    got = lagged.agg(F.count("*").alias("n"), F.sum(F.col("e") ** 2).alias("ss"), F.sum((F.col("e") - F.col("e1")) ** 2).alias("d"), F.skewness("e").alias("skew"), (F.kurtosis("e") + 3).alias("kurt"), F.avg("e").alias("mean"), *[F.sum(F.col("e") * F.col(f"e{m}")).alias(f"a{m}") for m in range(1, lags + 1)])
    n = F.col("n")
    lb = n * (n + 2) * sum(((F.col(f"a{m}") / F.col("ss")) ** 2 / (n - m) for m in range(1, lags + 1)), F.lit(0.0))
    jb = n / 6 * (F.col("skew") ** 2 + (F.col("kurt") - 3) ** 2 / 4)
    out = got.select("n", (F.col("d") / F.col("ss")).alias("durbin_watson"), lb.alias("ljung_box"), jb.alias("jarque_bera"), F.col("skew").alias("residual_skew"), F.col("kurt").alias("residual_kurtosis"))

    def add(batches):
        for pdf in batches:
            yield pdf.assign(ljung_box_p=[special.chi2_tail(x, lags) for x in pdf.ljung_box], jarque_bera_p=[special.chi2_tail(x, 2) for x in pdf.jarque_bera])

    return out.mapInPandas(add, "n bigint, durbin_watson double, ljung_box double, jarque_bera double, residual_skew double, residual_kurtosis double, ljung_box_p double, jarque_bera_p double")


def monitor(study: DataFrame) -> DataFrame:
    """The last interval's move against what the first factor explains, fitted on all before it."""
    last = study.withColumn("final", F.max("end_date").over(W.Window.partitionBy()))
    fit = last.where("end_date < final").agg(F.regr_slope("y", "x1").alias("beta"), F.regr_intercept("y", "x1").alias("alpha"))
    now = last.where("end_date = final").select("end_date", "y", "x1")
    return now.join(F.broadcast(fit)).select("end_date", F.col("y").alias("move"), (F.col("beta") * F.col("x1")).alias("explained"), (F.col("y") - F.col("beta") * F.col("x1")).alias("unexplained"))  # one-row side


def monitor_fit(study: DataFrame, factors: list[str]) -> DataFrame:
    """(end_date, move, term, beta, contribution, explained, unexplained) of the last interval: the whole model fitted
    on all intervals before it, explained by the intercept and every factor's move."""
    final = study.agg(F.max("end_date")).first()[0]
    beta, _, _ = coefficients(study.where(F.col("end_date") < final), len(factors))
    now = study.where(F.col("end_date") == final)
    terms = [F.struct(F.lit(t).alias("term"), F.lit(float(b)).alias("beta"), (F.lit(float(b)) * (F.lit(1.0) if i == 0 else F.col(f"x{i}"))).alias("contribution")) for i, (t, b) in enumerate(zip(["intercept", *factors], beta, strict=True))]
    explained = sum((t["contribution"] for t in terms), F.lit(0.0))
    rows = now.select("end_date", F.col("y").alias("move"), F.explode(F.array(*terms)).alias("t"), explained.alias("explained"))
    return rows.select("end_date", "move", "t.term", "t.beta", "t.contribution", "explained", (F.col("move") - F.col("explained")).alias("unexplained"))


def level_pack(levels: DataFrame, legs: dict[str, tuple[float, float]], transform: str, key: str = "symbol", day: str = "day", value: str = "close") -> DataFrame:
    """(start_date, end_date, value): the weighted sum of scaled legs on their common dates, then its difference, simple
    or log return between adjacent common dates; a level of 0 or less has no return."""
    rows = levels.where(F.col(key).isin(list(legs)))
    parts = rows.groupBy(day).agg(F.count_distinct(key).alias("k"), *[F.max(F.when(F.col(key) == n, F.col(value) * s * w)).alias(f"p{i}") for i, (n, (s, w)) in enumerate(legs.items())])
    total = sum((F.col(f"p{i}") for i in range(1, len(legs))), F.col("p0"))
    w = W.Window.orderBy(day)
    level = parts.where(F.col("k") == len(legs)).select(day, total.alias("v"))
    before = F.lag("v").over(w)
    out = level.select(F.lag(day).over(w).alias("start_date"), F.col(day).alias("end_date"), "v", before.alias("b"))
    move = {"difference": F.col("v") - F.col("b"), "simple": F.when((F.col("b") > 0) & (F.col("v") > 0), F.col("v") / F.col("b") - 1), "log": F.when((F.col("b") > 0) & (F.col("v") > 0), F.ln(F.col("v") / F.col("b")))}[transform]
    return out.where("start_date is not null").select("start_date", "end_date", move.alias("value")).where("value is not null")


#: Factor presets: name, asset or pair of assets whose difference is the factor.
# The presets' factors as (factor, kind, long leg, short leg).
PRESETS = {
    "us_etf": (
        ("market", "asset_return", "IWB", None),
        ("growth_minus_value", "spread", "IWF", "IWD"),
        ("momentum_minus_market", "spread", "MTUM", "IWB"),
    ),
    "msci_europe": (
        ("market", "asset_return", "MSCI-EU-GTR-EUR", None),
        ("growth_minus_value", "spread", "MSCI-EU-GRW-GTR", "MSCI-EU-VAL-GTR"),
        ("momentum_minus_market", "spread", "MSCI-EU-MOM-GTR", "MSCI-EU-GTR-EUR"),
    ),
    "french": (
        ("market_excess", "research", None, None),
        ("smb", "research", None, None),
        ("hml", "research", None, None),
        ("rmw", "research", None, None),
        ("cma", "research", None, None),
        ("momentum", "research", None, None),
    ),
}


def preset(prices: DataFrame, name: str, key: str = "symbol", day: str = "day") -> DataFrame:
    """Long (start_date, end_date, factor, value) of a preset: the legs' returns between their common days, a spread being
    the long leg's less the short one's. An unknown name is an error; a factor without its legs gives no rows."""
    legs = [(f, leg, 1.0 if i == 0 else -1.0, 2 if short else 1) for f, _, long, short in PRESETS[name] for i, leg in enumerate((long, short)) if leg]
    asked = prices.sparkSession.createDataFrame(legs, "factor string, leg string, sign double, legs int")
    rows = prices.join(F.broadcast(asked), F.col(key) == F.col("leg"))  # a preset has at most a few legs
    both = rows.groupBy("factor", day).agg(F.count("*").alias("n"), F.max("legs").alias("legs"), F.sort_array(F.collect_list(F.struct("sign", "close"))).alias("z"))
    both = both.where("n = legs").select("factor", day, F.element_at("z", -1)["close"].alias("long"), F.when(F.col("legs") == 2, F.element_at("z", 1)["close"]).alias("short"))
    w = W.Window.partitionBy("factor").orderBy(day)
    move = lambda c: F.col(c) / F.lag(c).over(w) - 1
    out = both.select("factor", F.lag(day).over(w).alias("start_date"), F.col(day).alias("end_date"), (move("long") - F.coalesce(move("short"), F.lit(0.0))).alias("value"))
    return out.where("start_date is not null")


# ---- cross-sections -----------------------------------------------------------------------------------------------


def formations(months: DataFrame, prices: DataFrame, key: str = "symbol") -> DataFrame:
    """(symbol, formation, score, forward): the product of the months t-12 to t-2, and the return from the first
    session after the formation to the first after the next month's end; rows without either are left out."""
    w = W.Window.partitionBy(key).orderBy("month")
    span = w.rowsBetween(-12, -2)
    at = F.year("month") * 12 + F.month("month")
    rows = months.select(key, "month", "value", at.alias("m"))
    whole = (F.count("value").over(span) == 11) & (F.max("m").over(span) == F.col("m") - 2) & (F.min("m").over(span) == F.col("m") - 12)
    scored = rows.select(key, F.col("month").alias("formation"), F.when(whole, F.product(1 + F.col("value")).over(span) - 1).alias("score")).where("score is not null")
    entry = prices.groupBy(key, F.last_day("day").alias("of")).agg(F.min_by("close", "day").alias("first_close"))
    a = entry.select(key, F.last_day(F.add_months("of", -1)).alias("formation"), F.col("first_close").alias("entry"))
    b = entry.select(key, F.last_day(F.add_months("of", -2)).alias("formation"), F.col("first_close").alias("exit"))
    both = scored.join(a, [key, "formation"]).join(b, [key, "formation"])
    return both.select(key, "formation", F.round("score", 10).alias("score"), F.round(F.col("exit") / F.col("entry") - 1, 10).alias("forward"))


def buckets(rows: DataFrame, quantiles: int = 5, group: str | None = None) -> DataFrame:
    """``rows`` with rank and bucket: the average rank's share of the quantiles, rounded up."""
    by = ("formation",) if group is None else ("formation", group)
    n = F.count("*").over(W.Window.partitionBy(*by))
    rank = average_rank("score", *by)
    return rows.withColumn("rank", rank).withColumn("bucket", F.least(F.lit(quantiles), F.ceil(F.round(F.col("rank") * quantiles / n, 10))).cast("int"))


def periods(rows: DataFrame, quantiles: int = 5, minimum: int = 5) -> DataFrame:
    """Per formation: assets, rank IC, top, bottom and universe returns; formations with too few assets, too few
    different scores, constant outcomes or an empty bucket are left out."""
    b = buckets(rows, quantiles).withColumn("out_rank", average_rank("forward", "formation"))
    good = b.groupBy("formation").agg(
        F.count("*").alias("assets"), F.count_distinct("score").alias("scores"), F.count_distinct("forward").alias("outcomes"), F.count_distinct("bucket").alias("filled"), F.corr("rank", "out_rank").alias("rank_ic"),
        F.avg(F.when(F.col("bucket") == quantiles, F.col("forward"))).alias("top_return"), F.avg(F.when(F.col("bucket") == 1, F.col("forward"))).alias("bottom_return"), F.avg("forward").alias("universe_return"),
    )
    ok = (F.col("assets") >= minimum) & (F.col("scores") >= quantiles) & (F.col("outcomes") >= 2) & (F.col("filled") == quantiles)
    return good.where(ok).select("formation", "assets", "rank_ic", (F.col("top_return") - F.col("bottom_return")).alias("top_minus_bottom"), "top_return", "bottom_return", "universe_return")


def study_summary(per: DataFrame) -> DataFrame:
    """Mean, deviation and information ratio of the IC, positive share, annualised top return and its drawdown."""
    w = W.Window.orderBy("formation").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = per.withColumn("wealth", F.product(1 + F.col("top_return")).over(w))
    rows = rows.withColumn("dd", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w)) - 1)
    return rows.agg(
        F.count("*").alias("periods"), F.avg("rank_ic").alias("mean_ic"), F.percentile("rank_ic", F.lit(0.5)).alias("median_ic"), F.stddev_samp("rank_ic").alias("ic_deviation"), F.try_divide(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("information_ratio"),
        (F.count_if(F.col("rank_ic") > 0) / F.count("*")).alias("positive_share"), F.avg("top_minus_bottom").alias("mean_spread"), (F.pow(F.product(1 + F.col("top_return")), F.lit(12.0) / F.count("*")) - 1).alias("annualised_top"), F.min("dd").alias("max_drawdown"),
    )


def ic_bootstrap(per: DataFrame, samples: int = 500, seed: int = 7, block: int = 3) -> DataFrame:
    """2.5 and 97.5 % of the mean IC of circular block resamples, within [-1, 1]; one row for each formation goes in."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ic = pdf.sort_values("formation").rank_ic.to_numpy(float)
        n, rng = len(ic), np.random.default_rng(seed)
        starts = rng.integers(0, n, size=(samples, -(-n // block)))
        means = ic[((starts[:, :, None] + np.arange(block)) % n).reshape(samples, -1)[:, :n]].mean(axis=1)
        low, high = np.clip(np.quantile(means, [0.025, 0.975]), -1, 1)
        return pd.DataFrame({"n": [n], "lower_95": [low], "upper_95": [high]})

    return per.select(F.lit(1).alias("g"), "formation", "rank_ic").groupBy("g").applyInPandas(run, "n bigint, lower_95 double, upper_95 double")
