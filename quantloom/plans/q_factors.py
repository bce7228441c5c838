"""Queries of factor studies and cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import alignment
from quantloom.operators import factors as fa
from quantloom.plans import panels as P
from quantloom.plans.q_risk import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_TARGET, _FACTORS = "ASIA", ["EUROPE", "AMERICA"]
_STUDY = P.RETURNS_SQL + """, st AS (SELECT start_date, end_date, max(value) FILTER (symbol = 'ASIA') AS y, max(value) FILTER (symbol = 'EUROPE') AS x1, max(value) FILTER (symbol = 'AMERICA') AS x2 FROM rets WHERE symbol IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY ALL HAVING count(*) = 3)"""


def _study(spark, sf_dir):
    return fa.wide(P.returns(spark, sf_dir), _TARGET, _FACTORS)


@query("fac01_study_rows", f"WITH {_STUDY} SELECT start_date, end_date, round(y, 6) AS y, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM st")
def _fac01(spark, sf_dir):
    return rounded(_study(spark, sf_dir))


QUERIES["fac14_study_preview"], SQL["fac14_study_preview"] = QUERIES["fac01_study_rows"], SQL["fac01_study_rows"]


@query("agg23_coverage", f"WITH {_STUDY}, r AS (SELECT * FROM rets WHERE symbol IN ('ASIA', 'EUROPE', 'AMERICA')) SELECT symbol, count(*) AS available, (SELECT count(*) FROM (SELECT DISTINCT start_date, end_date FROM r)) AS expected, count(*) - (SELECT count(*) FROM st) AS alignment_loss FROM r GROUP BY symbol")
def _agg23(spark, sf_dir):
    return fa.coverage(P.returns(spark, sf_dir), [_TARGET, *_FACTORS])


_UNI = "SELECT '{0}' AS factor, count(*) AS n, round(regr_slope(y, {0}), 6) AS beta, round(regr_intercept(y, {0}), 6) AS alpha, round(regr_r2(y, {0}), 6) AS r2, round(corr(y, {0}), 6) AS pearson FROM st"


@query("fac09_univariate", f"WITH {_STUDY} {_UNI.format('x1')} UNION ALL {_UNI.format('x2')}")
def _fac09(spark, sf_dir):
    return rounded(fa.univariate(_study(spark, sf_dir), 2))


QUERIES["agg09_pearson"], SQL["agg09_pearson"] = QUERIES["fac09_univariate"], SQL["fac09_univariate"]


@query("agg10_spearman", f"WITH {_STUDY}, rk AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS a, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2 AS b FROM (SELECT round(y, 8) AS y, round(x1, 8) AS x1 FROM st)) SELECT round(corr(a, b), 6) AS spearman FROM rk")
def _agg10(spark, sf_dir):
    return rounded(fa.spearman(_study(spark, sf_dir).select(F.round("y", 8).alias("y"), F.round("x1", 8).alias("x1")), "y", "x1"))


# Normal equations of two centred factors in closed form.
_TWO = _STUDY + """, c AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_samp(x1, x1) AS s11, covar_samp(x2, x2) AS s22, covar_samp(x1, x2) AS s12, covar_samp(x1, y) AS s1y, covar_samp(x2, y) AS s2y, covar_samp(y, y) AS syy FROM st), b AS (
  SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM c), f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * s1y + b2 * s2y) / syy AS r2 FROM b)"""


@query("fac03_least_squares", f"WITH {_TWO} SELECT 'intercept' AS term, round(b0, 6) AS estimate, round(r2, 6) AS r2 FROM f UNION ALL SELECT 'EUROPE', round(b1, 6), round(r2, 6) FROM f UNION ALL SELECT 'AMERICA', round(b2, 6), round(r2, 6) FROM f")
def _fac03(spark, sf_dir):
    return rounded(fa.regression(_study(spark, sf_dir), _FACTORS).select("term", "estimate", "r2"))


@query("fac03_hac_regression")
def _fac03b(spark, sf_dir):
    return rounded(fa.regression(_study(spark, sf_dir), _FACTORS))


QUERIES["skl14_factor_regression"] = QUERIES["fac03_hac_regression"]


@query("fac04_fit_statistics", f"WITH {_TWO} SELECT round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adjusted_r2 FROM f")
def _fac04(spark, sf_dir):
    return rounded(fa.regression(_study(spark, sf_dir), _FACTORS).select("r2", "adjusted_r2").limit(1))


@query("fac05_vif", f"WITH {_STUDY} SELECT factor, round(1 / (1 - (SELECT corr(x1, x2) ** 2 FROM st)), 6) AS vif FROM (VALUES ('EUROPE'), ('AMERICA')) t(factor)")
def _fac05(spark, sf_dir):
    return rounded(fa.regression(_study(spark, sf_dir), _FACTORS).where("vif is not null").select(F.col("term").alias("factor"), "vif"))


@query("fac06_residualised", f"WITH {_STUDY}, p AS (SELECT regr_slope(x2, x1) AS b, regr_intercept(x2, x1) AS a FROM st) SELECT end_date, round(x2 - a - b * x1, 6) AS x2 FROM st, p")
def _fac06(spark, sf_dir):
    return rounded(fa.residualised(_study(spark, sf_dir), 2, [1]).select("end_date", "x2"))


@query("fac08_model_comparison", f"WITH {_TWO} SELECT 'EUROPE+AMERICA' AS model, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adjusted_r2 FROM f UNION ALL SELECT 'EUROPE', round(s1y * s1y / s11 / syy, 6), round(1 - (1 - s1y * s1y / s11 / syy) * (n - 1) / (n - 2), 6) FROM f")
def _fac08(spark, sf_dir):
    return rounded(fa.compare_models(_study(spark, sf_dir), _FACTORS, [["EUROPE"]]))


@query("fac09_partial", f"""WITH {_STUDY}, r AS (SELECT corr(y, x1) AS a, corr(y, x2) AS b, corr(x1, x2) AS c FROM st), f AS (SELECT *, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM r)
SELECT 'EUROPE' AS factor, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial_correlation, round(r2 - b * b, 6) AS incremental_r2 FROM f UNION ALL SELECT 'AMERICA', round((b - a * c) / sqrt((1 - a * a) * (1 - c * c)), 6), round(r2 - a * a, 6) FROM f""")
def _fac09b(spark, sf_dir):
    return rounded(fa.relationships(_study(spark, sf_dir), _FACTORS))


_ROLL = _STUDY + """, ro AS (SELECT end_date, row_number() OVER (ORDER BY end_date) AS n, regr_slope(y, x1) OVER w AS beta, corr(y, x1) OVER w AS pearson FROM st WINDOW w AS (ORDER BY end_date ROWS 251 PRECEDING)), ml AS (SELECT * FROM (SELECT *, max(end_date) OVER (PARTITION BY last_day(end_date)) AS fin FROM ro) WHERE n >= 252 AND end_date = fin)"""


@query("fac10_rolling_beta", f"WITH {_ROLL} SELECT end_date, round(beta, 6) AS beta, round(pearson, 6) AS pearson FROM ml")
def _fac10(spark, sf_dir):
    return rounded(fa.rolling_beta(_study(spark, sf_dir)))


QUERIES["win34_rolling_correlation"], SQL["win34_rolling_correlation"] = QUERIES["fac10_rolling_beta"], SQL["fac10_rolling_beta"]


@query("agg25_stability", f"WITH {_ROLL} SELECT count(*) AS n, round(min(beta), 6) AS minimum, round(max(beta), 6) AS maximum, round(quantile_cont(beta, 0.5), 6) AS median, round(arg_max(beta, end_date), 6) AS latest, round(stddev_samp(beta), 6) AS deviation, round(count(*) FILTER (beta > 0) / count(*), 6) AS positive_share FROM ml")
def _agg25(spark, sf_dir):
    return rounded(fa.stability(fa.rolling_beta(_study(spark, sf_dir))))


@query("fac10_rolling_fit")
def _fac10b(spark, sf_dir):
    return rounded(fa.rolling_fit(_study(spark, sf_dir), _FACTORS))


@query("win34_factor_correlations")
def _win34(spark, sf_dir):
    s = _study(spark, sf_dir)
    return rounded(fa.rolling_correlations(s.select("end_date", *[F.round(c, 8).alias(c) for c in ("y", "x1", "x2")]), _FACTORS))


@query("agg25_factor_stability")
def _agg25b(spark, sf_dir):
    fits = fa.rolling_fit(_study(spark, sf_dir), _FACTORS).where("term <> 'intercept'")
    return rounded(fa.stability(fits.groupBy("term", "end_date").agg(F.max("estimate").alias("beta")), "term"))


@query("fac13_attribution")
def _fac13b(spark, sf_dir):
    return rounded(fa.monitor_fit(_study(spark, sf_dir), _FACTORS))


@query("fac11_level_pack", f"WITH {P.WALK_SQL}, lv AS (SELECT day, sum(CASE symbol WHEN 'ASIA' THEN close * 0.5 WHEN 'EUROPE' THEN -close * 0.1 END) AS v FROM walk WHERE symbol IN ('ASIA', 'EUROPE') GROUP BY day HAVING count(*) = 2) SELECT * FROM (SELECT lag(day) OVER (ORDER BY day) AS start_date, day AS end_date, round(v - lag(v) OVER (ORDER BY day), 6) AS value FROM lv) WHERE start_date IS NOT NULL")
def _fac11(spark, sf_dir):
    return rounded(fa.level_pack(P.walk(spark, sf_dir), {"ASIA": (0.5, 1.0), "EUROPE": (0.1, -1.0)}, "difference"))


QUERIES["src18_pack_panel"], SQL["src18_pack_panel"] = QUERIES["fac11_level_pack"], SQL["fac11_level_pack"]


@query("fac12_residual_diagnostics")
def _fac12(spark, sf_dir):
    s = _study(spark, sf_dir)
    return rounded(fa.residual_diagnostics(fa.with_residuals(s, fa.coefficients(s, 2)[0])))


@query("fac12_durbin_watson", f"WITH {_TWO}, e AS (SELECT end_date, y - b0 - b1 * x1 - b2 * x2 AS e FROM st, (SELECT b0, b1, b2 FROM f)), d AS (SELECT e, lag(e) OVER (ORDER BY end_date) AS p FROM e) SELECT round(sum((e - p) ** 2) / sum(e * e), 6) AS durbin_watson FROM d")
def _fac12b(spark, sf_dir):
    s = _study(spark, sf_dir)
    return rounded(fa.residual_diagnostics(fa.with_residuals(s, fa.coefficients(s, 2)[0])).select("durbin_watson"))


@query("fac13_monitor", f"WITH {_STUDY}, z AS (SELECT *, max(end_date) OVER () AS fin FROM st), p AS (SELECT regr_slope(y, x1) AS b FROM z WHERE end_date < fin) SELECT end_date, round(y, 6) AS move, round(b * x1, 6) AS explained, round(y - b * x1, 6) AS unexplained FROM z, p WHERE end_date = fin")
def _fac13(spark, sf_dir):
    return rounded(fa.monitor(_study(spark, sf_dir)))


@query("fac16_presets", f"""WITH {P.WALK_SQL}, named AS (
  SELECT CASE symbol WHEN 'AFRICA' THEN 'IWB' WHEN 'AMERICA' THEN 'IWF' WHEN 'ASIA' THEN 'IWD' ELSE 'MTUM' END AS leg, day, close FROM walk WHERE symbol <> 'MIDDLE EAST'
), f AS (
  SELECT 'market' AS factor, day, close AS a, NULL::DOUBLE AS b FROM named WHERE leg = 'IWB'
  UNION ALL SELECT 'growth_minus_value', x.day, x.close, y.close FROM named x JOIN named y USING (day) WHERE x.leg = 'IWF' AND y.leg = 'IWD'
  UNION ALL SELECT 'momentum_minus_market', x.day, x.close, y.close FROM named x JOIN named y USING (day) WHERE x.leg = 'MTUM' AND y.leg = 'IWB'
), r AS (
  SELECT factor, lag(day) OVER w AS start_date, day AS end_date, a / lag(a) OVER w - 1 - coalesce(b / lag(b) OVER w - 1, 0) AS value FROM f WINDOW w AS (PARTITION BY factor ORDER BY day)
) SELECT factor, start_date, end_date, round(value, 6) AS value FROM r WHERE start_date IS NOT NULL""")
def _fac16(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("AFRICA", "IWB", "AMERICA", "IWF", "ASIA", "IWD", "EUROPE", "MTUM")])
    walk = P.walk(spark, sf_dir).withColumn("symbol", names[F.col("symbol")]).where("symbol is not null")
    return rounded(fa.preset(walk, "us_etf"))


_XS = P.UNIVERSE_SQL + """, me AS (SELECT symbol, last_day(day) AS month, arg_max(close, day) AS c FROM universe GROUP BY ALL), mr AS (SELECT symbol, month, year(month) * 12 + month(month) AS m, round(c / lag(c) OVER (PARTITION BY symbol ORDER BY month) - 1, 10) AS value FROM me), mm AS (SELECT * FROM mr WHERE value IS NOT NULL), sc AS (
  SELECT symbol, month AS formation, CASE WHEN count(value) OVER s = 11 AND max(m) OVER s = m - 2 AND min(m) OVER s = m - 12 THEN product(1 + value) OVER s - 1 END AS score FROM mm WINDOW s AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)
), en AS (SELECT symbol, last_day(day) AS mo, arg_min(close, day) AS fc FROM universe GROUP BY ALL), xs AS (
  SELECT sc.symbol, formation, round(score, 10) AS score, round(b.fc / a.fc - 1, 10) AS forward FROM sc JOIN en a ON a.symbol = sc.symbol AND last_day((a.mo - INTERVAL 1 MONTH)::DATE) = formation JOIN en b ON b.symbol = sc.symbol AND last_day((b.mo - INTERVAL 2 MONTH)::DATE) = formation WHERE score IS NOT NULL
), bk AS (SELECT *, rank() OVER f + (count(*) OVER (PARTITION BY formation, score) - 1) / 2 AS rk, rank() OVER (PARTITION BY formation ORDER BY forward) + (count(*) OVER (PARTITION BY formation, forward) - 1) / 2 AS ork, count(*) OVER (PARTITION BY formation) AS n FROM xs WINDOW f AS (PARTITION BY formation ORDER BY score)
), bu AS (SELECT *, least(5, ceil(round(rk * 5 / n, 10)))::INT AS bucket FROM bk), pe AS (
  SELECT formation, count(*) AS assets, corr(rk, ork) AS rank_ic, avg(forward) FILTER (bucket = 5) AS top_return, avg(forward) FILTER (bucket = 1) AS bottom_return, avg(forward) AS universe_return FROM bu GROUP BY formation HAVING count(*) >= 5 AND count(DISTINCT score) >= 5 AND count(DISTINCT forward) >= 2 AND count(DISTINCT bucket) = 5)"""


def _cross(spark, sf_dir):
    from pyspark.sql import window as W

    u = P.universe(spark, sf_dir)
    ends = u.groupBy("symbol", F.last_day("day").alias("month")).agg(F.max_by("close", "day").alias("c"))
    w = W.Window.partitionBy("symbol").orderBy("month")
    months = ends.select("symbol", "month", F.round(F.col("c") / F.lag("c").over(w) - 1, 10).alias("value")).where("value is not null")
    return fa.formations(months, u)


@query("xs01_momentum_12_1", f"WITH {_XS} SELECT symbol, formation, round(score, 6) AS score FROM xs")
def _xs01(spark, sf_dir):
    return rounded(_cross(spark, sf_dir).select("symbol", "formation", "score"))


@query("xs02_forward_return", f"WITH {_XS} SELECT symbol, formation, round(forward, 6) AS forward FROM xs")
def _xs02(spark, sf_dir):
    return rounded(_cross(spark, sf_dir).select("symbol", "formation", "forward"))


@query("agg19_quantile_buckets", f"WITH {_XS} SELECT formation, bucket, count(*) AS assets, round(avg(forward), 6) AS mean_forward FROM bu GROUP BY ALL")
def _agg19(spark, sf_dir):
    return rounded(fa.buckets(_cross(spark, sf_dir)).groupBy("formation", "bucket").agg(F.count("*").alias("assets"), F.avg("forward").alias("mean_forward")))


@query("xs04_periods", f"WITH {_XS} SELECT formation, assets, round(rank_ic, 6) AS rank_ic, round(top_return - bottom_return, 6) AS top_minus_bottom, round(top_return, 6) AS top_return, round(bottom_return, 6) AS bottom_return, round(universe_return, 6) AS universe_return FROM pe")
def _xs04(spark, sf_dir):
    return rounded(fa.periods(_cross(spark, sf_dir)))


QUERIES["xs03_rank_ic"], SQL["xs03_rank_ic"] = QUERIES["xs04_periods"], SQL["xs04_periods"]


@query("xs05_study_summary", f"""WITH {_XS}, wl AS (SELECT *, product(1 + top_return) OVER (ORDER BY formation) AS wealth FROM pe), dw AS (SELECT *, wealth / greatest(1, max(wealth) OVER (ORDER BY formation)) - 1 AS dd FROM wl)
SELECT count(*) AS periods, round(avg(rank_ic), 6) AS mean_ic, round(quantile_cont(rank_ic, 0.5), 6) AS median_ic, round(stddev_samp(rank_ic), 6) AS ic_deviation, round(avg(rank_ic) / stddev_samp(rank_ic), 6) AS information_ratio, round(count(*) FILTER (rank_ic > 0) / count(*), 6) AS positive_share, round(avg(top_return - bottom_return), 6) AS mean_spread,
  round(product(1 + top_return) ** (12 / count(*)) - 1, 6) AS annualised_top, round(min(dd), 6) AS max_drawdown FROM dw""")
def _xs05(spark, sf_dir):
    return rounded(fa.study_summary(fa.periods(_cross(spark, sf_dir))))


for _n in ("skl15_cross_sectional_signal", "win36_equity_drawdown", "fn14_annualised_return"):
    QUERIES[_n], SQL[_n] = QUERIES["xs05_study_summary"], SQL["xs05_study_summary"]


@query("xs06_ic_bootstrap")
def _xs06(spark, sf_dir):
    return rounded(fa.ic_bootstrap(fa.periods(_cross(spark, sf_dir))))


@query("xs07_grouped_ic", f"WITH {_XS}, g AS (SELECT x.*, region FROM xs x JOIN (SELECT DISTINCT symbol, region FROM universe) USING (symbol)), r AS (SELECT formation, region, rank() OVER (PARTITION BY formation, region ORDER BY score) + (count(*) OVER (PARTITION BY formation, region, score) - 1) / 2 AS a, rank() OVER (PARTITION BY formation, region ORDER BY forward) + (count(*) OVER (PARTITION BY formation, region, forward) - 1) / 2 AS b FROM g) SELECT formation, region, count(*) AS n, round(corr(a, b), 6) AS rank_ic FROM r GROUP BY ALL HAVING count(*) >= 4")
def _xs07(spark, sf_dir):
    place = P.table(spark, sf_dir, "nation").join(P.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("region"))
    rows = _cross(spark, sf_dir).join(place, "symbol").select("formation", "region", fa.average_rank("score", "formation", "region").alias("a"), fa.average_rank("forward", "formation", "region").alias("b"))
    return rounded(rows.groupBy("formation", "region").agg(F.count("*").alias("n"), F.corr("a", "b").alias("rank_ic")).where("n >= 4"))


_TOPW = _XS + """, tw AS (SELECT b.formation AS period, symbol, 1 / count(*) OVER (PARTITION BY b.formation) AS weight FROM bu b JOIN pe USING (formation) WHERE bucket = 5), pp AS (SELECT period, lag(period) OVER (ORDER BY period) AS prev FROM (SELECT DISTINCT period FROM tw)), ch AS (
  SELECT p.period, p.prev, n.symbol, n.weight, 0 AS w0 FROM pp p JOIN tw n ON n.period = p.period UNION ALL SELECT p.period, p.prev, o.symbol, 0, o.weight FROM pp p JOIN tw o ON o.period = p.prev), s AS (SELECT period, prev, symbol, sum(weight) - sum(w0) AS d FROM ch GROUP BY ALL)"""


@query("win35_turnover", f"WITH {_TOPW} SELECT period, round(CASE WHEN prev IS NULL THEN 1 ELSE sum(abs(d)) / 2 END, 6) AS turnover FROM s GROUP BY period, prev")
def _win35(spark, sf_dir):
    from pyspark.sql import window as W

    rows = _cross(spark, sf_dir)
    top = fa.buckets(rows).join(fa.periods(rows).select("formation"), "formation", "left_semi").where("bucket = 5")
    weights = top.select(F.col("formation").alias("period"), "symbol", (1 / F.count("*").over(W.Window.partitionBy("formation"))).alias("weight"))
    return rounded(alignment.turnover(weights))
