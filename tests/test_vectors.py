"""Exact small vectors and properties of the library's operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import frames as fr
from quantloom.functions import special
from quantloom.operators import alignment, analysts, backtest, evaluation, factors, fundamentals, indicators, risk, signals, validation
from quantloom.plans import registry

BAR = "symbol string, day date, open double, high double, low double, close double, volume double"


def day(i: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def bars(spark, closes, symbol="A", spread=0.01):
    rows = [(symbol, day(i), float(c), c * (1 + spread), c * (1 - spread), float(c), 1000.0 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def test_moving_averages_need_their_history(spark):
    got = bars(spark, [1, 2, 3, 4, 5]).select("day", fr.sma(fr.Series(), "close", 3).alias("v")).orderBy("day").collect()
    assert [r.v for r in got] == [None, None, 2.0, 3.0, 4.0]


def test_recurrences_closed_forms():
    assert indicators.ema(np.ones(20), 10)[9:].tolist() == [1.0] * 11
    assert np.isnan(indicators.ema(np.ones(5), 10)).all()
    assert indicators.rsi(np.ones(20))[-1] == 50 and indicators.rsi(np.arange(20.0))[-1] == 100 and indicators.rsi(-np.arange(20.0) + 50)[-1] == 0
    h, lo, c = np.full(30, 11.0), np.full(30, 9.0), np.full(30, 10.0)
    assert indicators.wilder(indicators.true_range(h, lo, c), 14)[-1] == 2.0


def test_recurrences_do_not_look_ahead(spark):
    closes = (100 + np.cumsum(np.sin(np.arange(90)))).tolist()
    whole = {r.day: r for r in indicators.recurrences(bars(spark, closes)).collect()}
    for r in indicators.recurrences(bars(spark, closes[:70])).collect():
        assert [r[c] for c in indicators.RECURRENT] == [whole[r.day][c] for c in indicators.RECURRENT]


def test_fold_equals_series(spark):
    b = bars(spark, (100 + np.cumsum(np.cos(np.arange(80)))).tolist())
    one, last = indicators.latest(b).first(), indicators.recurrences(b).orderBy(F.desc("day")).first()
    assert one.ema20 == pytest.approx(last.ema20) and one.rsi14 == pytest.approx(last.rsi14) and one.atr14 == pytest.approx(last.atr14)


def test_drawdown_and_momentum(spark):
    assert risk.max_drawdown(bars(spark, [100] * 10 + [80] * 10)).first().max_drawdown == pytest.approx(-0.2)
    got = indicators.trailing(bars(spark, [100 + 0.1 * i for i in range(253)])).orderBy(F.desc("day")).first()
    assert got.momentum_12_1 == pytest.approx((100 + 0.1 * 231) / 100 - 1) and got.efficiency == pytest.approx(1.0)


def test_invalid_and_repeated_bars_go(spark):
    good = bars(spark, [10, 11, 12, 13])
    bad = good.where("close = 11").withColumn("high", F.lit(1.0))
    twice = good.where("close = 12")
    kept = validation.validated(good.where("close <> 11").union(bad).union(twice))
    assert sorted(r.close for r in kept.collect()) == [10.0, 13.0]
    assert validation.bar_quality(good.union(twice)).first().discarded


def test_regimes_and_transitions(spark):
    got = risk.regimes(bars(spark, [100] * 20 + [110] * 10)).orderBy("day").collect()
    assert [r.label for r in got] == [1] * 20 + [2] * 10
    rows = spark.createDataFrame([("A", day(i), i, [2, 0][i % 2]) for i in range(100)], "symbol string, day date, idx int, label int")
    matrix = {(r.origin, r.target): r.probability for r in risk.transitions(rows, window=0).collect()}
    assert matrix[2, 0] == 1 and matrix[0, 2] == 1 and matrix[1, 0] == pytest.approx(1 / 3)
    even = risk.stationary(risk.transitions(spark.createDataFrame([("A", day(i), i, i % 3) for i in range(300)], "symbol string, day date, idx int, label int"), window=0)).first()
    assert even.bear == pytest.approx(1 / 3, abs=0.01)


def test_fixed_horizon(spark):
    values = [100, 101, 103, 106, 105]
    pts = evaluation.points(bars(spark, values, spread=0.0), entry=None)
    events = spark.createDataFrame([("A", day(0), "long")], "symbol string, at date, direction string")
    got = evaluation.fixed_horizon(pts, events, horizon=2).collect()
    assert len(got) == 1 and got[0].entry_idx == 1 and got[0].exit_at == day(3) and got[0].change == pytest.approx(106 / 101 - 1)
    assert evaluation.fixed_horizon(pts, events, horizon=9).count() == 0


def test_triple_barrier_counts_a_bar_of_both_as_the_stop(spark):
    rows = [("A", day(0), 100.0, 100.0, 100.0, 100.0, 1.0), ("A", day(1), 100.0, 100.0, 100.0, 100.0, 1.0), ("A", day(2), 100.0, 106.0, 96.0, 100.0, 1.0)]
    pts = evaluation.points(spark.createDataFrame(rows, BAR), entry=None)
    events = spark.createDataFrame([("A", day(0), "long")], "symbol string, at date, direction string")
    got = evaluation.triple_barrier(pts, events).first()
    assert (got.exit_reason, got.change, got.ambiguous) == ("stop_loss", -0.03, True)


def test_non_overlap_and_summary(spark):
    rows = [("A", day(i), "long", i, i * 1.0) for i in (0, 1, 5)]
    out = spark.createDataFrame(rows, "symbol string, at date, direction string, entry_idx int, r_multiple double").withColumn("change", F.lit(0.1))
    assert sorted(r.entry_idx for r in evaluation.non_overlapping(out, 3).collect()) == [0, 5]
    rs = spark.createDataFrame([("A", day(i), r, r * 0.01) for i, r in enumerate((1.0, 0.0, -1.0))], "symbol string, at date, r_multiple double, change double")
    one = evaluation.summarise(rs).first()
    assert one.break_even_win_rate == pytest.approx(1 / 3) and one.edge_over_break_even == pytest.approx(0)


def test_bootstrap_is_reproducible(spark):
    rows = spark.createDataFrame([("A", i, float(i % 3 - 1)) for i in range(30)], "symbol string, entry_idx int, r_multiple double")
    assert evaluation.block_bootstrap(rows, 50).collect() == evaluation.block_bootstrap(rows.repartition(3), 50).collect()


def test_level_breaks_and_currency(spark):
    levels = spark.createDataFrame([("A", day(0), 80.0), ("A", day(1), 88.0), ("A", day(2), None), ("A", day(3), 90.0)], "symbol string, day date, value double")
    got = alignment.from_levels(levels).collect()
    assert len(got) == 1 and got[0].value == pytest.approx(0.1)
    fx = spark.createDataFrame([(day(0), 1.1), (day(1), 1.2)], "date date, level double")
    r = spark.createDataFrame([("A", day(0), day(1), 0.1), ("A", day(1), day(2), 0.1)], "symbol string, start_date date, end_date date, value double")
    assert [x.value for x in alignment.converted(r, fx).collect()] == [pytest.approx(0.2)]


def test_portfolio_weights():
    cov = np.diag([0.04, 0.01, 0.09]) + 0.001
    w = alignment.risk_parity(cov)
    share = w * (cov @ w) / (w @ cov @ w)
    assert share == pytest.approx([1 / 3] * 3, abs=1e-6) and w.sum() == pytest.approx(1)
    best = alignment.maximum_diversification(cov)
    ratio = lambda x: x @ np.sqrt(np.diag(cov)) / np.sqrt(x @ cov @ x)
    rng = np.random.default_rng(1)
    assert all(ratio(best) >= ratio(x) - 1e-9 for x in rng.dirichlet(np.ones(3), 200))


def test_regression_recovers_betas_and_hac_errors(spark):
    rng = np.random.default_rng(73)
    x = rng.normal(0, 0.01, (300, 3))
    y = 0.0002 + x @ [1.2, 0.4, -0.3] + rng.normal(0, 0.001, 300)
    rows = [(day(i), day(i + 1), float(y[i]), *map(float, x[i])) for i in range(300)]
    study = spark.createDataFrame(rows, "start_date date, end_date date, y double, x1 double, x2 double, x3 double")
    got = {r.term: r for r in factors.regression(study, ["a", "b", "c"], 5).collect()}
    design = np.column_stack([np.ones(300), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    u = design * (y - design @ beta)[:, None]
    meat = u.T @ u
    for m in range(1, 6):
        g = u[m:].T @ u[:-m]
        meat += (1 - m / 6) * (g + g.T)
    inv = np.linalg.inv(design.T @ design)
    error = np.sqrt(np.diag(inv @ meat @ inv) * 300 / 296)
    for i, t in enumerate(["intercept", "a", "b", "c"]):
        assert got[t].estimate == pytest.approx(beta[i]) and got[t].standard_error == pytest.approx(error[i])


def test_distribution_tails():
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_tail(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)


def test_backtest_fills_at_next_open_and_balances():
    frame = pd.DataFrame({"open": [100, 110, 120, 130, 125, 140.0], "action": [None, "add_long", None, "exit_long", None, None]})
    frame = frame.assign(high=frame.open, low=frame.open, close=frame.open)
    trades, curve = backtest.simulate(frame, backtest.Plan(commission=0.0))
    assert [(t["entry_bar"], t["exit_bar"]) for t in trades] == [(2, 4)]
    assert curve[-1][1] == pytest.approx(1000 + sum(t["pnl"] for t in trades))
    frame.loc[:, "low"] = [100, 110, 100, 130, 125, 140.0]
    stopped, curve = backtest.simulate(frame, backtest.Plan(stop=0.05, min_hold=1))
    assert stopped[0]["reason"] in ("stop_loss", "strategy_exit") and curve[-1][1] == pytest.approx(1000 + sum(t["pnl"] for t in stopped))


def test_signals_do_not_change_when_bars_are_added(spark):
    closes = (100 + 8 * np.sin(np.arange(160) / 7) + np.arange(160) * 0.05).tolist()
    for make in (signals.moving_average_crossover, signals.dolphin, signals.turtle, signals.escalator, signals.ema_momentum):
        early = {tuple(r) for r in make(bars(spark, closes[:120])).collect()}
        late = {tuple(r) for r in make(bars(spark, closes)).collect()}
        assert early == {r for r in late if r[1] < day(120)}, make.__name__


def test_worth_buy_and_price_action_run_on_short_and_empty_input(spark):
    short = analysts.worth_buy(bars(spark, [100.0] * 10)).first()
    assert (short.verdict, short.composite, short.entry_price) == ("cannot_score", None, None)
    assert analysts.worth_buy(bars(spark, [100.0] * 10).where("false")).count() == 0
    assert analysts.worth_buy(bars(spark, [100 + 0.1 * i for i in range(260)])).first().verdict in ("buy", "watch", "no", "reduce_risk")
    assert analysts.pivots(analysts.with_gaps(bars(spark, []))).count() == 0


def test_filing_and_ratio_basics(spark):
    facts = [("A", "revenue", "current", 120.0, dt.date(2024, 12, 31), "USD"), ("A", "revenue", "prior", 100.0, dt.date(2023, 12, 31), "USD"), ("A", "net_income", "current", 12.0, dt.date(2024, 12, 31), "USD"), ("A", "market_cap", "current", 180.0, dt.date(2024, 12, 31), "USD")]
    made = spark.createDataFrame(facts, "symbol string, metric string, period_role string, value double, period_end date, currency string")
    keys = ["'annual' as period_type", "cast(year(period_end) as string) as period_ref", "if(period_role = 'current', cast(year(period_end) - 1 as string), null) as prior_period_ref", "'s' as snapshot_ref"]
    made = made.selectExpr("*", *keys, "DATE '2025-01-31' as valuation_as_of", "DATE '2025-02-01' as observed_at")
    got = {r.metric: r.value for r in fundamentals.ratios(made).collect()}
    assert got == {"revenue_growth": pytest.approx(0.2), "net_margin": pytest.approx(0.1), "price_to_earnings": pytest.approx(15)}


def test_registry_keeps_other_results(spark):
    report = registry.analyse(bars(spark, [100 + i for i in range(60)]), ["risk-analysis", "no-such-analyst"])
    assert report.status == "PARTIAL" and report.results["risk-analysis"].count() == 1
