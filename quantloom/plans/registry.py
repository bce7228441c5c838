"""Analysts by name: each takes the panels of a request and returns its rows; one failure leaves the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quantloom.operators import analysts, risk

ANALYSTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "technical": analysts.technical,
    "technical-basic": analysts.technical_basic,
    "risk-analysis": risk.risk_statistics,
    "volatility-regime": risk.volatility_regime,
    "markov-method": risk.markov,
    "worth-buy-stocks": analysts.worth_buy,
}


def register(name: str, analyst: Callable[[DataFrame], DataFrame]) -> None:
    if name in ANALYSTS:
        raise ValueError(f"{name} is registered")
    ANALYSTS[name] = analyst


@dataclass
class Report:
    results: dict[str, DataFrame] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return "COMPLETE" if not self.failures else "PARTIAL" if self.results else "FAILED"


def analyse(bars: DataFrame, names: list[str]) -> Report:
    """Plan each named analyst over all instruments of ``bars``; an unknown or failing one is noted."""
    report = Report()
    for name in names:
        try:
            report.results[name] = ANALYSTS[name](bars)
        except Exception as failed:  # noqa: BLE001  one analyst's failure is a row of the report
            report.failures[name] = f"{type(failed).__name__}: {failed}"[:200]
    return report
