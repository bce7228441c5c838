"""Streaming twins: bars from ticks under a watermark, and running indicators with state of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_bars(ticks: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(symbol, ts, open, high, low, close, n) of (symbol, ts, value); ticks later than ``late`` are dropped."""
    w = F.window("ts", width)
    rows = ticks.withWatermark("ts", late).groupBy("symbol", w).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return rows.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "n")


def running_ema(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, ts, close, ema) of a stream of (symbol, ts, close) in time order; the state of an instrument is the
    number of bars, the sum of the first ``n`` and the average since."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, total, average = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in frames:
            pdf = pdf.sort_values("ts")
            out = []
            for value in pdf.close.tolist():
                count += 1
                if count <= n:
                    total += value
                    average = total / n
                else:
                    average += (value - average) * 2 / (n + 1)
                out.append(average if count >= n else None)
            yield pd.DataFrame({"symbol": pdf.symbol, "ts": pdf.ts, "close": pdf.close, "ema": pd.Series(out, index=pdf.index, dtype="Float64")})
        state.update((count, total, average))

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, ema double", "count bigint, total double, average double", "append", GroupStateTimeout.NoTimeout)
