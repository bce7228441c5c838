"""Trailing, centred and cumulative window expressions over one (instrument, time) order.

Every builder takes the same :class:`Series`, so all columns of a select share one exchange and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import window as W


@dataclass(frozen=True)
class Series:
    key: str = "symbol"
    order: str = "day"

    @property
    def w(self) -> W.WindowSpec:
        return W.Window.partitionBy(self.key).orderBy(self.order)

    def last(self, n: int) -> W.WindowSpec:
        return self.w.rowsBetween(1 - n, 0)

    def before(self, n: int) -> W.WindowSpec:
        return self.w.rowsBetween(-n, -1)

    @property
    def so_far(self) -> W.WindowSpec:
        return self.w.rowsBetween(W.Window.unboundedPreceding, 0)

    def lag(self, column: str | Column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.w)

    @property
    def number(self) -> Column:
        """1 for the first row."""
        return F.row_number().over(self.w)


def full(s: Series, n: int, value: Column) -> Column:
    """``value`` once ``n`` rows have been seen."""
    return F.when(s.number >= n, value)


def sma(s: Series, column: str, n: int) -> Column:
    return full(s, n, F.avg(column).over(s.last(n)))


def bollinger(s: Series, column: str, n: int = 20, k: float = 2.0, sample: bool = False) -> tuple[Column, Column, Column]:
    """(lower, middle, upper) bands of population or sample deviation."""
    deviation = (F.stddev_samp if sample else F.stddev_pop)(column).over(s.last(n))
    middle = F.avg(column).over(s.last(n))
    return full(s, n, middle - k * deviation), full(s, n, middle), full(s, n, middle + k * deviation)


def simple_return(s: Series, column: str, n: int = 1) -> Column:
    return F.col(column) / s.lag(column, n) - 1


def log_return(s: Series, column: str) -> Column:
    return F.ln(F.col(column) / s.lag(column))


def volatility(s: Series, ret: str, n: int, year: int = 252) -> Column:
    """Annualised sample deviation of the last ``n`` values of a return column whose first row is null."""
    return full(s, n + 1, F.stddev_samp(ret).over(s.last(n)) * F.sqrt(F.lit(float(year))))


def true_range(s: Series) -> Column:
    previous = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))


def obv_step(s: Series) -> Column:
    """Signed volume of each row; its running sum is the on-balance volume."""
    return F.coalesce(F.signum(F.col("close") - s.lag("close")) * F.col("volume"), F.lit(0.0))


def efficiency(s: Series, move: str, n: int = 30, column: str = "close") -> Column:
    """|net| / sum of |moves|; 1 where nothing moved. ``move`` holds the absolute changes."""
    path = F.sum(move).over(s.last(n))
    return full(s, n + 1, F.when(path == 0, 1.0).otherwise(F.abs(F.col(column) - s.lag(column, n)) / path))


def up_down_ratio(s: Series, change: str, n: int = 10) -> Column:
    """Mean volume of rising rows over that of falling rows among the last ``n``."""
    up = F.avg(F.when(F.col(change) > 0, F.col("volume"))).over(s.last(n))
    down = F.avg(F.when(F.col(change) < 0, F.col("volume"))).over(s.last(n))
    ratio = F.when(down.isNull(), F.when(up.isNotNull(), 2.0).otherwise(1.0)).when(up.isNull(), 0.5).when(down == 0, 2.0).otherwise(F.try_divide(up, down))
    return full(s, n + 1, ratio)


def crossed(s: Series, left: str, right: str) -> tuple[Column, Column]:
    """(up, down): left was not above (below) right on the row before and now is; false where anything is null."""
    up = (s.lag(left) <= s.lag(right)) & (F.col(left) > F.col(right))
    down = (s.lag(left) >= s.lag(right)) & (F.col(left) < F.col(right))
    return F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))


def entered(s: Series, column: str, low: float, high: float) -> tuple[Column, Column]:
    """(fell to low or below, rose to high or above), counting a first value that is already there."""
    before = s.lag(column)
    fell = (F.col(column) <= low) & (before.isNull() | (before > low))
    rose = (F.col(column) >= high) & (before.isNull() | (before < high))
    return F.coalesce(fell, F.lit(False)), F.coalesce(rose, F.lit(False))


def channel(s: Series, n: int) -> tuple[Column, Column]:
    """(highest high, lowest low) of the ``n`` rows before."""
    return full(s, n + 1, F.max("high").over(s.before(n))), full(s, n + 1, F.min("low").over(s.before(n)))


def drawdown(s: Series, column: str = "close") -> Column:
    return F.col(column) / F.max(column).over(s.so_far) - 1


def regime_label(ret: Column, bull: float = 0.05, bear: float = -0.05) -> Column:
    """2 bull, 0 bear, 1 between."""
    return F.when(ret >= bull, 2).when(ret <= bear, 0).otherwise(1)
