"""Column expressions over bars of one symbol in time order.

Every window here has the same partitioning and order, so Spark sorts the
bars once however many expressions are used.  An expression that contains
a window must become a column before another window reads it.  Missing is null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, TIME, INDEX = "symbol", "ts", "bar"


def W():
    """Bars of one symbol in time order."""
    return Window.partitionBy(KEY).orderBy(TIME)


def U():
    """All bars up to the current one."""
    return W().rowsBetween(Window.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def R(n: int):
    """The last n rows."""
    return W().rowsBetween(-(n - 1), 0)


def forward(n: int):
    """The next n rows."""
    return W().rowsBetween(1, n)


def indexed(bars: DataFrame) -> DataFrame:
    """``bars`` with a running number per symbol."""
    return bars.withColumn(INDEX, F.row_number().over(W()))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(W())


def diff(x: str | Column, n: int = 1) -> Column:
    return col(x) - lag(x, n)


def full(x: str | Column, n: int, made: Column) -> Column:
    """``made`` where all of the last n values are there."""
    return F.when(F.count(col(x)).over(R(n)) == n, made)


def sma(x: str | Column, n: int) -> Column:
    return full(x, n, F.avg(col(x)).over(R(n)))


def total(x: str | Column, n: int) -> Column:
    return full(x, n, F.sum(col(x)).over(R(n)))


def highest(x: str | Column, n: int) -> Column:
    return full(x, n, F.max(col(x)).over(R(n)))


def lowest(x: str | Column, n: int) -> Column:
    return full(x, n, F.min(col(x)).over(R(n)))


def deviation(x: str | Column, n: int) -> Column:
    return full(x, n, F.stddev_pop(col(x)).over(R(n)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(col(a), col(b))


def percent(a: Column | str, b: Column | str) -> Column:
    return ratio(a, b) * 100


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or can't be told."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def clipped(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null."""
    x = col(x)
    y = x if low is None else F.greatest(x, F.lit(float(low)))
    y = y if high is None else F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def sign(x: Column | str) -> Column:
    return F.signum(col(x))


def _before(level: str | Column | float) -> Column:
    return F.lit(level) if isinstance(level, (int, float)) else lag(level)


def _now(level: str | Column | float) -> Column:
    return F.lit(level) if isinstance(level, (int, float)) else col(level)


def crosses_above(x: str | Column, level: str | Column | float) -> Column:
    """1 on the bar that is above the level after one that wasn't."""
    return flag((lag(x) <= _before(level)) & (col(x) > _now(level)))


def crosses_below(x: str | Column, level: str | Column | float) -> Column:
    return flag((lag(x) >= _before(level)) & (col(x) < _now(level)))


def bars_since(condition: Column) -> Column:
    """Bars since the condition last held; null before it first did."""
    return F.col(INDEX) - F.last(F.when(condition, F.col(INDEX)), ignorenulls=True).over(U())


def streak(condition: Column) -> Column:
    """How many bars in a row the condition has held."""
    return F.col(INDEX) - F.coalesce(F.last(F.when(~holds(condition), F.col(INDEX)), ignorenulls=True).over(U()), F.lit(0))


def filled(x: Column | str) -> Column:
    """The last value that was there."""
    return F.last(col(x), ignorenulls=True).over(U())


def percent_rank(x: str | Column, n: int) -> Column:
    """Rank of the current value among the last n, in percent; ties share their mean rank."""
    values = F.collect_list(col(x)).over(R(n))
    below = F.size(F.filter(values, lambda v: v < col(x)))
    same = F.size(F.filter(values, lambda v: v == col(x)))
    return F.when(F.size(values) == n, (below + (same + 1) / F.lit(2.0)) / F.lit(float(n)) * 100)


def regression_end(x: str | Column, n: int) -> Column:
    """Value at the last bar of the line fitted to the last n: three times the weighted mean less twice the mean."""
    values = F.collect_list(col(x)).over(R(n))
    weighted = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.lit(float(n))
    return F.when(F.size(values) == n, 3 * weighted / F.lit(n * (n + 1) / 2.0) - 2 * mean)


def mean_deviation(x: str | Column, n: int) -> Column:
    """Mean absolute deviation from the mean of the last n."""
    values = F.collect_list(col(x)).over(R(n))
    mean = F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.lit(float(n))
    return F.when(F.size(values) == n, F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, b: a + b) / F.lit(float(n)))


def correlation(x: str | Column, y: str | Column, frame, n: int) -> Column:
    """Correlation over a frame of n pairs; null where one side is flat."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    value = F.try_divide(F.covar_pop(a, b).over(frame), F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame))
    return F.when(F.count(a).over(frame) == n, value)


def skewness(x: str | Column, n: int) -> Column:
    """Bias-corrected skewness of the last n."""
    return full(x, n, F.skewness(col(x)).over(R(n)) * F.lit((n * (n - 1)) ** 0.5 / (n - 2)))


def kurtosis(x: str | Column, n: int) -> Column:
    """Bias-corrected excess kurtosis of the last n."""
    return full(x, n, ((n + 1) * F.kurtosis(col(x)).over(R(n)) + 6) * F.lit((n - 1) / ((n - 2.0) * (n - 3.0))))


def true_range() -> Column:
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def signed_log(x: Column | str) -> Column:
    return F.signum(col(x)) * F.log1p(F.abs(col(x)))


def pivot_high(x: str | Column, window: int = 5) -> Column:
    """The value ``window // 2`` bars ago where it tops the window around it, known only now."""
    half = window // 2
    return F.when(lag(x, half) == highest(x, window), lag(x, half))


def pivot_low(x: str | Column, window: int = 5) -> Column:
    half = window // 2
    return F.when(lag(x, half) == lowest(x, window), lag(x, half))


def running_total(x: Column | str) -> Column:
    return F.sum(col(x)).over(U())
