"""Null, tie, ordering and moment rules, written once."""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nulls_last(*cols, desc: bool = False) -> list[Column]:
    return [col(c).desc_nulls_last() if desc else col(c).asc_nulls_last() for c in cols]


def finite(c) -> Column:
    """NaN and infinities become null: missing has one form."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def ratio(a, b) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pct_change(c, w: WindowSpec, n: int = 1) -> Column:
    return ratio(c, F.lag(c, n).over(w)) - 1


def guarded(agg: Column, c, w: WindowSpec, least: int) -> Column:
    """A window aggregate of c, null until the frame holds `least` non-null values."""
    return F.when(F.count(col(c)).over(w) >= least, agg.over(w))


def rolling(c, n: int, fn, by, order, least: int | None = None) -> Column:
    """fn over the last n rows of each key, with min_periods semantics (default n)."""
    w = Window.partitionBy(*_list(by)).orderBy(*_list(order)).rowsBetween(-(n - 1), 0)
    return guarded(fn(col(c)), c, w, n if least is None else least)


def _list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def avg_rank(c, by=()) -> Column:
    """Rank of non-null c with ties sharing their mean rank; null for null."""
    c = col(c)
    part = Window.partitionBy(*_list(by), c.isNull())
    ties = Window.partitionBy(*_list(by), c)
    return F.when(c.isNotNull(), F.rank().over(part.orderBy(c)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def pct_rank(c, by=()) -> Column:
    """Mean rank over the number of non-null values."""
    c = col(c)
    return avg_rank(c, by) / F.count(c).over(Window.partitionBy(*_list(by)))


def unit_rank(c, by=(), missing: float = 0.5) -> Column:
    """Mean rank scaled to [0, 1]; `missing` for nulls and where only one value is there."""
    c = col(c)
    n = F.count(c).over(Window.partitionBy(*_list(by)))
    return F.coalesce(F.try_divide(avg_rank(c, by) - 1, (n - 1).cast("double")), F.lit(missing))


def zscore(c, by=()) -> Column:
    """(x - mean) / sample deviation within by; null where the deviation is zero or undefined."""
    c, w = col(c), Window.partitionBy(*_list(by))
    return F.try_divide(c - F.avg(c).over(w), F.stddev_samp(c).over(w))


def demean(c, by=()) -> Column:
    return col(c) - F.avg(col(c)).over(Window.partitionBy(*_list(by)))


def skew_pop(c) -> Column:
    return F.skewness(col(c))


def kurt_pop(c) -> Column:
    """Excess kurtosis of the population."""
    return F.kurtosis(col(c))


def skew_sample(c) -> Column:
    """Bias-corrected skewness G1; null below three values."""
    n = F.count(col(c)).cast("double")
    return F.when(n >= 3, F.skewness(col(c)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurt_sample(c) -> Column:
    """Bias-corrected excess kurtosis G2; null below four values."""
    n = F.count(col(c)).cast("double")
    return F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(col(c)) + 6))


def sum_at_least(c, least: int) -> Column:
    """sum, null unless `least` values are there."""
    return F.when(F.count(col(c)) >= least, F.sum(col(c)))


def quantile(c, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(col(c), F.lit(q))


def compound(r) -> Column:
    """Product of 1 + r, less 1."""
    return F.product(1 + col(r)) - 1


def row_mean(*cols) -> Column:
    """Mean of the non-null values of several columns."""
    a = F.filter(F.array(*[col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a).cast("double"))


def row_count(*cols) -> Column:
    return sum((col(c).isNotNull().cast("int") for c in cols), F.lit(0))
