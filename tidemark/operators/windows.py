"""Window operators: latest per group, fills, suffix products, islands, recursive averages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import _list, col


def latest(df: DataFrame, by, order, k: int = 1) -> DataFrame:
    """The first k rows of each group in the given order; Spark limits groups before they are shuffled."""
    w = Window.partitionBy(*_list(by)).orderBy(*_list(order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def ffill(c, by, order, limit: int | None = None) -> Column:
    """The last non-null value, at most `limit` rows back."""
    w = Window.partitionBy(*_list(by)).orderBy(*_list(order)).rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0)
    return F.last(col(c), ignorenulls=True).over(w)


def bfill(c, by, order, limit: int | None = None) -> Column:
    w = Window.partitionBy(*_list(by)).orderBy(*_list(order)).rowsBetween(0, Window.unboundedFollowing if limit is None else limit)
    return F.first(col(c), ignorenulls=True).over(w)


def ffill_days(c, by, day, limit: int) -> Column:
    """The last non-null value, at most `limit` days back; day is a date."""
    w = Window.partitionBy(*_list(by)).orderBy(F.unix_date(col(day))).rangeBetween(-limit, 0)
    return F.last(col(c), ignorenulls=True).over(w)


def suffix_product(c, by, order) -> Column:
    """Product of the positive factors strictly after each row; 1 after the last."""
    w = Window.partitionBy(*_list(by)).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in _list(order)]).rowsBetween(Window.unboundedPreceding, -1)
    return F.exp(F.coalesce(F.sum(F.ln(col(c))).over(w), F.lit(0.0)))


def cum_product(growth, by, order) -> Column:
    """Running product of growth factors."""
    return F.product(col(growth)).over(Window.partitionBy(*_list(by)).orderBy(*_list(order)).rowsBetween(Window.unboundedPreceding, 0))


def drawdown(c, by, order) -> Column:
    """Value over its running maximum, less 1."""
    w = Window.partitionBy(*_list(by)).orderBy(*_list(order)).rowsBetween(Window.unboundedPreceding, 0)
    return F.try_divide(col(c), F.max(col(c)).over(w)) - 1


def islands(df: DataFrame, flag, by, order, out: str = "island") -> DataFrame:
    """Numbers runs of rows with an equal flag."""
    w = Window.partitionBy(*_list(by)).orderBy(*_list(order))
    change = F.when(F.lag(col(flag)).over(w).eqNullSafe(col(flag)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn(out, change).withColumn(out, F.sum(out).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def longest_run(df: DataFrame, flag, by, order, value=True) -> DataFrame:
    """For each group the length of the longest run of flag = value, 0 without any."""
    by = _list(by)
    runs = islands(df.withColumn("__flag", col(flag)), "__flag", by, order).groupBy(*by, "island").agg(F.sum(F.when(F.col("__flag") == F.lit(value), 1).otherwise(0)).alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest"))


def fold(df: DataFrame, by, order, c: str, out: str, zero: Column, step) -> DataFrame:
    """A recursion along each key's rows: state' = step(state, value), the state of each row in column out.

    The ordered values of a key are one array (a key's series must fit a row); the fold runs in the JVM.
    """
    by, order = _list(by), _list(order)
    rest = [x for x in df.columns if x not in by]
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *[x for x in rest if x not in order]))).alias("__rows"))
    states = F.aggregate(F.col("__rows"), F.array(zero), lambda acc, r: F.concat(acc, F.array(step(F.element_at(acc, -1), r[c]))))
    return rows.withColumn("__states", F.slice(states, 2, F.size("__rows"))).select(*by, F.explode(F.arrays_zip("__rows", "__states")).alias("__z")).select(
        *by, *[F.col(f"__z.__rows.{x}").alias(x) for x in rest], F.col("__z.__states").alias(out))


def ewm_pandas(df: DataFrame, by, order, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Recursive averages y = (1 - a) y' + a x, started at the first value: out -> (column, a, least observations).

    A null keeps the state, and its age, as pandas does with adjust=False: the weight of the state decays over the gap.
    """
    import pandas as pd

    by, order = _list(by), _list(order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        for out, (c, alpha, least) in specs.items():
            pdf[out] = pdf[c].astype(float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        return pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*by).applyInPandas(run, fields + "".join(f", `{o}` double" for o in specs))
