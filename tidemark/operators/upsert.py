"""Incremental maintenance of tables: partial upserts, ledgers, versions, state machines.

Spark's Parquet tables have no row updates: each operator returns the new table, to be written beside the old one.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import _list
from tidemark.operators.windows import latest


def dedupe(df: DataFrame, key, order, keep: str = "last") -> DataFrame:
    o = [F.desc(c) if keep == "last" else F.asc(c) for c in _list(order)]
    return latest(df, key, o)


def upsert(base: DataFrame, incoming: DataFrame, key, order=None) -> DataFrame:
    """Inserts new keys; for known ones overwrites only the columns that incoming has. Of equal incoming keys the last by order counts."""
    key = _list(key)
    if order is not None:
        incoming = dedupe(incoming, key, order)
    given = [c for c in incoming.columns if c in base.columns and c not in key]
    inc = incoming.select(*key, *[F.col(c).alias(f"__{c}") for c in given]).withColumn("__inc", F.lit(True))
    both = base.withColumn("__base", F.lit(True)).join(inc, key, "full")
    return both.select(*[F.col(c) if c in key else F.when(F.col("__inc"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in base.columns])


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition isn't true; an unknown condition keeps its row, as DELETE does."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def update_from(base: DataFrame, other: DataFrame, key, sets: dict[str, str], only_null: bool = False) -> DataFrame:
    """UPDATE ... FROM: sets target columns from other's where the key matches; only_null fills nulls alone."""
    key = _list(key)
    o = other.select(*key, *[F.col(s).alias(f"__{t}") for t, s in sets.items()]).withColumn("__hit", F.lit(True))
    j = base.join(o, key, "left")
    new = {t: F.coalesce(F.col(t), F.col(f"__{t}")) if only_null else F.when(F.col("__hit"), F.col(f"__{t}")).otherwise(F.col(t)) for t in sets}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def unprocessed(work: DataFrame, ledger: DataFrame, key) -> DataFrame:
    """Work whose key is not in the ledger of what was done."""
    return work.join(ledger.select(*_list(key)).distinct(), _list(key), "left_anti")


def next_versions(stored: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Rows to append to a version log (key, version, hash): content whose hash differs from the key's latest version."""
    last = stored.groupBy(key).agg(F.max_by(F.struct("version", "hash"), "version").alias("last"))
    j = incoming.withColumn("hash", F.sha2(F.col(content), 256)).join(last, key, "left")
    return j.where(~F.col("hash").eqNullSafe(F.col("last.hash"))).withColumn("version", F.coalesce("last.version", F.lit(0)) + 1).drop("last")


def is_latest(log: DataFrame, key: str) -> DataFrame:
    """The log with is_latest. The newest version is found on narrow columns and joined back, so that no content is sorted."""
    top = log.groupBy(key).agg(F.max("version").alias("__top"))
    return log.join(top, key).withColumn("is_latest", F.col("version") == F.col("__top")).drop("__top")


def fingerprint(df: DataFrame, by, stamp: str) -> DataFrame:
    """count|max(stamp) of each group, to see whether anything changed."""
    return df.groupBy(*_list(by)).agg(F.concat(F.count("*").cast("string"), F.lit("|"), F.max(stamp).cast("string")).alias("fingerprint"))


def update_mode(stored, new, frequency, has_rows) -> Column:
    """full for a first load and for slow series that changed, overlap for daily ones, skip for unchanged."""
    return (F.when(~F.coalesce(has_rows, F.lit(False)), "full").when(stored.eqNullSafe(new), "skip").when(frequency == "D", "overlap").otherwise("full"))


def failure_state(status, failures, failed, since, today, limit: int = 3, recheck_days: int = 30) -> dict[str, Column]:
    """Next (status, consecutive_failures, attempt) of an instrument: no_data after `limit` failures, tried again after recheck_days."""
    n = F.when(failed, F.coalesce(failures, F.lit(0)) + 1).otherwise(0)
    due = (status != "no_data") | (F.datediff(today, since) >= recheck_days)
    return {"consecutive_failures": n, "status": F.when(n >= limit, "no_data").when(failed, status).otherwise("active"), "attempt": due}


def carry_forward(df: DataFrame, key: str, order: str, c: str, missing: Column, out: str | None = None) -> DataFrame:
    """c of the last earlier row that has one, where `missing` holds; other nulls stay."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out or c, F.when(F.col(c).isNull() & missing, F.last(c, ignorenulls=True).over(w)).otherwise(F.col(c)))
