"""Joins that Spark lacks: as-of, nearest, forward window, interval, prefix.

As-of joins are a union and one window on the key, so one shuffle and linear work whatever the two sides' sizes; range
joins go through an equi-join on key and time bucket, so that no key's rows are paired all with all.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys=(), values: list[str] | None = None, direction: str = "backward",
              max_age: int | None = None, strict: bool = False, inner: bool = False) -> DataFrame:
    """Each row of left with the right row in force: the last at or before it (backward) or the first at or after (forward).

    strict leaves out equal times. max_age, in days, nulls older matches. values are the right columns to bring (default:
    all but keys), the right time among them as right_time. Of right rows with equal times the one with the largest values
    counts. Without keys all rows share one window: use that for small tables only.
    """
    keys = _keys(keys)
    values = [c for c in right.columns if c not in keys] if values is None else list(dict.fromkeys([right_time, *values]))
    tag, when, held = "__side", "__when", "__held"
    l = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(left_time).alias(when), F.lit(0).alias(tag), F.struct(*left.columns).alias("__l"))
    r = right.where(F.col(right_time).isNotNull()).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(right_time).alias(when),
                     F.lit((1 if strict else -1) * (1 if direction == "backward" else -1)).alias(tag), F.struct(*values).alias(held))
    if direction == "forward":
        l = l.withColumn(tag, F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    time = F.col(when).asc() if direction == "backward" else F.col(when).desc()
    side = F.col(tag).asc() if direction == "backward" else F.col(tag).desc()
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy(time, side, F.col(held).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(held, F.last(held, ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    match = F.col(held)
    ok = F.col(when).isNotNull()
    for i in range(len(keys)):
        ok = ok & F.col(f"__k{i}").isNotNull()
    if max_age is not None:
        ok = ok & (F.abs(F.datediff(F.to_date(F.col(when)), F.to_date(F.col(f"{held}.{right_time}")))) <= max_age)
    out = out.withColumn(held, F.when(ok, match))
    if inner:
        out = out.where(F.col(held).isNotNull())
    return out.select("__l.*", *[F.col(f"{held}.{c}").alias(c if c not in left.columns else f"{c}_right") for c in values])


def _bucketed(df: DataFrame, start: Column, end: Column, days: int) -> DataFrame:
    return df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.unix_date(start) / days), F.floor(F.unix_date(end) / days))))


def interval_join(points: DataFrame, spans: DataFrame, keys, point: str, start: str, end: str, closed: str = "both", bucket_days: int = 32, how: str = "inner") -> DataFrame:
    """Points with the spans of the same key that contain them; closed: both, left or right. Spans are cut into buckets."""
    keys = _keys(keys)
    p = points.withColumn("__bucket", F.floor(F.unix_date(F.to_date(point)) / bucket_days))
    s = _bucketed(spans.where(F.col(start) <= F.col(end)), F.to_date(start), F.to_date(end), bucket_days)
    lo = F.col(point) >= F.col(start) if closed in ("both", "left") else F.col(point) > F.col(start)
    hi = F.col(point) <= F.col(end) if closed in ("both", "right") else F.col(point) < F.col(end)
    cond = p["__bucket"] == s["__bucket"]
    for k in keys:
        cond = cond & (p[k] == s[k])
    joined = p.join(s, cond & lo & hi, how)
    for k in keys:
        joined = joined.drop(s[k])
    return joined.drop(p["__bucket"]).drop(s["__bucket"])


def forward_window_first(left: DataFrame, right: DataFrame, keys, left_time: str, right_time: str, days: int) -> DataFrame:
    """left with the first right row in (left_time, left_time + days]; an as-of join forward, strictly later, with an age."""
    return asof_join(left, right, left_time, right_time, keys, direction="forward", strict=True, max_age=days)


def nearest_join(left: DataFrame, right: DataFrame, keys, left_time: str, right_time: str, tolerance: int, values: list[str]) -> DataFrame:
    """left with the nearest right row either way within tolerance days; of two equally near the earlier one."""
    b = asof_join(left, right, left_time, right_time, keys, values=values, max_age=tolerance)
    names = [right_time, *[v for v in values if v != right_time]]
    got = [n if n not in left.columns else f"{n}_right" for n in names]
    b = b.select(*left.columns, F.struct(*[F.col(g).alias(n) for g, n in zip(got, names, strict=True)]).alias("__back"))
    f = asof_join(b, right, left_time, right_time, keys, values=values, direction="forward", max_age=tolerance)
    gap_b = F.abs(F.datediff(F.to_date(F.col(left_time)), F.to_date(F.col(f"__back.{right_time}"))))
    gap_f = F.abs(F.datediff(F.to_date(F.col(got[0])), F.to_date(F.col(left_time))))
    use_f = F.col(got[0]).isNotNull() & (gap_b.isNull() | (gap_f < gap_b))
    return f.select(*left.columns, *[F.when(use_f, F.col(g)).otherwise(F.col(f"__back.{n}")).alias(g) for g, n in zip(got, names, strict=True)])


def longest_prefix_join(left: DataFrame, right: DataFrame, text: str, name: str, values: list[str]) -> DataFrame:
    """left with the right row whose name is the longest word prefix of text: prefixes are written out and joined by equality."""
    words = F.split(F.col(text), " ")
    key = "__row"
    l = left.withColumn(key, F.monotonically_increasing_id())
    p = l.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.array_join(F.slice(words, 1, i), " "))).alias("__prefix"))
    best = p.join(right.select(F.col(name).alias("__prefix"), *values), "__prefix").groupBy(key).agg(F.max_by(F.struct("__prefix", *values), F.length("__prefix")).alias("__best"))
    out = l.join(best, key, "left")
    return out.select(*left.columns, F.col("__best.__prefix").alias("matched_prefix"), *[F.col(f"__best.{v}").alias(v) for v in values])


def not_in(left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
    """Rows whose key isn't on the right; null keys on the left stay out, as with NOT IN against keys without nulls."""
    out = left.join(right.select(*cols).distinct(), list(cols), "left_anti")
    for c in cols:
        out = out.where(F.col(c).isNotNull())
    return out
