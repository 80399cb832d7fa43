"""Walk-forward cross-sectional models: labels, splits with an embargo, tree ensembles, sequences, weights from scores."""

from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import demean, unit_rank
from tidemark.operators.windows import latest

# Grids of the two ensembles; every configuration is fitted with every seed. A forest's unlimited depth is Spark's 30;
# Spark's boosting has no ridge penalty on leaves, so that axis (three values) is not there.
GRIDS = {"rf": {"featureSubsetStrategy": ["sqrt", "0.33", "0.5"], "maxDepth": [3, 5, 10, 30], "minInstancesPerNode": [5, 10, 20, 50], "numTrees": [300]},
         "gbt": {"stepSize": [0.005, 0.01, 0.03], "maxDepth": [1, 2, 3], "minInstancesPerNode": [1, 5, 10, 20], "maxIter": [300]}}
SEEDS = (1, 2, 3)
MODELS = {"rf": RandomForestRegressor, "gbt": GBTRegressor}
EMBARGO_DAYS = 30


def labels(f: DataFrame, forward: DataFrame) -> DataFrame:
    """Features with the forward return, less its mean on the date, as label; rows without it can be predicted, not learnt from."""
    return f.join(forward.select(F.col("date").alias("asof"), "ticker", "fwd"), ["asof", "ticker"], "left").withColumn("label", demean("fwd", "asof"))


def split(rows: DataFrame, at, years: int, resolved_days: int, embargo: int = EMBARGO_DAYS) -> tuple[DataFrame, DataFrame]:
    """Training rows of the last `years` whose label was known `embargo` days before `at`, and the rows of that date."""
    d = F.lit(at).cast("date")
    known = F.date_add("asof", resolved_days + embargo) <= d
    return rows.where(known & (F.col("asof") >= F.add_months(d, -12 * years)) & F.col("label").isNotNull()), rows.where(F.col("asof") == d)


def configurations(kind: str, grid: dict | None = None) -> list[dict]:
    g = grid or GRIDS[kind]
    return [dict(zip(g, v, strict=True)) for v in product(*g.values())]


def ensemble(train: DataFrame, test: DataFrame, columns: list[str], kind: str = "rf", seeds=SEEDS, grid: dict | None = None) -> DataFrame:
    """(asof, ticker, score): the mean prediction of every configuration and seed. Fitting is Spark's own, over all rows."""
    pack = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    fill = {c: 0.5 for c in columns}
    x, y = pack.transform(train.fillna(fill)).select("features", "label").cache(), pack.transform(test.fillna(fill)).select("asof", "ticker", "features")
    total, n = None, 0
    for cfg in configurations(kind, grid):
        for seed in seeds:
            m = MODELS[kind](featuresCol="features", labelCol="label", predictionCol=f"p{n}", seed=seed, **cfg).fit(x)
            y, n = m.transform(y), n + 1
            total = F.col(f"p{n - 1}") if total is None else total + F.col(f"p{n - 1}")
    out = y.select("asof", "ticker", (total / n).alias("score"))
    x.unpersist()
    return out


def walk_forward(rows: DataFrame, dates: list, columns: list[str], kind: str = "rf", years: int = 5, resolved_days: int = 90, seeds=SEEDS, grid: dict | None = None) -> DataFrame | None:
    """Scores for each date by models that learnt only what was known before it; dates are the rebalance calendar, a short list."""
    out = None
    for d in dates:
        train, test = split(rows, d, years, resolved_days)
        if train.isEmpty():
            continue
        one = ensemble(train, test, columns, kind, seeds, grid)
        out = one if out is None else out.unionByName(one)
    return out


def score_weights(scores: DataFrame, by: str = "asof", names: int = 20) -> DataFrame:
    """Weights in proportion to the ranks of the best scores on each date."""
    s = scores.withColumn("__r", unit_rank("score", by))
    top = latest(s, by, [F.desc("__r"), "ticker"], names)
    return top.select(by, "ticker", F.try_divide(F.col("__r"), F.sum("__r").over(Window.partitionBy(by))).alias("weight"))


def sequences(f: DataFrame, columns: list[str], months: int = 12) -> DataFrame:
    """(asof, ticker, seq): each name's feature rows of the last `months` as-of dates, only where all of them are there."""
    w = Window.partitionBy("ticker").orderBy("asof").rowsBetween(-(months - 1), 0)
    cal = f.select("asof").distinct().withColumn("i", F.row_number().over(Window.orderBy("asof")))
    x = f.join(F.broadcast(cal), "asof").withColumn("seq", F.collect_list(F.array(*[F.coalesce(F.col(c), F.lit(0.5)) for c in columns])).over(w)).withColumn("__first", F.min("i").over(w))
    return x.where((F.size("seq") == months) & (F.col("i") - F.col("__first") == months - 1)).select("asof", "ticker", "seq")
