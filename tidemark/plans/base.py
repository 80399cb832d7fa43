"""Registration and shared inputs of the queries on the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: str = ""):
    """Registers a function (t) -> DataFrame under its name, t reading tables by attribute, with its SQL.

    dates: columns returned as text, YYYY-MM-DD, by both.
    """
    names = dates.split()

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.withColumns({c: F.date_format(F.col(c), "yyyy-MM-dd") for c in names}) if names else out

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return f

    return wrap


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def bars(t: Tables) -> DataFrame:
    """Daily bars of each part type's first word: price is the unit price of a line, volume its quantity."""
    l = t.lineitem.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", "l_partkey")
    x = l.join(t.part.select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
    o = F.struct("l_orderkey", "l_linenumber")
    return x.groupBy("ticker", "date").agg(F.min_by("p", o).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", o).alias("close"), F.sum("l_quantity").alias("volume"))


BARS = """bars AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
 arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice / l_quantity) AS high,
 min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def dense(t: Tables, groups: int = 8) -> DataFrame:
    """Daily bars of eight groups of suppliers (or as many as are wanted), which trade nearly every day."""
    o = F.struct("l_orderkey", "l_linenumber")
    x = t.lineitem.withColumn("p", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("ticker", F.concat(F.lit("S"), (F.col("l_suppkey") % groups).cast("string")))
    return x.groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(F.min_by("p", o).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", o).alias("close"), F.sum("l_quantity").alias("volume"))


DENSE = """bars AS (SELECT 'S' || CAST(l_suppkey % 8 AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
 arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice / l_quantity) AS high,
 min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume
 FROM lineitem GROUP BY 1, 2)"""


def returns(t: Tables) -> DataFrame:
    """Monthly log returns of order volume by market segment: (ticker, date, r)."""
    from pyspark.sql import Window

    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date(F.trunc("o_orderdate", "month")).alias("date")).agg(F.avg("o_totalprice").alias("v"))
    w = Window.partitionBy("ticker").orderBy("date")
    return m.withColumn("r", F.ln(F.col("v") / F.lag("v").over(w))).where("r IS NOT NULL").select("ticker", "date", "r")


RETURNS = """mv AS (SELECT c_mktsegment AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
ret AS (SELECT ticker, date, r FROM (SELECT ticker, date, ln(v / lag(v) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM mv) WHERE r IS NOT NULL)"""
