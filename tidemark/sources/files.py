"""File sources and sinks: Parquet, delimited text, archives, nested JSON, page links, generated data."""

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.semantics import col


def parquet(spark: SparkSession, *paths: str, base: str | None = None, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Files, globs or partitioned folders; with columns, those that are there."""
    reader = spark.read
    if base:
        reader = reader.option("basePath", base)
    if schema:
        reader = reader.schema(schema)
    df = reader.parquet(*paths)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def tsv(spark: SparkSession, path: str, names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Tab-separated text, every column a string, quotes ordinary characters, malformed rows dropped; names for files without a header."""
    r = spark.read.option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED")
    df = r.schema(", ".join(f"`{n}` string" for n in names)).csv(path) if names else r.option("header", True).csv(path)
    return df.select(*keep) if keep else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """A review file: one CSV with a header, in order. For small results."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    w = df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).parquet(path)


def unzip(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, line): lines of the member whose name ends with `member`, for every archive of a glob.

    Archives are read by Spark and opened where they are read; lines go on in batches.
    """
    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in (m for m in z.namelist() if m.lower().endswith(member.lower())):
                        with z.open(m) as f:
                            held: list[str] = []
                            for line in io.TextIOWrapper(f, "utf-8", errors="replace", newline=None):
                                held.append(line.rstrip("\n"))
                                if len(held) == 50_000:
                                    yield pd.DataFrame({"archive": name, "line": held})
                                    held = []
                            if held:
                                yield pd.DataFrame({"archive": name, "line": held})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, line string")


def zipped_tsv(spark: SparkSession, path: str, member: str, names: list[str]) -> DataFrame:
    """Columns of a member's lines by position; header lines (equal to the names) are dropped."""
    parts = F.split("line", "\t")
    rows = unzip(spark, path, member).select("archive", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows.where(F.upper(F.col(names[0])) != names[0].upper())


FACT = "array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>"


def company_facts(documents: DataFrame, raw: str = "raw_json") -> DataFrame:
    """(company, tax, tag, unit, start, end, val, accn, fy, fp, form, filed) of nested fact documents (company, raw_json)."""
    d = documents.select("company", F.from_json(col(raw), f"facts map<string,map<string,struct<units:map<string,{FACT}>>>>").alias("d"))
    d = d.select("company", F.explode("d.facts").alias("tax", "tags")).select("company", "tax", F.explode("tags").alias("tag", "t"))
    d = d.select("company", "tax", "tag", F.explode("t.units").alias("unit", "f")).select("company", "tax", "tag", "unit", F.inline("f"))
    return d.withColumns({c: F.to_date(c) for c in ("start", "end", "filed")})


def columnar_rows(documents: DataFrame, raw: str, path: str, names: list[str]) -> DataFrame:
    """Rows of a JSON object of parallel arrays: one row for each position."""
    schema = ", ".join(f"{n} array<string>" for n in names)
    body = F.from_json(F.get_json_object(col(raw), path), schema)
    return documents.withColumn("__b", body).select(*documents.columns, F.inline(F.arrays_zip(*[F.col(f"__b.{n}") for n in names])))


def links(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """pages with link: every href that matches the pattern."""
    found = F.regexp_extract_all(col(html), F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), 1)
    return pages.withColumn("link", F.explode(F.filter(found, lambda x: x.rlike(pattern))))


def static_table(spark: SparkSession, groups: dict[str, tuple[str, dict[str, str]]]) -> DataFrame:
    """(ticker, name, asset_class, group_name) of configured dictionaries: group -> (asset class, {ticker: name})."""
    return spark.createDataFrame([(t, n, a, g) for g, (a, d) in groups.items() for t, n in d.items()], "ticker string, name string, asset_class string, group_name string")


def demo_prices(spark: SparkSession, tickers: list[str], days: int, start: str = "2020-01-01", seed: int = 1) -> DataFrame:
    """Random walks: a name's log price is the running sum of normal steps."""
    from pyspark.sql import Window

    d = spark.range(days).select(F.expr(f"date_add(date'{start}', CAST(id AS INT))").alias("date"), F.col("id").alias("i")).where(F.weekday("date") < 5)
    t = spark.createDataFrame([(x, k) for k, x in enumerate(tickers)], "ticker string, k int")
    # a uniform from a hash of name and day, made normal by Box and Muller: the same on any number of partitions
    u = lambda s: (F.pmod(F.xxhash64("ticker", "date", F.lit(seed + s)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    z = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.crossJoin(F.broadcast(t)).select("ticker", "date", (100 * F.exp(F.sum(0.0003 + 0.012 * z).over(w))).alias("close"))


def table_status(spark: SparkSession, tables: dict[str, DataFrame], day: dict[str, str]) -> DataFrame:
    """(name, rows, latest) of several tables as one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"), (F.max(day[name]) if name in day else F.lit(None)).cast("string").alias("latest")).select(F.lit(name).alias("name"), "rows", "latest")
        out = one if out is None else out.unionByName(one)
    return out


def primary_keys(spark: SparkSession) -> DataFrame:
    """Keys of the tables of the data model (Spark doesn't keep any)."""
    return spark.createDataFrame(sorted(PRIMARY_KEYS.items()), "name string, key array<string>")


PRIMARY_KEYS = {
    "instruments": ["ticker"], "prices_daily": ["ticker", "date"], "fx_rates_daily": ["currency", "date"], "macro_series": ["series_id"], "macro_observations": ["series_id", "date"], "intraday_state": ["ticker"],
    "market_cap_daily": ["corporate_id", "date"], "corporate_actions": ["ticker", "date"], "clinical_trials": ["nct_id"], "clinical_trial_sponsors": ["nct_id", "sponsor_name"], "company_info": ["corporate_id"],
    "fundamentals_quarterly": ["corporate_id", "fiscal_year", "fiscal_quarter"], "fundamentals_yearly": ["corporate_id", "fiscal_year"], "sec_filings": ["accession_no"], "processed_datasets": ["dataset"],
    "fundamentals_state": ["corporate_id"], "trial_searches": ["term"], "insider_transactions_raw": ["accession_no", "trans_sk", "owner_cik"]}
