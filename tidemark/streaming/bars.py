"""Streams: windowed bars with a watermark, keep-last dedup, upserts by batch, recursive state, change feeds."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes that a source may still change.
LATE = "16 minutes"


def event_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_bars(events: DataFrame, by: str, ts: str, price: str, volume: str, width: str = "1 hour", offset: str = "30 minutes", late: str = LATE, tie: tuple[str, ...] = ()) -> DataFrame:
    """Bars that are final once the watermark has passed their end; later rows are dropped, as the bars are closed."""
    w = F.window(ts, width, width, offset)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), by)
    order = F.struct(ts, *tie)
    b = g.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("n"))
    return b.select(by, F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume", "n")


def keep_last(events: DataFrame, key: list[str], ts: str, order: str, late: str = LATE) -> DataFrame:
    """The last row of each key and time by `order`; dropDuplicates would keep the first."""
    rest = [c for c in events.columns if c not in (*key, ts)]
    g = events.withWatermark(ts, late).groupBy(*key, F.window(ts, "1 minute").alias("__w"), ts).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return g.select(*key, ts, *[F.col(f"r.{c}").alias(c) for c in rest])


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that is there now, as a table: written to `folder` by a streaming query that stops at the end of its input."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def upsert_to(path: str, key: list[str], order: str, partition: str | None = None):
    """A foreachBatch function that merges a batch into a Parquet table: one row a key, the last by order.

    Each batch writes a new version beside the old one and then moves the pointer, so a batch run again gives the same table.
    """
    from tidemark.operators.upsert import dedupe

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch_id - 1
        both = batch
        if last >= 0:
            both = spark.read.parquet(f"{path}/v{last}").unionByName(batch, allowMissingColumns=True)
        w = dedupe(both, key, order).write.mode("overwrite")
        (w.partitionBy(partition) if partition else w).parquet(f"{path}/v{batch_id}")

    return run


def current(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{batch_id}")


def stateful_hysteresis(events: DataFrame, by: str, ts: str, value: str, bull: float, bear: float) -> DataFrame:
    """(by, ts, state): the state of each key carried from batch to batch; rows of a batch in order of time."""

    def run(key, batches, state: GroupState):
        now = state.get[0] if state.exists else 1
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for t, v in zip(rows[ts], rows[value], strict=True):
            now = 2 if v >= bull else 0 if v <= bear else 1 if (now == 2 and v < bull) or (now == 0 and v > bear) else now
            out.append((key[0], t, now))
        state.update((now,))
        yield pd.DataFrame(out, columns=[by, ts, "state"])

    kinds = dict(events.dtypes)
    return events.groupBy(by).applyInPandasWithState(run, f"{by} {kinds[by]}, {ts} {kinds[ts]}, state int", "state int", "append", GroupStateTimeout.NoTimeout)


def stateful_versions(events: DataFrame, by: str, ts: str, content: str) -> DataFrame:
    """(by, ts, version, hash): a row whenever a key's content differs from the one before."""

    def run(key, batches, state: GroupState):
        version, last = state.get if state.exists else (0, "")
        out = []
        for t, h in pd.concat(list(batches)).sort_values(ts)[[ts, "hash"]].itertuples(index=False):
            if h != last:
                version, last = version + 1, h
                out.append((key[0], t, version, h))
        state.update((version, last))
        yield pd.DataFrame(out, columns=[by, ts, "version", "hash"])

    kinds = dict(events.dtypes)
    hashed = events.select(by, ts, F.sha2(content, 256).alias("hash"))
    return hashed.groupBy(by).applyInPandasWithState(run, f"{by} {kinds[by]}, {ts} {kinds[ts]}, version int, hash string", "version int, hash string", "append", GroupStateTimeout.NoTimeout)
