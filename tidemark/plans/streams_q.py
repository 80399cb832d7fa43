"""Streaming queries over the events table, run to the end of their input."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from tidemark.plans.base import query
from tidemark.streaming import bars


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "tidemark-streams")
    return f"{base}/{uuid.uuid4().hex}"


@query("""WITH l AS (SELECT max(ts) - INTERVAL 16 MINUTE AS mark FROM events), b AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 30 MINUTE) AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(user_id)::BIGINT AS volume, count(*)::BIGINT AS n FROM events GROUP BY 1, 2)
SELECT event_type, strftime(bar, '%Y-%m-%d %H:%M') AS bar, open, high, low, close, volume, n FROM b, l WHERE bar + INTERVAL 1 HOUR <= mark""")
def stream_bars(t):
    """Hourly bars that the watermark has closed."""
    schema = t.events.select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").schema
    raw = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    events = raw.withColumn("ts", F.col("ts").cast("timestamp")).select(*schema.names)
    out = bars.run_once(bars.stream_bars(events, "event_type", "ts", "value", "user_id", tie=("event_id",)), _folder(t.spark))
    return out.withColumn("bar", F.date_format("bar", "yyyy-MM-dd HH:mm"))


@query("""WITH l AS (SELECT user_id, ts, event_id, sha256(event_type) AS h, lag(sha256(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, count(*)::BIGINT AS versions FROM l WHERE h IS DISTINCT FROM p GROUP BY 1""")
def stream_versions(t):
    """How often each user's event type changed, by a stateful feed of versions."""
    raw = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    events = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    out = bars.run_once(bars.stateful_versions(events, "user_id", "ts", "event_type"), _folder(t.spark))
    return out.groupBy("user_id").agg(F.count("*").alias("versions"))
