"""Sources, sinks and streams."""

import json
import zipfile

from pyspark.sql import functions as F

from tidemark.sources import files, paged
from tidemark.streaming import bars

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_delimited_and_archives(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('A\tB\n1\t"x\n2\ty\n')
    assert [(r.A, r.B) for r in files.tsv(spark, str(tmp_path / "a.tsv")).orderBy("A").collect()] == [("1", '"x'), ("2", "y")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("q/INFO.tsv", "ACC\tN\na\t1\nb\t2\n")
    assert {(r.acc, r.n) for r in files.zipped_tsv(spark, str(tmp_path / "*.zip"), "info.tsv", ["acc", "n"]).collect()} == {("a", "1"), ("b", "2")}


def test_nested_facts(spark):
    doc = json.dumps({"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2020-12-31", "val": 5, "accn": "k", "fy": 2020, "fp": "FY", "form": "10-K", "filed": "2021-02-01"}]}}}}})
    r = files.company_facts(spark.createDataFrame([(1, doc)], "company int, raw_json string")).collect()
    assert [(x.tax, x.tag, x.unit, str(x.end), x.val, x.start) for x in r] == [("us-gaap", "Assets", "USD", "2020-12-31", 5.0, None)]


def test_parallel_arrays_and_links(spark):
    d = spark.createDataFrame([(1, json.dumps({"recent": {"a": ["x", "y"], "b": ["1", "2"]}}))], "k int, raw string")
    assert [(r.a, r.b) for r in files.columnar_rows(d, "raw", "$.recent", ["a", "b"]).collect()] == [("x", "1"), ("y", "2")]
    p = spark.createDataFrame([("<a href='/f/2020q1.zip'>x</a><a href=\"/other\">y</a>",)], "html string")
    assert [r.link for r in files.links(p, "html", r"\.zip$").collect()] == ["/f/2020q1.zip"]


def test_paged_source(spark, tmp_path):
    for name, body in {"A.0": {"rows": [{"date": "2020-01-01", "value": 1.0}], "next": 1}, "A.1": {"rows": [{"date": "2020-01-02", "value": 2.0}], "next": None}, "B.0": {"rows": [{"date": "2020-01-01", "value": 9.0}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    paged.register(spark)
    rows = spark.read.format("paged").option("path", str(tmp_path)).load().collect()
    assert sorted((r.key, r.date, r.value) for r in rows) == [("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0), ("B", "2020-01-01", 9.0)]


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    files.write_parquet(spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string"), p, ["k"], "overwrite")
    files.write_parquet(spark.createDataFrame([(3, "b")], "x int, k string"), p, ["k"], "overwrite")
    assert sorted((r.x, r.k) for r in files.parquet(spark, p).collect()) == [(1, "a"), (3, "b")]


def _events(spark, tmp_path):
    rows = [(1, "2024-01-01 10:31:00", 1, "a", 10.0), (2, "2024-01-01 10:40:00", 1, "a", 12.0), (3, "2024-01-01 11:35:00", 1, "a", 9.0), (4, "2024-01-01 14:00:00", 1, "a", 11.0)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp")).withColumn("props", F.lit("{}"))
    df.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "e"))
    return bars.event_stream(spark, str(tmp_path / "e"), EVENTS)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_stream_bars(spark, tmp_path):
    got = _drain(bars.stream_bars(_events(spark, tmp_path), "event_type", "ts", "value", "user_id"), "bars_out")
    assert sorted((r.bar.strftime("%H:%M"), r.open, r.high, r.low, r.close, r.n) for r in got) == [("10:30", 10.0, 12.0, 10.0, 12.0, 2), ("11:30", 9.0, 9.0, 9.0, 9.0, 1)]


def test_stream_state(spark, tmp_path):
    got = _drain(bars.stateful_hysteresis(_events(spark, tmp_path), "event_type", "ts", "value", 12.0, 9.5), "states_out")
    assert [r.state for r in sorted(got, key=lambda r: r.ts)] == [1, 2, 0, 1]


def test_stream_versions(spark, tmp_path):
    got = _drain(bars.stateful_versions(_events(spark, tmp_path), "user_id", "ts", "event_type"), "versions_out")
    assert [(r.user_id, r.version) for r in got] == [(1, 1)]


def test_batch_upsert(spark, tmp_path):
    put = bars.upsert_to(str(tmp_path / "u"), ["k"], "o")
    put(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string"), 0)
    put(spark.createDataFrame([(1, 2, "c")], "k int, o int, v string"), 1)
    put(spark.createDataFrame([(1, 2, "c")], "k int, o int, v string"), 1)
    assert sorted((r.k, r.v) for r in bars.current(spark, str(tmp_path / "u"), 1).collect()) == [(1, "c"), (2, "b")]
