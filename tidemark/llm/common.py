"""Shared pieces: words, digests, tables, materialised cuts and row keys."""

import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Words are runs of anything but these six characters; bytes.split() cuts at exactly them.
SPACE = " \t\n\x0b\f\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; a null text has none."""
    return text.encode().split() if text else []


def lower_ascii(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(c):
    """Words of a whole text, counted in the JVM: starts of runs after every space character became a blank."""
    t = F.translate(F.coalesce(c, F.lit("")), SPACE[1:], " " * 5)
    return F.size(F.filter(F.split(t, " "), lambda w: w != "")).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a folder of our own only where none is named and all runs in one process."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path, for forget() once nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a table of written()."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_key(*cols):
    """A 128-bit digest of the columns as a struct of two longs: the second hash starts from another state."""
    return F.struct(F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(0x5EED), *cols).alias("h2"))


#: Texts that a worker function sees at a time.
BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, if it has more.

    Batches of ten thousand texts take several hundred megabytes of an executor, on both sides. Spark reads the setting when a
    plan runs, which may be after an operator has returned, so it stays; a caller can set it back once the result is written.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def pieces(batch, *names: str):
    """Lists of the named columns' values for at most BATCH_ROWS rows of an Arrow batch at a time."""
    cols = [batch.column(n) for n in names]
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield [c.slice(at, BATCH_ROWS).to_pylist() for c in cols]


#: Caches of a worker's functions by function, to be emptied when the worker is given to another function.
_CACHES: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    return _CACHES.setdefault(name, {})


def starts(name: str) -> None:
    """A worker function begins: what other functions left in this worker goes, as Spark gives workers from stage to stage."""
    others = [c for n, c in _CACHES.items() if n != name and c]
    if others:
        for c in others:
            c.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def text_udf(kind: str, cache: str = ""):
    """Makes fn(list, ...) -> list a column function over Arrow arrays; for a kind with names, fn gives a tuple a row.

    Batches are cut to BATCH_ROWS rows, so that a worker never holds many texts as objects. cache: the worker cache that fn keeps.
    """
    spark_type = _parse_datatype_string(kind)
    arrow = to_arrow_type(spark_type)

    def array(values: list) -> pa.Array:
        if not pa.types.is_struct(arrow):
            return pa.array(values, arrow)
        cols = zip(*values, strict=True) if values else [[] for _ in arrow]
        return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], fields=list(arrow))

    def wrap(fn):
        def cut(*cols):
            starts(cache)
            return pa.concat_arrays([array(fn(*[c.slice(at, BATCH_ROWS).to_pylist() for c in cols])) for at in range(0, max(1, len(cols[0])), BATCH_ROWS)])

        if fn.__code__.co_argcount == 1:
            def run(a: pa.Array) -> pa.Array:
                return cut(a)
        else:
            def run(a: pa.Array, b: pa.Array) -> pa.Array:
                return cut(a, b)
        return F.arrow_udf(run, spark_type)

    return wrap


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
