"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Row i of the matrix says how many rows input partition i sends to each cell; a shard is a run of cells. Rows of the matrix
come from a splitting tree whose nodes are seeded, so each task draws its own row and no matrix is held anywhere. A
partition's rows meet the cells in random order (first permutation), are exchanged, and are permuted again in their cell.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, own_names, text_batches
from tidemark.llm.hypergeom import generator, split_path

#: Rows of a cell, about: what one task sorts after the exchange.
CELL_ROWS = 200_000


def layout(rows: int, n_shards: int, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of all cells, their shards, and the slot at which each begins; shards differ by one row at most."""
    per = max(1, -(-rows // (n_shards * cell_rows)))
    sizes, shards, first = [], [], []
    for s in range(n_shards):
        own = rows // n_shards + (s < rows % n_shards)
        at = 0
        for c in range(per):
            n = own // per + (c < own % per)
            sizes.append(n)
            shards.append(s)
            first.append(at)
            at += n
    return np.array(sizes, dtype=np.int64), np.array(shards, dtype=np.int64), np.array(first, dtype=np.int64)


def shard_uniform(docs: DataFrame, n_shards: int = 16, seed: int = 8, cell_rows: int = CELL_ROWS) -> DataFrame:
    """docs with shard (int) and slot (long, gapless from 0 in each shard); any shuffle of the rows is equally likely.

    The input is written once to the shared checkpoint folder, so that a task run again sees the same partition. Any
    columns, nulls and repeated rows are carried as they are; columns named shard and slot are replaced. An empty table
    gives no rows. Fewer rows than shards leave shards empty.
    """
    text_batches(docs)
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    held = checkpointed(docs.select(*[F.col(f"`{c}`") for c in keep]))
    counts = dict(held.groupBy(F.spark_partition_id().alias("p")).count().collect())
    parts = np.array([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)], dtype=np.int64)
    sizes, shards, first = layout(int(parts.sum()), n_shards, cell_rows)
    cell, order, cell_of, shard_of, first_of = own_names(held, "cell", "order_key", "cell_of", "shard_of", "first_of")

    def deal(batches):
        p = TaskContext.get().partitionId()
        if p >= len(parts) or not parts[p]:
            return
        row = split_path(sizes, parts, p, seed)
        rng = generator(seed, 1, p)
        to = np.repeat(np.arange(len(sizes), dtype=np.int32), row)
        rng.shuffle(to)
        at = 0
        for batch in batches:
            n = batch.num_rows
            yield batch.append_column(cell, pa.array(to[at : at + n])).append_column(order, pa.array(rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)))
            at += n

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    dealt = held.mapInArrow(deal, f"{fields}, {cell} int, {order} long")
    w = Window.partitionBy(cell).orderBy(order)
    spark = docs.sparkSession
    where = spark.createDataFrame(pd.DataFrame({cell_of: np.arange(len(sizes)), shard_of: shards, first_of: first}), f"{cell_of} int, {shard_of} int, {first_of} long")
    ranked = dealt.withColumn(order, F.row_number().over(w) - 1).join(where, F.col(cell) == F.col(cell_of))
    return ranked.select(*[F.col(f"`{c}`") for c in keep], F.col(shard_of).alias("shard"), (F.col(order) + F.col(first_of)).alias("slot"))


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: rows' law, counts at most one apart. Null texts are empty.

    The texts themselves are sharded; size and text_crc32 are read from the rows that come out.
    """
    out = shard_uniform(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), **options)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
