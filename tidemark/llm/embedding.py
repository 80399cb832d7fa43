"""Embedding near-dedup: exact threshold pairs by cover trees and dual traversal.

Equal vectors of a label are one class. A label's classes fall into cells, each class to its nearest pivot; a class also
visits a later cell whose covering radius lets it hold a vector within the threshold. Cells and their visitors are cut into
blocks of bounded size; only blocks that have visitors meet them. Each task builds cover trees of the two blocks it has and
traverses both. A task returns a count for each class and a spanning forest of its links, never a list of pairs.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, own_names, row_key
from tidemark.llm.components import components
from tidemark.llm.covertree import SLACK, linked

#: Classes of a block, about; a label has a pivot for each so many classes, MAX_PIVOTS at most (cells are larger beyond that).
BLOCK, MAX_PIVOTS = 2048, 1024
#: Classes that one task compares with a label's pivots.
GROUP = 16_384
KEY = ["label", "size"]


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1)[:, None]


def _cells(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """The nearest pivot of each class and the distance to it."""
    pivots = pivots.sort_values("cell")
    if not len(rows):
        return pd.DataFrame({c: [] for c in ("label", "size", "cid", "n", "vec", "bucket", "cell", "far")})
    cos = _unit(rows["vec"]) @ _unit(pivots["vec"]).T
    at = cos.argmax(axis=1)
    far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos[np.arange(len(at)), at]))
    return rows[["label", "size", "cid", "n", "vec", "bucket"]].assign(cell=pivots["cell"].to_numpy()[at], far=far)


def _visitors(cosine: float):
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        """A row for each later cell that may hold a vector within the threshold of a class."""
        pivots, cols = pivots.sort_values("cell"), ["label", "size", "cid", "n", "vec"]
        if not len(rows):
            return pd.DataFrame({c: [] for c in (*cols, "cell")})
        cell = pivots["cell"].to_numpy()
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_unit(rows["vec"]) @ _unit(pivots["vec"]).T)))
        who, where = np.nonzero((away <= pivots["radius"].to_numpy()[None, :] + reach + SLACK) & (cell[None, :] > rows["cell"].to_numpy()[:, None]) & (pivots["count"].to_numpy() > 0)[None, :])
        return rows[cols].iloc[who].assign(cell=cell[where])

    return run


def _units(celled: DataFrame, visitors: DataFrame, block: int) -> DataFrame:
    """(label, size, cell, kind, a, b, side, cid, n, vec): each class once for every pair of blocks that it is part of.

    kind 0 pairs the blocks of a cell with each other, kind 1 with blocks of the cell's visitors.
    """
    cols = [*KEY, "cell", "kind", "a", "b", "side", "cid", "n", "vec"]
    many = celled.groupBy(*KEY, "cell").agg(F.ceil(F.count("*") / (2 * block)).alias("blocks"))
    guests = visitors.groupBy(*KEY, "cell").agg(F.ceil(F.count("*") / (2 * block)).alias("chunks"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    home = celled.join(many, [*KEY, "cell"]).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("blocks")))
    inside = home.withColumn("other", up_to("blocks")).withColumns({"kind": F.lit(0), "a": F.least("own", "other"), "b": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    hosts = home.join(guests, [*KEY, "cell"]).withColumn("b", up_to("chunks")).withColumns({"kind": F.lit(1), "a": F.col("own"), "side": F.lit(0)})
    come = visitors.join(many, [*KEY, "cell"]).join(guests, [*KEY, "cell"]).withColumn("a", up_to("blocks"))
    come = come.withColumns({"kind": F.lit(1), "b": F.pmod(F.xxhash64("cid", F.lit(2)), F.col("chunks")), "side": F.lit(1)})
    return inside.select(*cols).union(hosts.select(*cols)).union(come.select(*cols))


def deal(classes: DataFrame, cosine: float, block: int) -> DataFrame:
    """The units of all labels. classes: label, size, cid, n, vec. A label of at most `block` classes is one cell."""
    counts = classes.groupBy(*KEY).agg(F.count("*").alias("total"), F.min("cid").alias("least"))
    named = classes.join(counts, KEY)
    one = named.where(F.col("total") <= block).select(*KEY, F.lit(0).cast("long").alias("cell"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("side"), "cid", "n", "vec")
    large = named.where(F.col("total") > block).withColumn("buckets", F.ceil(F.col("total") / GROUP)).withColumn("bucket", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("buckets")))
    every = F.greatest(F.lit(block).cast("long"), F.ceil(F.col("total") / MAX_PIVOTS))
    pivots = large.where((F.col("cid") == F.col("least")) | (F.pmod(F.xxhash64("cid"), every) == 0))
    pivots = pivots.select(*KEY, "vec", "buckets", (F.row_number().over(Window.partitionBy(*KEY).orderBy("cid")) - 1).cast("long").alias("cell"))  # some MAX_PIVOTS rows a label
    pivots = checkpointed(pivots)
    own_columns = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    spread = lambda df: own_columns(df.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))).groupBy(*KEY, "bucket")
    schema = "label string, size long, cid long, n long, vec array<double>"
    celled = large.groupBy(*KEY, "bucket").cogroup(spread(pivots)).applyInPandas(_cells, f"{schema}, bucket long, cell long, far double")
    celled = checkpointed(celled)
    seen = celled.groupBy(*KEY, "cell").agg(F.max("far").alias("radius"), F.count("*").alias("count"))
    shaped = pivots.join(seen, [*KEY, "cell"], "left").fillna({"radius": 0.0, "count": 0})
    visitors = checkpointed(celled.groupBy(*KEY, "bucket").cogroup(spread(shaped)).applyInPandas(_visitors(cosine), f"{schema}, cell long"))
    return one.union(_units(celled, visitors, block))


def _traverse(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, same = int(pdf["kind"].iloc[0]), int(pdf["kind"].iloc[0]) == 0 and int(pdf["a"].iloc[0]) == int(pdf["b"].iloc[0])
        pdf = pdf.sort_values(["side", "cid"], ignore_index=True)
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if same or len(left) and len(right):
            xa, wa = _unit(left["vec"].to_numpy()), left["n"].to_numpy(dtype=np.int64)
            xb, wb = (None, None) if same else (_unit(right["vec"].to_numpy()), right["n"].to_numpy(dtype=np.int64))
            na, nb, edges = linked(xa, wa, xb, wb, cosine)
            cid = (left if same else pdf)["cid"].to_numpy(dtype=np.int64)
            n = na if same else np.concatenate([na, nb])
            some = np.flatnonzero(n)
            out += [(0, int(cid[i]), int(n[i])) for i in some]
            out += [(1, int(cid[i]), int(cid[j])) for i, j in edges]
        return pd.DataFrame(out, columns=["what", "x", "y"], dtype="int64")

    return run


def _linked_rows(rows: DataFrame, cosine: float = 0.93, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Every row's id, a digest of its id, label and vector, links and component."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    key, label = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("string")
    src = rows.select(key.alias("id"), row_key(key, label, vec).alias("row"), label.alias("label"), vec.alias("vec"))
    fine = (F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
            & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0))
    src = src.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("key", F.xxhash64("label", "vec"))
    classes = src.where("fine").groupBy("label", "key", "vec").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.size("vec").cast("long")))
    units = deal(classes.select(*KEY, "cid", "n", "vec"), cosine, block)
    found = checkpointed(units.groupBy("label", "size", "cell", "kind", "a", "b").applyInPandas(_traverse(cosine), "what long, x long, y long"))
    links = found.where("what = 0").groupBy(F.col("x").alias("cid")).agg(F.sum("y").alias("links"))
    roots = components(found.where("what = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "cid")
    known = classes.select("cid", "label", "key", "vec", "first", "n").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    low = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(low, "root").select("label", "key", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    good = src.where("fine").join(known, ["label", "key", "vec"]).select("id", "row", "n_links", "component_id")
    rest = src.where("NOT fine").select("id", "row", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest)


def embedding_links(rows: DataFrame, cosine: float = 0.93, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least `cosine`. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Copies count as links. component_id is the smallest id reachable; a row with a null id takes part, and without
    any id in its component gets null; kept is true where it is the row's own id. An empty table gives no rows.
    """
    out = _linked_rows(rows, cosine, block, id_col, vector_col, label_col)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """rows without those that a chain of links ties to one with a smaller id; all columns are kept.

    Of rows with equal id, label and vector one stays. Rows without an id stay only where no row tied to them has one, and then
    all do but repeated ones, as no id orders them. Vectors that link with nothing stay.
    """
    digest, = own_names(rows, "row_key")
    key, label, vec = F.col(f"`{id_col}`").cast("long"), F.col(f"`{label_col}`").cast("string"), F.col(f"`{vector_col}`").cast("array<double>")
    keep = _linked_rows(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, **options).where(F.col("id").eqNullSafe(F.col("component_id")))
    keep = keep.groupBy("row").agg(F.count("*").alias("n"))
    keyed, cols = rows.withColumn(digest, row_key(key, label, vec)), [F.col(f"`{c}`") for c in rows.columns]
    once = keyed.join(keep.where("n = 1").select(F.col("row").alias(digest)), digest, "left_semi").select(*cols)
    more = keyed.join(keep.where("n > 1").select(F.col("row").alias(digest)), digest, "left_semi").dropDuplicates([digest]).select(*cols)
    return once.unionByName(more)
