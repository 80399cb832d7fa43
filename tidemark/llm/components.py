"""Connected components of an edge table, by alternating large stars and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b: long); root is the component's smallest node.

    Each round points every larger neighbour of a node at the node's smallest neighbour, then every node and its smaller
    neighbours at the smallest of these. Rounds go down as the logarithm of the number of nodes. Minima are combined
    before they are shuffled, and what is joined back is one row a node, so a hub is a skewed join that Spark can split. Each round is a written table, removed
    after the next.
    """
    links, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct()
        old = path
        links, path = written(small)
        forget(edges.sparkSession, old)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
