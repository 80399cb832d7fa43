"""Mixing sources to target weights.

A source's documents fall into blocks by a hash. Whole passes over a source and a random set of its blocks make up its
target; exchanges of blocks then bring the set nearer to it. A splitting tree of multivariate hypergeometric
draws deals each source's exact number of block copies to the output shards; the shards then take disjoint runs of the
source's permuted block copies, and rows are shuffled inside their shard.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, own_names, row_key
from tidemark.llm.hypergeom import generator, split_all

#: Weights of the sources in code point order, null last; the list repeats.
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources are the mix's own list; with n_blocks blocks each they bound what the driver plans and what is broadcast.
MAX_SOURCES = 1000
#: Words that one task shuffles, about.
CELL_WORDS = 16_000_000
#: Changes to a random set of blocks at most.
CHANGES = 32


def targets(sizes: list[int], weights: list[float], limit: float = 3.0) -> list[float]:
    """Share all of sum(sizes) by weight; what lies above limit times a source's size goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], total
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = limit * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass
class Plan:
    """What a mix takes: the shards of each copy of each (source, block)."""

    sources: dict = field(default_factory=dict)  # source -> (size, target)
    blocks: list = field(default_factory=list)  # (source, block, shards of its copies)
    words: float = 0.0


def choose_blocks(sizes: np.ndarray, need: float, rng: np.random.Generator) -> np.ndarray:
    """Positions of a random set of blocks with nearly `need` words.

    Blocks are taken in random order while they fit. Then the change that comes nearest is made, as long as one does: a block
    more, a block less, or one for another. Many blocks have many differences, so what is left is a tiny part of a block.
    """
    taken = np.zeros(len(sizes), dtype=bool)
    for j in rng.permutation(len(sizes)):
        if sizes[j] <= need:
            taken[j] = True
            need -= sizes[j]
    for _ in range(CHANGES):
        out, more = np.r_[-1, np.flatnonzero(taken)], np.r_[-1, np.flatnonzero(~taken)]  # -1: none
        gain = np.where(more < 0, 0, sizes[more])[None, :] - np.where(out < 0, 0, sizes[out])[:, None]
        i, j = np.unravel_index(np.abs(need - gain).argmin(), gain.shape)
        if abs(need - gain[i, j]) >= abs(need):
            break
        need -= gain[i, j]
        taken[out[i : i + 1][out[i : i + 1] >= 0]] = False
        taken[more[j : j + 1][more[j : j + 1] >= 0]] = True
    return np.flatnonzero(taken)


def plan_mix(block_sizes: list[tuple], n_shards: int, seed: int, weights=WEIGHTS, limit: float = 3.0) -> Plan:
    """block_sizes: (source, block, words) of every block."""
    by: dict = {}
    for source, block, size in block_sizes:
        by.setdefault(source, []).append((int(block), int(size)))
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    sizes = [sum(x for _, x in by[s]) for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], limit)
    copies = []  # the blocks that each source gives, pass after pass
    for i, s in enumerate(names):
        own = sorted(by[s])
        whole = int(goal[i] / sizes[i] + 1e-9) if sizes[i] else 0
        rest = goal[i] - whole * sizes[i]
        last = choose_blocks(np.array([x for _, x in own]), rest, generator(seed, i)) if rest > 1e-9 * sizes[i] else []
        copies.append([b for b, _ in own] * whole + [own[j][0] for j in last])
    quotas = np.array([len(c) for c in copies], dtype=np.int64)
    room = np.full(n_shards, int(quotas.sum()) // n_shards, dtype=np.int64)
    room[: int(quotas.sum()) % n_shards] += 1
    dealt = split_all(quotas, room, seed) if len(quotas) else np.zeros((n_shards, 0), dtype=np.int64)
    plan = Plan({s: (sizes[i], goal[i]) for i, s in enumerate(names)}, [], sum(goal))
    for i, s in enumerate(names):
        shard_of = np.repeat(np.arange(n_shards), dealt[:, i])
        order = generator(seed, i, 1).permutation(len(shard_of))  # the permuted copies; shards take disjoint runs
        where: dict = {b: [] for b, _ in by[s]}
        for at, shard in zip(order, shard_of, strict=True):
            where[copies[i][at]].append(int(shard))
        plan.blocks += [(s, b, sorted(x)) for b, x in where.items()]
    return plan


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, n_shards: int, n_blocks: int, seed: int, weights, limit: float):
    """docs with a row digest and what the plan says of its block, the names of these columns, and the plan."""
    key, block, p_source, p_block, p_shards, p_size, p_target = own_names(docs, "row_key", "mix_block", "p_source", "p_block", "p_shards", "p_size", "p_target")
    text, source = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`")
    rows = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed))).withColumn(block, F.pmod(F.shiftright(F.col(key), 8), F.lit(n_blocks)).cast("int"))
    sums = rows.groupBy(source.alias("s"), F.col(block).alias("b")).agg(F.sum(n_words(text)).alias("n"))
    found = sums.limit(MAX_SOURCES * n_blocks + 1).collect()
    if len(found) > MAX_SOURCES * n_blocks:
        raise ValueError(f"a mix has at most {MAX_SOURCES} sources")
    plan = plan_mix([(r.s, r.b, r.n) for r in found], n_shards, seed, weights, limit)
    kind = docs.schema[source_col].dataType.simpleString()
    schema = ", ".join(f"{n} {k}" for n, k in zip((p_source, p_block, p_shards, p_size, p_target), (kind, "int", "array<int>", "long", "double"), strict=True))
    table = docs.sparkSession.createDataFrame([(s, b, x, *plan.sources[s]) for s, b, x in plan.blocks], schema)  # MAX_SOURCES * n_blocks rows at most
    out = rows.join(F.broadcast(table), source.eqNullSafe(F.col(p_source)) & (F.col(block) == F.col(p_block)))
    return out, (key, p_shards, p_size, p_target), plan


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_shards: int = 16, n_blocks: int = 256, seed: int = 20, weights=WEIGHTS, limit: float = 3.0) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken and mix_shards, the shard of each copy that the mix takes.

    A document belongs whole to its block, so a source's taken words differ from its target by a part of one block. Null texts
    have size 0 and follow their block. Null sources are one source, the last. Repeated rows are one block's and get equal
    shards. Columns of docs named like the results are replaced. An empty table gives no rows; more than MAX_SOURCES sources
    are an error.
    """
    out, (_, p_shards, p_size, p_target), _ = _planned(docs, id_col, text_col, source_col, n_shards, n_blocks, seed, weights, limit)
    size, = own_names(out, "mix_words")
    out = out.withColumn(size, n_words(F.col(f"`{text_col}`").cast("string")))
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_shards")]
    return out.select(*cols, F.col(size).alias("mix_size"), F.col(p_size).alias("mix_source_size"), F.col(p_target).alias("mix_target"),
                      (F.col(size) * F.size(p_shards)).alias("mix_taken"), F.col(p_shards).alias("mix_shards"))


def _copies(docs: DataFrame, all_rows: bool, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_shards: int = 16, n_blocks: int = 256, seed: int = 20, weights=WEIGHTS, limit: float = 3.0):
    """A row for each copy, in its shard's place, and the names of copy number, shard, source size and target.

    all_rows: documents that the mix doesn't take are there once, with a null shard.
    """
    out, (key, p_shards, p_size, p_target), plan = _planned(docs, id_col, text_col, source_col, n_shards, n_blocks, seed, weights, limit)
    copy, shard, order, place = own_names(out, "mix_copy", "mix_shard", "order_key", "mix_place")
    taken = F.posexplode_outer(p_shards) if all_rows else F.posexplode(p_shards)
    rows = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(key), F.col(p_size), F.col(p_target), taken.alias(copy, shard))
    rows = rows.withColumn(order, F.xxhash64(F.col(key), F.col(copy), F.lit(seed)))  # copies of a document stand apart
    cells = max(1, int(-(-plan.words // (n_shards * CELL_WORDS))))  # partitions of a shard, each a random part of it
    cell = F.pmod(F.shiftright(F.col(order), 20), F.lit(cells))
    rows = rows.withColumn(place, (F.coalesce(F.col(shard), F.pmod(F.col(key), F.lit(n_shards))) * cells + cell).cast("int"))
    rows = rows.repartitionById(n_shards * cells, place).sortWithinPartitions(order)
    return rows, (copy, shard, p_size, p_target)


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy taken, with mix_shard, in random order; a shard is a run of partitions.

    Options are those of mixed(). A column mix_shard of docs is replaced. Equal rows of docs, but not copies made by the mix,
    have one order key and stay neighbours.
    """
    keep = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix_shard"])
    rows, (_, shard, _, _) = _copies(keep, False, **options)
    return rows.select(*[F.col(f"`{c}`") for c in keep.columns], F.col(shard).alias("mix_shard"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: float = 3.0, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of every row of docs, read from the mix's own rows with their texts.

    Rows that the mix doesn't take pass through it with a null shard and give a row with taken 0. Rows with equal id, text and
    source come back as often as they were.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, (copy, shard, p_size, p_target) = _copies(narrow, True, limit=limit, **options)
    out = rows.select("doc_id", "source", row_key("text").alias("digest"), n_words(F.col("text")).alias("size"), F.col(p_size).alias("source_size"), F.col(p_target).alias("target"), F.col(copy).alias("copy"), F.col(shard).alias("shard"))
    most = int(np.ceil(limit))
    whose = [F.max(F.when(F.col("copy") == k, F.col("shard"))).alias(f"shard_{k}") for k in range(most)]
    docs_of = out.groupBy("doc_id", "source", "digest").agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.count("shard").alias("copies"),
                                                            F.count_if(F.coalesce("copy", F.lit(0)) == 0).alias("times"), *whose)
    each = docs_of.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") / F.col("times")).cast("long")).alias("taken"),
                       F.concat_ws(",", *[F.col(f"shard_{k}").cast("string") for k in range(most)]).alias("shards"))
