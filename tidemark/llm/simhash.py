"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits have a common variant within half of it of both. Every fingerprint stands for all its
variants; they are shuffled by their leading bits. Variants of one fingerprint with the same leading bits travel as one
row, the fingerprint itself, and are written out by the task that owns these bits; the variants that meet there are found
by sorting. All members of a meeting variant are within the radius of each other, so a link of each to one of them, kept
once and verified, loses no link of the group and never writes all its pairs.
"""

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, own_names, row_key, shuffle_partitions, text_batches, text_udf
from tidemark.llm.components import components

BITS = 64
_LOW = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of the text's words, A-Z in lower case, repeats included; of a shorter text as a whole."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    h, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((h(view[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 for none."""
    n = len(hashes)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 255 * 64):  # byte lanes hold 255 ones at most
        block = hashes[at : at + 255 * 64]
        pad = -len(block) % 255 if len(block) > 255 else 0
        rows = np.concatenate([block, np.zeros(pad, dtype=np.uint64)]).reshape(-1, min(255, len(block) + pad)) if pad or len(block) > 255 else block[None, :]
        for j in range(8):
            lanes = ((rows >> np.uint64(j)) & _LOW).sum(axis=1, dtype=np.uint64)
            counts[j::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = 2 * counts > n
    return int(sum(1 << int(k) for k in np.flatnonzero(bits)))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the shingles' hashes; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def masks(bits: int, radius: int) -> np.ndarray:
    """All masks of at most radius of the lowest `bits` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], dtype=np.uint64)


def _spread(prefix_bits: int, half: int):
    """(prefix, fingerprint) for every prefix of a variant."""
    low = BITS - prefix_bits
    flips = masks(prefix_bits, half).astype(np.int64)

    def run(batches):
        for pdf in batches:
            f = pdf["fp"].to_numpy(dtype=np.int64)
            p = (f.view(np.uint64) >> np.uint64(low)).astype(np.int64)
            yield pd.DataFrame({"prefix": (p[:, None] ^ flips[None, :]).ravel(), "fp": np.repeat(f, len(flips))})

    return run


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _meet(prefix_bits: int, radius: int):
    half, low = radius // 2, BITS - prefix_bits
    by_room = [masks(low, r) for r in range(half + 1)]

    def links(prefix: int, fps: np.ndarray):
        """fps: the distinct fingerprints that have variants with this prefix."""
        if len(fps) < 2:
            return
        u = fps.view(np.uint64)
        off = np.bitwise_count((u >> np.uint64(low)) ^ np.uint64(prefix))
        keep = np.uint64((1 << low) - 1)
        variants, owner = [], []
        for r in range(half + 1):
            own = np.flatnonzero(off == half - r)
            if len(own):
                variants.append(((u[own] & keep)[:, None] ^ by_room[r][None, :]).ravel())
                owner.append((own, len(by_room[r])))
        flat = np.concatenate(variants)
        ranked = np.sort(flat)
        met = ranked[1:][ranked[1:] == ranked[:-1]]
        del ranked
        if not len(met):
            return
        met = np.unique(met)
        at = np.minimum(np.searchsorted(met, flat), len(met) - 1)
        hit = np.flatnonzero(met[at] == flat)
        who = np.concatenate([np.repeat(own, n) for own, n in owner])[hit]
        group = at[hit]
        order = np.lexsort((who, group))
        who, group = who[order], group[order]
        head = np.r_[True, group[1:] != group[:-1]]
        first = who[np.maximum.accumulate(np.where(head, np.arange(len(who)), 0))]
        pairs = np.unique(np.stack([first, who], axis=1)[~head], axis=0)
        pairs = pairs[np.bitwise_count(u[pairs[:, 0]] ^ u[pairs[:, 1]]) <= radius]
        forest = _Forest()
        for a, b in pairs.tolist():
            if forest.link(a, b):
                yield int(fps[a]), int(fps[b])

    def run(batches):
        out, prefix, held = [], None, []
        for pdf in batches:
            p, f = pdf["prefix"].to_numpy(), pdf["fp"].to_numpy(dtype=np.int64)
            cuts = np.r_[0, np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if prefix is not None and p[lo] != prefix:
                    out += links(prefix, np.unique(np.concatenate(held)))
                    held = []
                prefix = int(p[lo])
                held.append(f[lo:hi])
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
                out = []
        if held:
            out += links(prefix, np.unique(np.concatenate(held)))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def prefix_bits_for(n: int, radius: int, per_task: int = 2_000_000) -> int:
    """Leading bits that keep the variants of one prefix near per_task, whatever the number of fingerprints."""
    total = n * len(masks(BITS, radius // 2))
    return min(32, max(4, int(np.ceil(np.log2(max(1, total / per_task))))))


def link_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links among distinct fingerprints (fp long) that join the same components as all pairs within radius (even)."""
    n = fps.count()
    bits = prefix_bits_for(n, radius)
    parts = max(shuffle_partitions(fps.sparkSession), 1)
    spread = fps.select("fp").mapInPandas(_spread(bits, radius // 2), "prefix long, fp long")
    return spread.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInPandas(_meet(bits, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, fp, row) of every row of docs, and (fp, component_id) of every fingerprint.

    component_id is the smallest id reachable over links of at most radius bits. Null and empty texts have fingerprint zero
    and link like any other. Rows with a null id take part and get the smallest id of the others of their component (null if
    there is none). Equal fingerprints are one class before any link is made, so copies cost nothing. row is a digest of id
    and text, equal for repeated rows. An empty table gives empty ones.
    """
    text_batches(docs)

    @text_udf("long")
    def simhash(texts):
        return np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)

    fps = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), simhash(F.col(f"`{text_col}`").cast("string")).alias("fp"), row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).alias("row"))
    fps = checkpointed(fps)
    classes = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(link_fingerprints(classes, radius))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    low = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(low, "root").select("fp", "component_id")
    return fps, named


def near_duplicate_report(docs: DataFrame, **options) -> DataFrame:
    fps, named = near_duplicates(docs, **options)
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that are near a document with a smaller id: the smallest id of each component stays.

    A component without any id keeps one row; repeated rows of the smallest id keep one.
    """
    fps, named = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    row, n = own_names(docs, "row_key", "row_copies")
    keep = fps.join(named, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    copies = keep.groupBy("row", "component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(F.count("*").alias("n"))
    best = copies.groupBy("component_id", "own").agg(F.min(F.struct("row", "n")).alias("best"))
    best = best.select(F.col("best.row").alias(row), F.col("best.n").alias(n))
    keyed = docs.withColumn(row, row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(best.where(F.col(n) == 1), row, "left_semi").select(*cols)
    more = keyed.join(best.where(F.col(n) > 1), row, "left_semi").dropDuplicates([row]).select(*cols)
    return once.unionByName(more)
