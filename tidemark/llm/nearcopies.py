"""Near copies by the Jaccard similarity of their word shingles, at least `least`, checked exactly.

SimHash ball hashing (operator 4) links what its radius reaches; each of its links is checked before it counts. Its radius
doesn't reach all similar pairs: at a similarity of 0.8 the 64-bit fingerprints differ in ten bits on average, and the balls
of that radius are too large to emit. So bands of minima propose further pairs: 24 bands of 4 minima miss a pair of
similarity 0.8 with a chance of 3 in a million, and less above. Each class of equal texts is checked against the leaders of
its buckets, the first ones by a few orders; then all pairs of a bucket whose classes are not joined yet, whose sizes allow the similarity
and which fingerprints, minima and parities don't rule out are checked, none left out. Parities (which bits are hit by an odd number of a
set's hashes) never rule out a similar pair: two sets' parities differ in at most as many bits as the sets differ in elements. Below the
threshold they differ in nearly as many, so of a large group of texts just below it few pairs leave the join.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, own_names, row_key, text_batches, text_udf
from tidemark.llm.components import components
from tidemark.llm.simhash import link_fingerprints, majority, shingle_hashes

BANDS, ROWS = 24, 4
#: Fingerprints of texts at a similarity of 0.8 differ in 9.7 bits of 64 on average (2.9 standard deviation); more than this many,
#: which has a chance below one in a hundred million there, rules it out. Unlike texts differ in 32.
MAX_BITS_APART = 28
#: Orders that give a bucket's leaders, before all pairs that are left are checked.
LEADER_ROUNDS = 4
#: One bit of each of the 96 minima: at a similarity of 0.8 texts differ in 9.6 on average (2.9); more than this many rules it out as surely.
MAX_MINIMA_APART = 27
_RNG = np.random.Generator(np.random.PCG64(5))
_MUL = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)


def signature(text: str | None, shingle: int) -> np.ndarray:
    """Class of equal shingle sets, their size, their fingerprint, bits of their minima (two longs), and a key for each band."""
    s = np.unique(shingle_hashes(text, shingle))
    head = [xxhash.xxh64_intdigest(s.tobytes(), 7), len(s), majority(s) if len(s) else 0]
    if not len(s):
        return np.array(head, dtype=np.uint64).view(np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 1024):
        low = np.minimum(low, (s[at : at + 1024, None] * _MUL + _ADD).min(axis=0))
    raw, step = low.tobytes(), 8 * ROWS
    bits = np.packbits(((low >> np.uint64(7)) & np.uint64(1)).astype(np.uint8)).tobytes().ljust(16, b"\0")
    head += [int.from_bytes(bits[:8], "little"), int.from_bytes(bits[8:], "little")]
    return np.array(head + [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """A set's bits that an odd number of its hashes hit, in longs; 4 to 8 bits an element, a power of two.

    The parities of fewer bits follow by folding: long k with long k + half.
    """
    bits = max(128, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 128
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _check(least: float):
    """Whether two sets of shingles, sorted longs end to end, are similar; read where they lie, without copies."""

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            out.append(both >= least * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return run


def _allowed(least: float) -> str:
    """SQL: whether the parities of a row and of its o let the sets be similar; sizes are known to, so their bits differ by a factor of two at most.

    Sets of n and m elements that differ in d have the similarity (n + m - d) / (n + m + d).
    """
    apart = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)"
    bits = f"case when size(odd) = size(o.odd) then {apart('odd', 'o.odd')} when size(odd) > size(o.odd) then {apart('odd_half', 'o.odd')} else {apart('odd', 'o.odd_half')} end"
    return f"{bits} <= {(1 - least) / (1 + least) + 1e-9!r}D * (n + o.n)"


def classes_and_links(docs: DataFrame, shingle: int, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, cls) of every row of docs, and (a, b), links of classes that join the same components as all similar pairs."""
    text_batches(docs)

    @text_udf("array<long>")
    def sign(texts):
        return [signature(t, shingle) for t in texts]

    @text_udf("shingles binary, odd array<long>, odd_half array<long>")
    def sets_of(texts):
        out = []
        for t in texts:
            odd = parity(s := np.unique(shingle_hashes(t, shingle)))
            out.append((s.tobytes(), odd, odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]))
        return out

    check = _check(least)
    key, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    named = docs.select(key.alias("id"), row_key(key, text).alias("row"), text.alias("text"))
    rows = checkpointed(named.select("id", "row", sign("text").alias("sig")).withColumn("cls", F.col("sig")[0]))
    sets = checkpointed(rows.groupBy("cls").agg(F.min("row").alias("row"), F.min("sig").alias("sig")))
    sets = sets.select("cls", "row", F.col("sig")[1].alias("n"), F.col("sig")[2].alias("fp"), F.col("sig")[3].alias("m1"), F.col("sig")[4].alias("m2"), F.slice("sig", 6, BANDS).alias("bands")).where("n > 0")

    # the ball hash: classes of one fingerprint with the first of them, and first ones of linked fingerprints
    firsts = checkpointed(sets.groupBy("fp").agg(F.min("cls").alias("first")))
    first = lambda name: firsts.select(F.col("fp").alias(f"{name}_fp"), F.col("first").alias(name))
    balls = link_fingerprints(firsts).toDF("a_fp", "b_fp").join(first("a"), "a_fp").join(first("b"), "b_fp").select("a", "b")
    same = sets.join(firsts, "fp").where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b"))
    balls = checkpointed(balls.union(same))

    keyed = sets.select("cls", "n", "fp", "m1", "m2", F.explode("bands").alias("band"))
    met = checkpointed(keyed.withColumn("m", F.count("*").over(Window.partitionBy("band"))).where("m > 1").withColumn("company", F.sum("m").over(Window.partitionBy("cls"))).drop("m"))
    wanted = met.select("cls").union(balls.select("a")).union(balls.select("b")).distinct()
    texts = sets.join(wanted, "cls", "left_semi").select("cls", "row").join(named.select("row", "text"), "row").select("cls", "text").dropDuplicates(["cls"]).select("cls", sets_of("text").alias("got")).select("cls", "got.*")
    texts = checkpointed(texts)

    def verified(pairs: DataFrame) -> DataFrame:
        ta, tb = texts.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), texts.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
        return checkpointed(pairs.join(ta, "a").join(tb, "b").where(check("x", "y")).select("a", "b"))

    def rooted(links: DataFrame) -> DataFrame:
        return met.join(components(links), F.col("cls") == F.col("node"), "left").select("cls", "n", "fp", "m1", "m2", "band", "company", F.coalesce("root", "cls").alias("root"))

    fits = (f"root <> o.root and least(n, o.n) >= {least} * greatest(n, o.n) and bit_count(fp ^ o.fp) <= {MAX_BITS_APART} "
            f"and bit_count(m1 ^ o.m1) + bit_count(m2 ^ o.m2) <= {MAX_MINIMA_APART}")
    one = ("cls", "n", "fp", "m1", "m2", "root")
    links = verified(balls.distinct())
    near = checkpointed(rooted(links))
    # the class that meets most others first, as a text does whose copies were each edited in another place; then random ones
    orders = [-F.col("company"), *[F.xxhash64("cls", F.lit(k)) for k in range(LEADER_ROUNDS - 1)]]
    turns = [F.min(F.struct(turn.alias("turn"), *one)).over(Window.partitionBy("band")) for turn in orders]
    led = near.withColumn("leaders", F.array(*turns)).withColumn("o", F.explode("leaders"))
    links = links.unionByName(verified(led.where(fits).select(F.col("cls").alias("a"), F.col("o.cls").alias("b")).distinct()))
    left = rooted(links)
    apart = left.withColumn("lo", F.min("root").over(Window.partitionBy("band"))).withColumn("hi", F.max("root").over(Window.partitionBy("band"))).where("lo <> hi").drop("lo", "hi")
    apart = checkpointed(apart.join(texts.select("cls", "odd", "odd_half"), "cls"))
    other = apart.select("band", F.struct(*one, "odd", "odd_half").alias("o"))
    rest = apart.join(other, "band").where(f"cls < o.cls and {fits} and {_allowed(least)}").select(F.col("cls").alias("a"), F.col("o.cls").alias("b")).distinct()
    return rows.select("id", "row", "cls"), links.unionByName(verified(rest))


def drop_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that chains of similar texts tie to a document with a smaller id.

    Equal texts are similar, those without words too. A component without any id keeps one row; repeated rows of the
    smallest id keep one.
    """
    rows, links = classes_and_links(docs, shingle, least, id_col, text_col)
    roots = components(links)
    near = rows.join(roots, F.col("cls") == F.col("node"), "left").select("id", "row", F.coalesce("root", "cls").alias("root"))
    # the smallest id first; rows of one id by their digest
    best = near.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")).select("root", F.col("best.row").alias("row"))
    copies = near.join(best, ["root", "row"]).groupBy("row").agg(F.count("*").alias("n"))
    row, n = own_names(docs, "row_key", "row_copies")
    best = copies.select(F.col("row").alias(row), F.col("n").alias(n))
    keyed = docs.withColumn(row, row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(best.where(F.col(n) == 1), row, "left_semi").select(*cols)
    more = keyed.join(best.where(F.col(n) > 1), row, "left_semi").dropDuplicates([row]).select(*cols)
    return once.unionByName(more)
