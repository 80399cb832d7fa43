"""Line dedup by two Bloom filters: lines seen once, lines seen twice.

Pass 1 sets, for each document's distinct line keys, bits in a filter that is cut into segments; a bit that two documents
set goes into the second filter as well. Pass 2 looks every key up in the second filter. Only the hits, true repeats and a
few false ones, are shuffled to be counted exactly and to choose the keeper. The filters' size follows the number of
lines; where that is more than `max_bits`, keys are taken in slices by their digest, one after the other, each with filters
of its own, so the share of false suspects is the same at every size. A fuller filter would change no result.
"""


import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, checkpointed, own_names, row_key, shuffle_partitions, text_batches, text_udf

SEGMENT_BITS = 1 << 20
#: Positions held in a task before they are sent on.
FLUSH = 4_000_000
_STRIP = SPACE.encode()


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it has fewer than min_chars code points. UTF-8 throughout: only ASCII changes."""
    keys = [x.strip(_STRIP) for x in (text or "").encode().lower().split(b"\n")]
    return [k if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars) else None for k in keys]


def digests(text: str | None, min_chars: int) -> bytes:
    """The 128-bit digests of a text's distinct keys, end to end."""
    return b"".join(map(xxhash.xxh3_128_digest, {*line_keys(text, min_chars)} - {None}))


def _keys(min_chars: int):
    @text_udf("binary")
    def run(texts):
        return [digests(t, min_chars) for t in texts]

    return run


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each digest, keys being rows of two unsigned longs; bits is a power of two."""
    return keys & np.uint64(bits - 1)


def in_slice(keys: np.ndarray, number: int, slices: int) -> np.ndarray:
    """Which keys belong to a slice, by bits of the digest that positions() doesn't use."""
    return (keys[:, 1] >> np.uint64(40)) % np.uint64(slices) == np.uint64(number)


def _set_bits(bits: int, number: int, slices: int):
    def run(batches):
        held, n = [], 0

        def flush():
            at = positions(np.concatenate(held), bits).ravel()
            at.sort()
            segment = (at // SEGMENT_BITS).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            z = zstandard.ZstdCompressor(1)
            rows = []
            for lo, hi in zip(starts, np.r_[starts[1:], len(at)], strict=True):
                gaps = np.diff((at[lo:hi] % SEGMENT_BITS).astype(np.uint32), prepend=np.uint32(0))
                rows.append((int(segment[lo]), z.compress(gaps.tobytes())))
            return pd.DataFrame(rows, columns=["segment", "bits"])

        for pdf in batches:
            for found in pdf["keys"]:
                keys = np.frombuffer(found, dtype="<u8").reshape(-1, 2)
                held.append(keys[in_slice(keys, number, slices)] if slices > 1 else keys)
                n += 2 * len(held[-1])
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


def _merge(batches):
    """The second filter of a segment: bits that were set at least twice, whatever the order in which tasks arrive."""
    once = np.zeros(SEGMENT_BITS, dtype=bool)
    twice, segment = np.zeros(SEGMENT_BITS, dtype=bool), None
    for pdf in batches:
        for s, blob in zip(pdf["segment"], pdf["bits"], strict=True):
            if segment is not None and s != segment:
                if twice.any():
                    yield pd.DataFrame({"segment": [segment], "bits": [zstandard.ZstdCompressor(1).compress(np.packbits(twice).tobytes())]})
                once[:], twice[:] = False, False
            segment = s
            at = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint32))
            twice[at[1:][at[1:] == at[:-1]]] = True
            twice[at[once[at]]] = True
            once[at] = True
    if segment is not None and twice.any():
        yield pd.DataFrame({"segment": [segment], "bits": [zstandard.ZstdCompressor(1).compress(np.packbits(twice).tobytes())]})


def _suspects(bits: int, filters, number: int, slices: int):
    def run(batches):
        n = max(1, bits // SEGMENT_BITS)
        seen = np.zeros((n, SEGMENT_BITS // 8), dtype=np.uint8)
        for s, blob in filters.value:
            seen[s] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
        seen = seen.ravel()
        for pdf in batches:
            ids, own, keys = [], [], []
            for k, found in enumerate(pdf["keys"]):
                all_keys = np.frombuffer(found, dtype="<u8").reshape(-1, 2)
                at = positions(all_keys, bits)
                hit = ((seen[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
                if slices > 1:
                    hit &= in_slice(all_keys, number, slices)
                where = np.flatnonzero(hit).tolist()
                own += [k] * len(where)
                keys += [found[16 * i : 16 * i + 16] for i in where]
            ids = [None if i != i else i for i in pdf["doc"].astype(object)]
            yield pd.DataFrame({"doc": pd.array([ids[k] for k in own], dtype="Int64"), "h1": pdf["h1"].to_numpy()[own], "h2": pdf["h2"].to_numpy()[own], "key": pd.Series(keys, dtype=object)})

    return run


def _rewrite(min_chars: int):
    @text_udf("n_lines long, n_dropped long, kept string")
    def run(texts, drops):
        out = []
        for text, drop in zip(texts, drops, strict=True):
            parts = stay = (text or "").split("\n")
            if drop:
                gone = set(drop)
                keys = line_keys(text, min_chars)
                stay = [x for x, k in zip(parts, keys, strict=True) if k is None or xxhash.xxh3_128_digest(k) not in gone]
            out.append((len(parts), len(parts) - len(stay), "\n".join(stay)))
        return out

    return run


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, bits_per_line: int, max_bits: int) -> DataFrame:
    """(row, drop) of each row of docs (doc, row, body) that loses lines: the digests of the keys to drop."""
    spark = docs.sparkSession
    keyed = checkpointed(docs.select("doc", "row.h1", "row.h2", _keys(min_chars)("body").alias("keys")).where(F.octet_length("keys") > 0))
    lines = (keyed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 16
    wanted = max(SEGMENT_BITS, 1 << (max(1, lines) * bits_per_line - 1).bit_length())
    bits = min(max_bits, wanted)
    slices = wanted // bits
    parts = max(1, min(bits // SEGMENT_BITS, shuffle_partitions(spark)))
    held = None
    for number in range(slices):
        once = keyed.select("keys").mapInPandas(_set_bits(bits, number, slices), "segment long, bits binary")
        twice = once.repartition(parts, "segment").sortWithinPartitions("segment").mapInPandas(_merge, "segment long, bits binary")
        filters = spark.sparkContext.broadcast([(int(s), bytes(b)) for s, b in twice.collect()])  # max_bits / 8 bytes at most
        found = checkpointed(keyed.mapInPandas(_suspects(bits, filters, number, slices), "doc long, h1 long, h2 long, key binary"))
        filters.unpersist()
        held = found if held is None else held.union(found)
    # a written table of its own, so that Spark can split the join at a line that very many documents hold
    ends = checkpointed(held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs))
    lost = held.join(ends, "key").where(~F.col("doc").eqNullSafe(F.col("last")))
    return lost.groupBy("h1", "h2").agg(F.collect_set("key").alias("drop")).select(F.struct("h1", "h2").alias("row"), "drop")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits_per_line: int = 32, max_bits: int = 1 << 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that min_docs rows or more share, except in the row with the largest id.

    Returns docs with n_lines (before dropping), n_dropped and kept (the text that stays); columns of docs with these names
    are replaced. A null or empty text is one empty line. A document is a row: repeated rows count each, and rows that share
    the largest id all keep the line. Rows with a null id count as documents; they keep a line only if no holder has an id.
    Keys are compared by 128-bit digests. An empty table gives no rows.
    """
    text_batches(docs)
    row, drop, out = own_names(docs, "row_key", "drop_keys", "line_result")
    doc, body = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    src = docs.select(doc.alias("doc"), row_key(doc, body).alias("row"), body.alias("body"))
    lost = repeated_lines(src, min_chars, min_docs, bits_per_line, max_bits).select(F.col("row").alias(row), F.col("drop").alias(drop))
    joined = docs.withColumn(row, row_key(doc, body)).join(lost, row, "left").withColumn(out, _rewrite(min_chars)(body, F.col(drop)))
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
    return joined.select(*cols, F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_dropped").alias("n_dropped"), F.col(f"{out}.kept").alias("kept"))
