"""LM scoring with an Elias-Fano n-gram trie, partitioned by predicted word.

p(w | h) = (sum a_k c(h_k w) + b p(w)) / (sum a_k c(h_k) + b), h_k being the last k words before w, k = 1 .. order - 1: counts of
all orders with growing weights, over absolutely discounted word probabilities p. The numerator needs only what is known
where w is; the denominator of the word after it needs the counts of the same word's contexts, known there too. So each
token is sent once, with the words before it, to its word's partition, which counts, builds its part of the trie,
memory-maps it, and returns partial sums for each document. Words so frequent that they would fill a partition are spread
over all by the word before them, with their count known beforehand.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, pieces, shuffle_partitions, text_batches
from tidemark.llm.eliasfano import Trie

#: No word holds these characters.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n", b"\r"))
#: Tokens of a chunk: MESSAGE_TOKENS for each partition that it is sent to, within these bounds; documents at most. A message names
#: each word once, so that large messages are small for what they say.
MESSAGE_TOKENS, CHUNK_TOKENS, CHUNK_DOCS = 100_000, (4_000_000, 8_000_000), 1 << 16
#: Tokens of a trie partition, about; PARTS partitions at least.
PART_TOKENS, PARTS = 4_000_000, 24
#: Bytes of a context word's hash that are sent: contexts are told apart below one word only.
CONTEXT_BYTES = 6
#: Bytes of messages that a worker function gives back at a time.
SEND_BYTES = 4_000_000
#: Tokens that a task holds unpacked at a time.
ROUND_TOKENS = 200_000
#: Weights of the counts by length of the context, and of the word's own probability.
WEIGHTS, BASE_WEIGHT = (1.0, 100.0, 10_000.0), 1000.0
MEMO_WORDS = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def token_hashes(text: str | None, memo: _Hashes) -> list[int]:
    return [memo[w] for w in text.encode().lower().split()] if text else []


def held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves remainder 1 by 5; a null id is an empty text, in training."""
    return zlib.crc32(str(int(doc_id)).encode() if doc_id is not None and doc_id == doc_id else b"") % 5 == 1


def _count(batches):
    """(h, n): training tokens by hash, summed in chunks."""
    memo, held, n = _Hashes(), [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "n"])

    for batch in batches:
        for docs, texts in pieces(batch, "doc", "body"):
            for doc, text in zip(docs, texts, strict=True):
                if not held_out(doc):
                    held.append(np.array([*token_hashes(text, memo), int(END)], dtype=np.uint64))
                    n += len(held[-1])
                if n >= 2_000_000:
                    yield flush()
                    held, n = [], 0
    if held:
        yield flush()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def part_of(word: np.ndarray, context: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    spread = np.isin(word, heavy)
    return ((np.where(spread, _mix(context, word), word) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def numbered(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens in order, and the number of each token; takes the list's arrays out of it, as they are large together."""
    flat = np.concatenate(tokens)
    tokens.clear()
    by = np.argsort(flat)
    flat = flat[by]
    new = np.r_[True, flat[1:] != flat[:-1]]
    table, numbers = flat[new], np.empty(len(flat), dtype=np.int32)
    del flat
    numbers[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return table, numbers


def contexts_at(where: np.ndarray, place: np.ndarray, numbers: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """For k = 1 .. order - 1 the word that stands k before the tokens at `where`, each the place-th of its document; `start` before the first."""
    return [np.where(place >= k, numbers[np.maximum(where - k, 0)], start).astype(numbers.dtype) for k in range(1, order)]


def _mark(place: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, most frequent first; place then has the rank of each."""
    count = np.bincount(numbers[0], minlength=len(place))
    for x in numbers[1:]:
        count += np.bincount(x, minlength=len(place))
    out = np.flatnonzero(count)
    out = out[np.argsort(-count[out], kind="stable")]
    place[out] = np.arange(len(out))
    return out


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all numbers, then the next ones: ranks by frequency have small upper bytes, which pack well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, at: int, n: int, width: int, now=slice(None)) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)[:, now]
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "chunk", "docs", "tokens"])


def _scatter(parts: int, heavy: np.ndarray, order: int):
    """Chunks of documents as rows (part, chunk, docs, tokens) with packed arrays."""
    chunk_tokens = min(CHUNK_TOKENS[1], max(CHUNK_TOKENS[0], MESSAGE_TOKENS * parts))

    def run(batches):
        memo, z = _Hashes(), zstandard.ZstdCompressor(1)
        chunk, ids, words, sizes = TaskContext.get().partitionId() << 32, [], [], []

        def flush():
            # words of the chunk by number; the start stands before a document. Contexts are read where a part needs them:
            # arrays of a chunk's length are what a worker's memory goes to
            lengths, kind = np.array(sizes), np.uint16 if parts <= 1 << 16 else np.uint32
            table, numbers = numbered(words)
            start = int(numbers[-1])
            begins = np.cumsum(lengths) - lengths
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            part = part_of(table, table, table[:0], parts).astype(kind)[numbers[:-1]]
            spread = np.flatnonzero(np.isin(table, heavy)[numbers[:-1]])
            for at in range(0, len(spread), 1 << 18):
                x = spread[at : at + (1 << 18)]
                (one,) = contexts_at(x, x - begins[doc[x]], numbers, 2, start)
                part[x] = part_of(table[numbers[x]], table[one], heavy, parts)
            del spread
            by = np.argsort(part, kind="stable")
            cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
            del part
            known, number = np.array([i is not None for i in ids]), np.array([i or 0 for i in ids], dtype=np.int64)
            train = np.array([not held_out(i) for i in ids])
            word_place, doc_place = (np.zeros(n, dtype=np.uint32) for n in (len(table), len(ids)))
            rows, held = [], 0
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = by[cuts[p] : cuts[p + 1]]
                at = at[np.argsort(numbers[at], kind="stable")]
                word, of = numbers[at], doc[at]
                before = contexts_at(at, at - begins[of], numbers, order, start)
                begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                own, n = word[begin], np.diff(np.r_[begin, len(at)])
                there, local = np.unique(of), _mark(word_place, *before)  # only documents with tokens here
                doc_place[there] = np.arange(len(there))
                head = np.array([len(there), len(own), len(at), len(local)], dtype=np.int64)
                docs = z.compress(there.astype(np.uint16).tobytes() + known[there].tobytes() + train[there].tobytes() + number[there].tobytes())
                wide = 2 if len(local) <= 1 << 16 else 4
                body = [head.tobytes(), table[own].tobytes(), n.astype(np.uint32).tobytes(), _planes(table[local] >> np.uint64(64 - 8 * CONTEXT_BYTES), CONTEXT_BYTES), _planes(doc_place[of], 2), *[_planes(word_place[x], wide) for x in before]]
                rows.append((p, chunk, docs, z.compress(b"".join(body))))
                held += len(rows[-1][3])
                if held >= SEND_BYTES:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

        n = 0
        for batch in batches:
            for docs, texts in pieces(batch, "doc", "body"):
                for doc, text in zip(docs, texts, strict=True):
                    words.append(np.array([*token_hashes(text, memo), int(END)], dtype=np.uint64))
                    ids.append(doc)
                    sizes.append(len(words[-1]))
                    n += sizes[-1]
                    if n >= chunk_tokens or len(ids) >= CHUNK_DOCS:
                        words.append(np.array([START]))
                        yield from flush()
                        chunk, ids, words, sizes, n = chunk + 1, [], [], [], 0
        if ids:
            words.append(np.array([START]))
            yield from flush()

    return run


def _unpack(blob: bytes, order: int, rounds: int, turn: int):
    """Words, contexts and document numbers of one message, of those words whose turn it is."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    _, k, n, m = (int(x) for x in np.frombuffer(raw, np.int64, 4))
    at = 32
    own = np.frombuffer(raw, np.uint64, k, at)
    reps = np.frombuffer(raw, np.uint32, k, at + 8 * k)
    at += 12 * k
    table = _from_planes(raw, at, m, CONTEXT_BYTES)
    at += CONTEXT_BYTES * m
    mine = (own >> np.uint64(11)) % np.uint64(rounds) == turn
    now = np.flatnonzero(np.repeat(mine, reps)) if rounds > 1 else slice(None)
    doc = _from_planes(raw, at, n, 2, now).astype(np.int32)
    at += 2 * n
    wide = 2 if m <= 1 << 16 else 4
    return np.repeat(own[mine], reps[mine]), [table[_from_planes(raw, at + i * wide * n, n, wide, now)] for i in range(order - 1)], doc


def _doc_table(blob: bytes):
    """Numbers in the chunk, whether the id is known, whether the document trains, and ids."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, bool, n, 2 * n), np.frombuffer(raw, bool, n, 3 * n), np.frombuffer(raw, np.int64, n, 4 * n)


class Totals:
    """What training counts: tokens, types, documents, the discount, and the heavy words' counts."""

    def __init__(self, tokens: int, types: int, ones: int, twos: int, docs: int, heavy: dict[int, int]):
        self.tokens, self.types, self.docs = tokens, types, docs
        self.discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.heavy = np.array(sorted(heavy), dtype=np.uint64)
        self.heavy_counts = np.array([heavy[h] for h in sorted(heavy)], dtype=np.int64)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def prob(self, c: np.ndarray) -> np.ndarray:
        """Discounted probabilities; all unknown words share what known ones gave up."""
        n = max(1, self.tokens)
        unknown = self.discount * self.types / n if self.tokens else 1.0
        return np.where(c > 0, (c - self.discount) / n, unknown)


class Model:
    """The order is one more than the number of count weights; a longer context should weigh more."""

    def __init__(self, weights: tuple[float, ...] = WEIGHTS, base: float = BASE_WEIGHT):
        if not weights or min(weights) <= 0 or base <= 0:
            raise ValueError("a model needs at least one weight, and positive ones")
        self.weights, self.base, self.order = tuple(weights), base, len(weights) + 1


def score_part(tokens: list[np.ndarray], train_doc, totals: Totals, model: Model):
    """Partial sums of each document: tokens, known, base and score. tokens: words, documents and contexts of one turn's tokens, taken out of the list."""
    n_levels = model.order
    word, doc, *before = tokens
    tokens.clear()
    order = np.lexsort((*before[::-1], word))
    word, doc = word[order], doc[order]
    for k in range(n_levels - 1):
        before[k] = before[k][order]
    del order
    train = train_doc[doc].astype(np.int64)
    # groups of each level: their first token, their parent, and the count in training
    change = np.r_[True, word[1:] != word[:-1]]
    of, starts, parents, counts = [], [], [], []
    for level in range(n_levels):
        if level:
            x = before[level - 1]
            change[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(change)
        parents.append(of[-1][at] if level else None)
        of.append((np.cumsum(change) - 1).astype(np.int32))
        starts.append(at)
        counts.append(np.add.reduceat(train, at))
    own = word[starts[0]]
    if len(totals.heavy):
        at = np.minimum(np.searchsorted(totals.heavy, own), len(totals.heavy) - 1)
        counts[0] = np.where(totals.heavy[at] == own, totals.heavy_counts[at], counts[0])
    # numerators of a word and denominators of what comes after it, for each longest known context
    above, below = [model.base * totals.prob(counts[0])], [model.base + model.weights[0] * counts[0]]
    for level in range(1, n_levels):
        above.append(above[-1][parents[level]] + model.weights[level - 1] * counts[level])
        if level < n_levels - 1:
            below.append(below[-1][parents[level]] + model.weights[level] * counts[level])
    # the trie holds what training knows
    inside, number = [c > 0 for c in counts], [np.cumsum(c > 0) - 1 for c in counts]
    levels = [(number[k - 1][parents[k][inside[k]]], before[k - 1][starts[k][inside[k]]]) for k in range(1, n_levels)]
    values = [[np.log10(above[k][inside[k]])] + ([np.log10(below[k][inside[k]])] if k < n_levels - 1 else []) for k in range(n_levels)]
    trie = Trie(own[inside[0]], levels, values)
    del above, below, values, levels, number
    # and answers for every word and context of the partition
    node = trie.find_words(own)
    count = np.where(node >= 0, counts[0], 0)
    up = np.full(len(own), float(np.log10(model.base * totals.prob(np.zeros(1))[0])))
    down = np.full(len(own), float(np.log10(model.base)))
    up[node >= 0], down[node >= 0] = trie.value(1, 0, node[node >= 0]), trie.value(1, 1, node[node >= 0])
    after = down[of[0]]
    for level in range(1, n_levels):
        up, over = up[parents[level]], node[parents[level]]
        ask = np.flatnonzero(over >= 0)
        node = np.full(len(over), -1, dtype=np.int64)
        node[ask] = trie.find_children(level, over[ask], before[level - 1][starts[level][ask]])
        hit = np.flatnonzero(node >= 0)
        up[hit] = trie.value(level + 1, 0, node[hit])
        if level < n_levels - 1:
            down = down[parents[level]]
            down[hit] = trie.value(level + 1, 1, node[hit])
            after = down[of[level]]
    trie.close()
    after = np.where(word == END, 0.0, after)  # nothing comes after an end
    n = len(train_doc)
    base = totals.base(count)
    return (np.bincount(doc, minlength=n), np.bincount(doc, weights=(count > 0)[of[0]], minlength=n).astype(np.int64), np.bincount(doc, weights=base[of[0]], minlength=n),
            np.bincount(doc, weights=up[of[-1]] - after, minlength=n))


def _reduce(totals: Totals, model: Model):
    def run(sent: pa.Table) -> pa.Table:
        z, train, spans, at, tokens = zstandard.ZstdCompressor(1), [], [], 0, 0
        for batch in sent.to_batches():
            for chunk, docs, blob in zip(*(batch.column(c) for c in ("chunk", "docs", "tokens")), strict=True):
                docs, blob = docs.as_py(), blob.as_buffer()  # messages are read where they lie
                there, _, trains, _ = _doc_table(docs)
                train.append(trains)
                spans.append((chunk.as_py(), docs, blob, at, at + len(there)))
                at += len(there)
                tokens += int(np.frombuffer(zstandard.ZstdDecompressor().stream_reader(blob).read(32), np.int64)[2])
        train_doc, rounds = np.concatenate(train), max(1, -(-tokens // ROUND_TOKENS))
        sums = [np.zeros(at, dtype=k) for k in (np.int64, np.int64, np.float64, np.float64)]

        def turn_of(turn: int):
            w, d, v = [], [], [[] for _ in range(model.order - 1)]
            for _, _, blob, lo, _ in spans:
                word, before, doc = _unpack(blob, model.order, rounds, turn)
                w.append(word)
                d.append(doc.astype(np.int32) + np.int32(lo))
                for to, x in zip(v, before, strict=True):
                    to.append(x)
            return [np.concatenate(x) for x in (w, d, *v)]

        for turn in range(rounds):  # the words of a partition in turns, each with its own piece of the trie
            unpacked = turn_of(turn)
            if len(unpacked[0]):
                for total, part in zip(sums, score_part(unpacked, train_doc, totals, model), strict=True):
                    total += part
        packed = [z.compress(b"".join(x[a:b].astype(k).tobytes() for x, k in zip(sums, ("<u4", "<u4", "<f8", "<f8"), strict=True))) for _, _, _, a, b in spans]
        return pa.table({"chunk": pa.array([x[0] for x in spans], pa.int64()), "docs": pa.array([x[1] for x in spans], pa.binary()), "sums": pa.array(packed, pa.binary())})

    return run


def _gather(totals: Totals, model: Model):
    start = float(np.log10(totals.docs * sum(model.weights) + model.base))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(((bytes(d), bytes(s)) for d, s in zip(pdf["docs"], pdf["sums"], strict=True)))  # in a fixed order, so that sums of doubles agree
        tables = [_doc_table(d) for d, _ in parts]
        n = max(int(t[0][-1]) for t in tables) + 1
        ids, known, train = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        out = [np.zeros(n, dtype=k) for k in (np.int64, np.int64, np.float64, np.float64)]
        for (where, k, t, i), (_, blob) in zip(tables, parts, strict=True):
            ids[where], known[where], train[where] = i, k, t
            raw, at = zstandard.ZstdDecompressor().decompress(blob), 0
            for x, kind in zip(out, ("<u4", "<u4", "<f8", "<f8"), strict=True):
                x[where] += np.frombuffer(raw, kind, len(where), at)
                at += len(where) * np.dtype(kind).itemsize
        doc = pd.array([int(i) if k else None for i, k in zip(ids, known, strict=True)], dtype="Int64")
        return pd.DataFrame({"doc_id": doc, "held_out": ~train, "n_tokens": out[0], "n_known": out[1], "train_tokens": totals.tokens, "base_score": out[2], "score": out[3] - start})

    return run


def lm_scores(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, base_weight: float = BASE_WEIGHT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    weights: of the counts after contexts of 1, 2, ... words, so the order is one more than there are. Rows whose crc32(id as
    text) leaves remainder 1 by 5 are held out; all others train. Ids are whole numbers. A null text is empty: one end token.
    Rows with equal ids, repeated rows too, are scored each and all train. With no training rows every word is unknown. An
    empty table gives no rows.
    """
    text_batches(docs)
    spark, model = docs.sparkSession, Model(weights, base_weight)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("body"))
    counts = checkpointed(src.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    end = int(END.view(np.int64))
    r = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.coalesce(F.sum(F.when(F.col("h") == end, F.col("n"))), F.lit(0))).first()
    parts = max(PARTS, -(-int(r[0]) // PART_TOKENS))
    heavy = {int(np.int64(x.h).view(np.uint64)): int(x.n) for x in counts.where(F.col("n") > int(r[0]) // (16 * parts)).collect()}  # 16 * parts words at most
    totals = Totals(*(int(x) for x in r), heavy)
    sent = src.mapInArrow(_scatter(parts, totals.heavy, model.order), "part long, chunk long, docs binary, tokens binary")
    n = min(parts, max(shuffle_partitions(spark), 1))
    sums = sent.repartition(n, "part").groupBy("part").applyInArrow(_reduce(totals, model), "chunk long, docs binary, sums binary")
    return sums.groupBy("chunk").applyInPandas(_gather(totals, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
