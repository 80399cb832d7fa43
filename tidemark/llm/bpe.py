"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one encoding, so one last token; a token can follow another if and only if BPE, given
the bytes of both, yields these two. The table of last tokens is therefore filled from left to right, with exact appends:
earlier entries never change. Reading it backwards gives the ids. After an edit the table is valid up to the edit.
An automaton over the tokens' beginnings (Aho-Corasick) names the tokens that end at each byte, the longest first, so no
substring is looked up; its steps are made when first taken. New pieces of several texts fill their tables together, a byte
of each at a time, in arrays.
"""

import base64
import hashlib
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_names, text_batches, text_udf, worker_cache

#: Distinct pieces whose ids a worker keeps in each of two memos; when the newer is full the older goes, but for pieces met since.
MEMO_PIECES = 50_000
MEMO_PAIRS = 250_000
MEMO_STEPS = 250_000
#: New pieces that fill their tables together: at least so many, at most so many, and none longer than so many bytes.
TOGETHER, MOST_TOGETHER, LONGEST_TOGETHER = 48, 16_384, 64
#: Characters of texts whose pieces are looked up together; a longer text is taken alone.
CHUNK_CHARS = 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class LongTable:
    """Values from 0 up by key (longs from 0 up), looked up for whole arrays; open addressing. Emptied when it holds `most` keys."""

    def __init__(self, most: int):
        self.most = most
        self.empty(12)

    def empty(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that aren't held."""
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        held, out = self.keys[at], self.values[at]
        left = np.flatnonzero((held != keys) & (held != -1))
        at = at[left]
        while left.size:
            at = (at + 1) & (len(self.keys) - 1)
            held, out[left] = self.keys[at], self.values[at]
            on = (held != keys[left]) & (held != -1)
            left, at = left[on], at[on]
        return out

    def put(self, key: int, value: int) -> None:
        """Adds a key that isn't held."""
        if self.n >= self.most:
            self.empty(12)
        elif 2 * self.n >= len(self.keys):
            held = self.keys >= 0
            old = self.keys[held].tolist(), self.values[held].tolist()
            self.empty(self.bits + 1)
            for k, x in zip(*old, strict=True):
                self.put(k, x)
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
        while self.keys[at] != -1:
            at = (at + 1) & (len(self.keys) - 1)
        self.keys[at], self.values[at], self.n = key, value, self.n + 1

    def get_or_make(self, keys: np.ndarray, make) -> np.ndarray:
        """The values; make gives that of a key not held."""
        out = self.get(keys)
        if (new := np.flatnonzero(out < 0)).size:
            names, which = np.unique(keys[new], return_inverse=True)
            made = [make(k) for k in names.tolist()]
            for k, x in zip(names.tolist(), made, strict=True):
                self.put(k, x)
            out[new] = np.array(made, np.int32)[which]
        return out


class Vocabulary:
    """Ranks, what may follow what, and memos; built once in a worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.good: dict[bytes, int | None] = {}
        #: States are the beginnings of tokens: names, and for each state reached the tokens that end in it, with their lengths.
        self.starts = sorted({b""} | {t[:n] for t in ranks for n in range(len(t) + 1)})
        self.state_of = {t: k for k, t in enumerate(self.starts)}
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.starts)
        self.steps: dict[int, int] = {}
        self.spines: dict[tuple[bytes, bool], tuple | None] = {}
        self.table = [self.bytes_of.get(i) for i in range(max(self.bytes_of, default=-1) + 1)]
        #: The same for arrays: lengths of tokens, the longest token that ends in a state, the next shorter one that ends a token.
        self.lengths = np.array([len(t or b"") for t in self.table], np.int32)
        self.first = np.full(len(self.starts), -1, np.int32)
        self.shorter = np.full(len(self.table), -1, np.int32)
        self.array_steps, self.array_pairs = LongTable(MEMO_STEPS), LongTable(MEMO_PAIRS)

    def merge(self, data: bytes, least: int = 1) -> list[bytes]:
        """BPE of a short string by definition: the leftmost pair of least rank, again and again, down to `least` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def id_of(self, token: bytes) -> int | None:
        """The id of a token that BPE makes of its own bytes; None for other strings."""
        if (i := self.good.get(token, -1)) == -1:
            i = self.good[token] = self.ranks[token] if self.merge(token) == [token] else None
        return i

    def spine(self, token: bytes, right: bool) -> tuple[tuple[bytes, int], ...] | None:
        """The tokens at one end of a token while BPE builds it, from the single byte up, each with its rank.

        None if a rank falls on the way; order of ranks is then not order of merges.
        """
        key = (token, right)
        if key not in self.spines:
            if len(token) == 1:
                found = ((token, -1),)
            else:
                parts = self.merge(token, 2)
                below = self.spine(parts[-1 if right else 0], right)
                rank, inner = self.ranks[token], max(self.height(p) for p in parts)
                found = None if below is None or rank <= inner else (*below, (token, rank))
            self.spines[key] = found
        return self.spines[key]

    def height(self, token: bytes) -> int:
        return -1 if len(token) == 1 else self.ranks[token]

    def follows(self, i: int, j: int) -> bool:
        """Whether BPE of the bytes of both tokens yields just these: no merge across the border comes first."""
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        ok = self.pairs[i << 32 | j] = self.holds(i << 32 | j)
        return ok

    def holds(self, pair: int) -> bool:
        """The same for the ids of both in one number, without the memo."""
        a, b = self.table[pair >> 32], self.table[pair & 0xFFFFFFFF]
        x, y = self.spine(a, True), self.spine(b, False)
        return self._border_holds(x, y) if x and y else self.merge(a + b) == [a, b]

    def step(self, key: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The state after a byte, << 8, and its tokens; key: the state before << 8 | the byte.

        The new state is the longest end of both that begins a token, 0 (the empty one) for a byte that begins none.
        """
        if len(self.steps) >= MEMO_STEPS:
            self.steps.clear()
        at = self.next_state(key)
        self.steps[key] = found = (at << 8, self.ends[at])
        return found

    def next_state(self, key: int) -> int:
        """The same state, not shifted, without the memo; its tokens are known from then on."""
        read = self.starts[key >> 8] + bytes((key & 255,))
        at = next(k for n in range(len(read) + 1) if (k := self.state_of.get(read[n:])) is not None)
        if self.ends[at] is None:
            name = self.starts[at]
            tokens = [name[n:] for n in range(len(name)) if name[n:] in self.ranks]
            self.ends[at] = ends = tuple((i, len(t)) for t in tokens if (i := self.id_of(t)) is not None)
            chain = [i for i, _ in ends]
            if chain:
                self.first[at] = chain[0]
                self.shorter[chain[:-1]] = chain[1:]
        return at

    def state_after(self, data: bytes) -> int:
        state = 0
        for byte in data[-self.longest :]:
            state = (self.steps.get(state | byte) or self.step(state | byte))[0]
        return state

    def fill(self, data: bytes, last: list[int | None], state: int = 0) -> int:
        """Appends the last tokens of the prefixes that end in data to `last`, which has those of all shorter prefixes.

        None stands for prefixes that no tokens make, and for the empty one. state: of the automaton before data, << 8; the one
        after is returned.
        """
        steps, pairs, end = self.steps, self.pairs, len(last)
        for byte in data:
            state, ends = steps.get(state | byte) or self.step(state | byte)
            for i, n in ends:
                if n == end:
                    last.append(i)
                    break
                before = last[end - n]
                if before is not None:
                    ok = pairs.get(before << 32 | i)
                    if ok or ok is None and self.follows(before, i):
                        last.append(i)
                        break
            else:
                last.append(None)
            end += 1
        return state

    def fill_together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (none empty) as little-endian unsigned 32-bit integers; the tables of fill() are rows of one array."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        data, states = np.frombuffer(b"".join(pieces), np.uint8), np.zeros(len(pieces), np.int64)
        longer = len(pieces) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        last = np.full((sizes[0] + 1, len(pieces)), -1, np.int32)
        for end, n in enumerate(longer.tolist(), 1):
            at = self.array_steps.get_or_make(states[:n] << 8 | data[starts[:n] + (end - 1)], self.next_state)
            states[:n] = at
            token = self.first[at]
            open_ = np.flatnonzero(token >= 0)
            token = token[open_]
            while open_.size:
                size = self.lengths[token]
                before, ok = last[end - size, open_], size == end
                asked = np.flatnonzero(before >= 0)
                ok[asked] = self.array_pairs.get_or_make(before[asked].astype(np.int64) << 32 | token[asked], self.holds) == 1
                last[end, open_[ok]] = token[ok]
                open_, token = open_[~ok], self.shorter[token[~ok]]
                on = token >= 0
                open_, token = open_[on], token[on]
        rounds, left, who = [], sizes.copy(), np.arange(len(pieces))
        while who.size:
            token = last[left[who], who]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a byte of the text")
            ids = np.zeros(len(pieces), "<u4")
            ids[who] = token
            rounds.append((ids, who))
            left[who] -= self.lengths[token]
            who = who[left[who] > 0]
        counts = np.zeros(len(pieces), np.int64)
        for _, who in rounds:
            counts[who] += 1
        packed, width = np.array([ids for ids, _ in rounds[::-1]], "<u4").T.tobytes(), 4 * len(rounds)
        out: list[bytes] = [b""] * len(pieces)
        for k, (at, n) in enumerate(zip(order.tolist(), counts.tolist(), strict=True)):
            out[at] = packed[(k + 1) * width - 4 * n : (k + 1) * width]
        return out

    def _border_holds(self, x, y) -> bool:
        end, i, j, ranks = 1 << 60, 0, 0, self.ranks
        while True:
            left = x[i + 1][1] if i + 1 < len(x) else end
            right = y[j + 1][1] if j + 1 < len(y) else end
            across = ranks.get(x[i][0] + y[j][0], end)
            if across < left and across <= right:  # of equal ranks the leftmost pair goes first
                return False
            if left == right == end:
                return True
            if left <= right:
                i += 1
            else:
                j += 1


class Prefixes:
    """The last token of every prefix of a byte string; entry 0 stands for the empty prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.state = vocabulary, b"", [None], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.state = self.v.fill(more, self.last, self.state)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put new in place of data[start:end]; entries up to start stay."""
        tail = self.data[end:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.state = self.v.state_after(self.data)
        self.append(new + tail)

    def ids(self) -> list[int]:
        return walk_back(self.v, self.last)


def walk_back(v: Vocabulary, last: list[int | None]) -> list[int]:
    out, at, table = [], len(last) - 1, v.table
    while at:
        if (i := last[at]) is None:
            raise ValueError("the vocabulary lacks a byte of the text")
        out.append(i)
        at -= len(table[i])
    out.reverse()
    return out


def encode_piece(v: Vocabulary, piece: str) -> list[int]:
    """Ids of one match of the pattern; a piece that is a token as a whole is that token."""
    data = piece.encode()
    if (i := v.ranks.get(data)) is not None:
        return [i]
    last: list[int | None] = [None]
    v.fill(data, last)
    return walk_back(v, last)


def encode(v: Vocabulary, text: str | None) -> np.ndarray:
    """Ids of a whole text, each match of the pattern separately; a null text has none."""
    return encode_chunk(v, [text])[0]


def encode_all(v: Vocabulary, texts: list[str | None]):
    """Ids of each text in turn; pieces that no memo has are encoded together for CHUNK_CHARS characters of texts."""
    at = 0
    while at < len(texts):
        end, chars = at + 1, len(texts[at] or "")
        while end < len(texts) and (chars := chars + len(texts[end] or "")) <= CHUNK_CHARS:
            end += 1
        yield from encode_chunk(v, texts[at:end])
        at = end


def encode_chunk(v: Vocabulary, texts: list[str | None]) -> list[np.ndarray]:
    pieces = [v.pattern.findall(text or "") for text in texts]
    rows = [list(map(v.pieces.get, row)) for row in pieces]
    gaps = [[k for k, ids in enumerate(row) if ids is None] if None in row else [] for row in rows]
    made = {piece: v.older.get(piece) for row, gap in zip(pieces, gaps, strict=True) for piece in map(row.__getitem__, gap)}
    made |= encode_pieces(v, [piece for piece, ids in made.items() if ids is None])
    for piece, ids in made.items():
        if len(piece) <= 64:
            if len(v.pieces) >= MEMO_PIECES:
                v.older, v.pieces = v.pieces, {}
            v.pieces[piece] = ids
    for row, names, gap in zip(rows, pieces, gaps, strict=True):
        for k in gap:
            row[k] = made[names[k]]
    return [np.frombuffer(b"".join(row), dtype="<u4") for row in rows]


def encode_pieces(v: Vocabulary, pieces: list[str]) -> dict[str, bytes]:
    """Packed ids of different pieces: a few and long ones one at a time, others together."""
    out: dict[str, bytes] = {}
    rest: list[tuple[str, bytes]] = []
    for piece in pieces:
        data = piece.encode()
        if (i := v.ranks.get(data)) is not None:
            out[piece] = struct.pack("<I", i)
        elif len(pieces) < TOGETHER or not 0 < len(data) <= LONGEST_TOGETHER:
            out[piece] = struct.pack(f"<{len(ids := encode_piece(v, piece))}I", *ids)
        else:
            rest.append((piece, data))
    for at in range(0, len(rest), MOST_TOGETHER):
        part = rest[at : at + MOST_TOGETHER]
        out |= zip((piece for piece, _ in part), v.fill_together([data for _, data in part]), strict=True)
    return out


def decode(v: Vocabulary, ids) -> bytes:
    return b"".join(map(v.table.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))


class EncodedText:
    """A text with its pieces' ids, kept up to date under edits; only pieces near an edit are encoded again."""

    #: Pieces depend on characters a little ahead; splitting starts again this many pieces before an edit.
    BACK = 4

    def __init__(self, v: Vocabulary, text: str = ""):
        self.v, self.text = v, text
        self.spans = [(m.start(), m.end(), encode_piece(v, m.group())) for m in v.pattern.finditer(text)]
        self.encoded = len(self.spans)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        import bisect

        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect.bisect_left(self.spans, start, key=lambda s: s[1]) - self.BACK)
        at = self.spans[first][0] if first < len(self.spans) else (self.spans[-1][1] if self.spans else 0)
        if first == 0:
            at = 0
        old = {s[0] + shift: k for k, s in enumerate(self.spans) if s[0] >= end}
        spans, self.encoded = self.spans[:first], 0
        for m in self.v.pattern.finditer(text, at):
            if m.start() >= start + len(new) and (k := old.get(m.start())) is not None:
                spans += [(a + shift, b + shift, ids) for a, b, ids in self.spans[k:]]
                break
            spans.append((m.start(), m.end(), encode_piece(self.v, m.group())))
            self.encoded += 1
        self.text, self.spans = text, spans

    def ids(self) -> list[int]:
        return [i for _, _, ids in self.spans for i in ids]


CACHE = "bpe"


def vocabulary(shared, pattern: str) -> Vocabulary:
    """The worker's vocabulary of broadcast ranks, made once."""
    ranks, digest = shared.value
    key = digest + pattern
    made = worker_cache(CACHE)
    if key not in made:
        made.clear()
        made[key] = Vocabulary(ranks, pattern)
    return made[key]


def bpe_encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with bpe_ids (array of int), bpe_n, bpe_ids_sha256 and bpe_decoded_sha256 of ids and of the bytes they decode to.

    The ranks at `path` are read by the driver and broadcast: their size is that of the vocabulary. Null and empty texts
    have no ids. Special tokens are ordinary text. Columns of docs with these names are replaced.
    """
    text_batches(docs)
    ranks = load_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()))
    kind = "n long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    @text_udf(kind, CACHE)
    def run(texts):
        v, out = vocabulary(shared, pattern), []
        for ids in encode_all(v, texts):
            row = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(v, ids)).hexdigest())
            out.append((*row, ids.astype(np.int32)) if with_ids else row)
        return out

    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("bpe_ids", "bpe_n", "bpe_ids_sha256", "bpe_decoded_sha256")]
    got, = own_names(docs, "bpe_result")
    out = docs.select(*cols, run(F.col(f"`{text_col}`").cast("string")).alias(got))
    extra = [F.col(f"{got}.{c}").alias(f"bpe_{c}") for c in ("n", "ids_sha256", "decoded_sha256")]
    return out.select(*cols, *extra, *([F.col(f"{got}.ids").alias("bpe_ids")] if with_ids else []))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "bpe_ids") -> DataFrame:
    """rows with bpe_text, the decoded text of ids_col; null ids give an empty text. A column bpe_text of rows is replaced."""
    ranks = load_ranks(path)
    shared = rows.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})

    @text_udf("string")
    def run(lists):
        of = shared.value
        return [b"".join(map(of.__getitem__, x)).decode("utf-8", "replace") if x is not None else "" for x in lists]

    return rows.withColumn("bpe_text", run(F.col(ids_col)))


def bpe_report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = bpe_encode(rows, path, pattern, with_ids=False)
    return out.select("doc_id", F.col("bpe_n").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"))
