"""Each operator against brute force, on inputs with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, components, covertree, eliasfano, embedding, extraction, hypergeom, license, lines, lm, mixing, quality, sharding, simhash

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return (t or "").encode().split()


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "straße", "THE", "the", "über"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [text(9) for _ in range(4)]
    out = []
    for i in range(n):
        body = [text(rng.randint(0, 30)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:
            body.insert(rng.randint(0, len(body)), "  " + rng.choice(shared).upper() + "\t")
        out.append((i, "\n".join(body), rng.choice(["s1", "s2", "s3", None]), "x"))
    base = text(300)
    out += [(500 + i, base, "s1", "x") for i in range(5)] + [(600 + i, base + f" tail{i}", "s1", "x") for i in range(5)]
    out += [(900, None, "s2", None), (901, "", None, "x"), (902, "   \n\t", "s1", "x"), (903, text(5000), "s3", "x"), (904, "#*$% " * 40, "s1", "x"), (None, text(40), "s1", "x"), (None, None, None, None), (905, "one", "s2", "x"), (905, "one", "s2", "x")]
    return out


SCHEMA = "doc_id long, text string, source string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def some(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# quality -------------------------------------------------------------------------------------------------------------
def brute_repeat(ws, k=8):
    c = Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    hit = set()
    for i in range(len(ws) - k + 1):
        if c[tuple(ws[i : i + k])] > 1:
            hit.update(range(i, i + k))
    return len(hit)


def test_repeated_words():
    rng = random.Random(0)
    for n in (0, 1, 7, 8, 9, 30, 200):
        for v in (1, 2, 5, 50):
            ws = [b"%d" % rng.randrange(v) for _ in range(n)]
            assert quality.repeated_words(ws) == brute_repeat(ws)


def test_quality_report(docs, nothing):
    got = some(quality.quality_report(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t, *_ in corpus():
        ws, t = words(t), t or ""
        ls = [x for x in t.split("\n") if x.strip(SPACE)]
        n_rep = brute_repeat(ws)
        want.append((i, len(ws), sum(c not in SPACE for c in t), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), n_rep, len(ws) < 20 or 100 * n_rep > 30 * len(ws)))
    assert got == sorted(want, key=str)
    assert quality.quality_report(nothing).count() == 0


def test_cascade_order_and_verdict(docs, nothing):
    seen = []
    slow = quality.Rule("slow", lambda m: sum(i for i in range(20000)) < 0)
    cheap = quality.Rule("cheap", lambda m: seen.append(1) or True)
    assert [r.name for r in quality.order_rules(["a"] * 50, (slow, cheap))] == ["cheap", "slow"]
    # what matters is what a rule rejects after those before it, and what it costs with their measures at hand
    both = quality.Rule("both", lambda m: m.text < "c")
    late = quality.Rule("late", lambda m: m.text < "b" or sum(range(300)) < 0)
    other = quality.Rule("other", lambda m: m.text > "y" or sum(range(600)) < 0)
    assert [r.name for r in quality.order_rules(["a"] * 400 + ["b"] * 100 + ["m"] * 200 + ["z"] * 90, (late, other, both))] == ["both", "other", "late"]
    assert quality.order_rules([], quality.RULES) and quality.sample_texts(docs, "text", 10**6, 10**6).__len__() == len(corpus())
    out = quality.quality_cascade(docs.withColumn("kept", F.lit("clash")))
    assert out.columns == ["doc_id", "text", "source", "shard", "kept", "rejected_by"]
    report = {r.doc_id: r.kept for r in quality.quality_report(docs).collect() if r.doc_id is not None}
    assert {r.doc_id: r.kept for r in out.collect() if r.doc_id is not None} == report and not report[904] and not report[901]
    assert quality.quality_cascade(nothing).count() == 0


# mixing --------------------------------------------------------------------------------------------------------------
def test_targets():
    assert mixing.targets([100, 100], [5, 2]) == pytest.approx([200 * 5 / 7, 200 * 2 / 7])
    t = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert t[0] == 30 and sum(t) == pytest.approx(2010) and t[1] / t[2] == pytest.approx(2)
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


def test_mix(docs, nothing, spark):
    a = mixing.mix_report(docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, a)) == sorted(map(key, mixing.mix_report(docs.repartition(3)).collect()))
    rows = corpus()
    assert sorted(str(r.doc_id) for r in a) == sorted(str(r[0]) for r in rows)
    size = defaultdict(int)
    for _, t, s, _ in rows:
        size[s] += len(words(t))
    names = sorted(s for s in size if s is not None) + [None]
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    by_id = {i: (len(words(t)), s) for i, t, s, _ in rows if i is not None}
    taken = defaultdict(int)
    for r in a:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert r.taken == r.size * len([x for x in r.shards.split(",") if x])
        if r.doc_id is not None:
            n, s = by_id[r.doc_id]
            assert (r.size, r.source_size) == (n, size[s]) and r.target == pytest.approx(goal[s])
    for r in mixing.mixed(docs).groupBy("source").agg(F.sum("mix_taken").alias("n")).collect():
        taken[r.source] = r.n
    largest = {s: max(len(words(t)) for _, t, z, _ in rows if z == s) for s in names}
    for s in names:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    assert mixing.mix_report(nothing).count() == 0
    table = mixing.mix_table(docs, n_shards=4)
    assert table.count() == sum(len([x for x in r.shards.split(",") if x]) for r in mixing.mix_report(docs, n_shards=4).collect())
    texts = Counter((r.doc_id, r.text) for r in table.collect())
    times = Counter((i, t) for i, t, *_ in rows)
    assert all(n % times[k] == 0 and n <= 3 * times[k] for k, n in texts.items())


def test_mix_against_brute_force(spark):
    """The plan from counts by hand, and where each copy comes out: in its block's shards, in random order, copies apart."""
    rng = random.Random(33)
    rows = [(i, " ".join("w" * 3 for _ in range(rng.randint(1, 60))), rng.choice(["a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = {r.doc_id: r for r in mixing.mix_report(df, n_shards=3).collect()}
    size = {s: sum(len(words(t)) for _, t, z in rows if z == s) for s in ("a", "b", "c", None)}
    goal = dict(zip(size, mixing.targets(list(size.values()), [5, 2, 1, 5]), strict=True))
    for s in size:
        got = sum(report[i].taken for i, _, z in rows if z == s)
        assert abs(got - goal[s]) <= 2  # by brute force over block exchanges nothing is further off than a word or two here
    out = [(r.mix_shard, r.doc_id) for r in mixing.mix_table(df, n_shards=3).collect()]
    want = Counter((int(x), i) for i, r in report.items() for x in r.shards.split(",") if x)
    assert Counter(out) == want and [s for s, _ in out] == sorted(s for s, _ in out)
    twice = [k for k, n in want.items() if n > 1]
    assert not twice or sum(a == b for a, b in zip(out, out[1:], strict=False)) < len(twice) / 2
    parts = mixing.mix_table(df, n_shards=3).select(F.spark_partition_id().alias("p"), "mix_shard").distinct().count()
    assert parts == 3


def test_choose_blocks():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 256):
        sizes = rng.integers(0, 1000, n)
        for share in (0.1, 0.5, 0.9):
            need = share * sizes.sum()
            at = mixing.choose_blocks(sizes, need, rng)
            off = abs(sizes[at].sum() - need)
            assert len(set(at)) == len(at) and off <= max(sizes) / 2 and (n < 40 or off <= 5)


def test_hypergeometric_trees():
    rng = hypergeom.generator(1)
    colours, parts = np.array([50, 30, 0, 20]), np.array([40, 0, 25, 35])
    m = hypergeom.split_all(colours, parts, 7)
    assert (m.sum(axis=0) == colours).all() and (m.sum(axis=1) == parts).all()
    assert all((hypergeom.split_path(colours, parts, i, 7) == m[i]).all() for i in range(4))
    big = [hypergeom.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(big) - 3e5) < 3 * 460 / 17 * 3 and 300 < np.std(big) < 620
    assert hypergeom.hypergeometric(rng, 0, 5, 3) == 0 and hypergeom.hypergeometric(rng, 5, 0, 3) == 3
    # every way to deal two of four rows is equally likely
    c = Counter(tuple(hypergeom.split_all(np.array([2, 2]), np.array([2, 2]), s)[0]) for s in range(3000))
    assert abs(c[1, 1] / 3000 - 2 / 3) < 0.04 and abs(c[2, 0] / 3000 - 1 / 6) < 0.03


# license -------------------------------------------------------------------------------------------------------------
def test_license(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\nmore"), ("a/b/y.py", "Licensed under the Apache License, Version 2.0.\ncode here"), ("a/b/c/z.py", None), ("q/r.py", ""), ("q/mit.txt", "mit der und " * 2000),
            (None, "Licensed under CC BY-NC 4.0."), ("a/b/x.py", "code\nmore"), ("top", "x")]
    df = spark.createDataFrame([(p, t, "clash") for p, t in rows], "path string, text string, license string")
    got = some(license.license_scan(df), "path", "license", "license_basis", "license_dir")
    assert got == sorted([("a/LICENSE", "MIT", "file", None), ("a/b/x.py", "MIT", "inherited", "a"), ("a/b/x.py", "MIT", "inherited", "a"), ("a/b/y.py", "Apache-2.0", "header", None), ("a/b/c/z.py", "MIT", "inherited", "a"), ("q/r.py", None, None, None),
                          ("q/mit.txt", None, None, None), (None, "CC-BY-NC-4.0", "file", None), ("top", None, None, None)], key=str)
    assert license.license_scan(df.where("false")).count() == 0


def test_license_files_and_headers(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Foo Bar\n\n" + license._GRANT_MIT.replace(", ", ",\n") + "\n\n" + license._AS_IS_MIT
    bsd = "Copyright (c) 2019, Somebody\nAll rights reserved.\n\n" + license._TERMS_BSD + "\n\n" + license._THIRD_BSD + "\n\n" + license._AS_IS_BSD
    notice = "# " + license._FREE.format("program", "General Public License", "3").replace("; ", ": ", 1).replace(" and/or", "\n# and/or") + "\n\nimport os\n" + "value = compute(value, other)\n" * 60
    long = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n" + "The precise terms and conditions for copying follow here. " * 400
    rows = [("r/LICENSE", mit), ("r/src/a.py", "x = 1"), ("r/lib/LICENSE.txt", bsd), ("r/lib/deep/b.py", None), ("r/lib/c.py", "// SPDX-License-Identifier: Apache-2.0\ncode"), ("g/COPYING", long), ("g/d/e.c", "int main"), ("g/d/f.c", notice),
            ("n/a.py", "Released under the MIT License. Copyright 2020 Foo Bar Inc., all of it\nmore"), ("n/b.py", "we have a license to say nothing of the kind"), ("n/c.py", "/* " + license._APACHE.replace(". ", ".\n * ") + " */\n" + "value = compute(value, other)\n" * 60)]
    got = {r.path: (r.license, r.license_basis, r.license_dir) for r in license.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"r/LICENSE": ("MIT", "file", None), "r/src/a.py": ("MIT", "inherited", "r"), "r/lib/LICENSE.txt": ("BSD-3-Clause", "file", None), "r/lib/deep/b.py": ("BSD-3-Clause", "inherited", "r/lib"),
                   "r/lib/c.py": ("Apache-2.0", "header", None), "g/COPYING": ("GPL-3.0", "file", None), "g/d/e.c": ("GPL-3.0", "inherited", "g"), "g/d/f.c": ("GPL-3.0", "header", None),
                   "n/a.py": ("MIT", "header", None), "n/b.py": (None, None, None), "n/c.py": ("Apache-2.0", "header", None)}
    assert all(any(m in t.lower() for m in license.MARKERS) for _, t in license.TEMPLATES)


# SimHash -------------------------------------------------------------------------------------------------------------
def brute_fingerprint(t):
    import xxhash

    w = (t or "").translate(LOWER).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs, nothing):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(fps, 4)
    low = {}
    for r, (i, *_) in zip(root, rows, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(((i, f"{f:016x}", low.get(r)) for (i, *_), f, r in zip(rows, fps, root, strict=True)), key=str)
    assert some(simhash.near_duplicate_report(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(low.values()))
    assert simhash.near_duplicate_report(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_links_join_all_pairs(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for f in list(fps):
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randint(0, 6)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = components.components(simhash.link_fingerprints(df, 4)).collect()
    label = {int(np.int64(r.node).view(np.uint64)): r.root for r in got}
    groups = defaultdict(set)
    for f, r in zip(fps, brute_components(fps, 4), strict=True):
        groups[r].add(f)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k in label if label[k] == r) for r in set(label.values())}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# BPE -----------------------------------------------------------------------------------------------------------------
public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.mark.parametrize("name", NAMES)
def test_bpe_equals_reference_encoder(name):
    path = public_tokenizers.path(name)
    ranks = bpe.load_ranks(path)
    v, enc = bpe.Vocabulary(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    alphabet = "abcdefgh éèßΩЖ中文😀\n\t'1234 ​\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(800)] + ["a" * 3000, "ab" * 2000, " " * 500, "it's we'll they've", "<|endoftext|>", ""]
    for t in texts:
        ids = bpe.encode(v, t)
        assert ids.tolist() == enc.encode_ordinary(t) and bpe.decode(v, ids) == t.encode()


def test_prefix_table_appends_and_edits():
    v = bpe.Vocabulary(bpe.load_ranks(public_tokenizers.path(NAMES[1])), public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(300):
        data = bytes(rng.choice(b"abcde ing") for _ in range(rng.randint(0, 30)))
        p = bpe.Prefixes(v, data[:7])
        before = list(p.last)
        p.append(data[7:])
        assert p.last[: len(before)] == before and p.last == bpe.Prefixes(v, data).last
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        p.replace(a, b, b"then")
        assert p.last == bpe.Prefixes(v, data[:a] + b"then" + data[b:]).last
        text = data.decode() + " 'll\n\n x"
        e = bpe.EncodedText(v, text)
        i = rng.randint(0, len(text))
        j = rng.randint(i, len(text))
        new = "".join(rng.choice(" 'lvesn1\n") for _ in range(rng.randint(0, 5)))
        e.replace(i, j, new)
        assert e.ids() == bpe.encode(v, text[:i] + new + text[j:]).tolist()
        e.append(" more")
        assert e.ids() == bpe.encode(v, text[:i] + new + text[j:] + " more").tolist()
    long = bpe.EncodedText(v, "some words here " * 500)
    long.replace(4000, 4003, "zz")
    assert long.encoded < 30


def test_bpe_looks_up_no_substrings_and_keeps_common_pieces(monkeypatch):
    """Once the automaton's steps are made, a new piece takes a lookup as a whole; a full memo doesn't lose the pieces that keep coming."""

    class Counted(dict):
        n = 0

        def __contains__(self, key):
            Counted.n += 1
            return super().__contains__(key)

    ranks = bpe.load_ranks(public_tokenizers.path(NAMES[1]))
    v = bpe.Vocabulary(Counted(ranks), public_tokenizers.PATTERN)
    rng = random.Random(8)
    pieces = [" " + "".join(rng.choice("etaoin") for _ in range(30)) for _ in range(400)]
    for piece in pieces[:300]:
        bpe.encode_piece(v, piece)
    Counted.n = 0
    for piece in pieces[300:]:
        bpe.encode_piece(v, piece)
    assert Counted.n < 100 * 30

    made, encode_piece = [], bpe.encode_piece
    monkeypatch.setattr(bpe, "MEMO_PIECES", 20)
    monkeypatch.setattr(bpe, "encode_piece", lambda v, piece: made.append(piece) or encode_piece(v, piece))
    v = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    for k in range(200):
        assert bpe.decode(v, bpe.encode(v, f" zqzqcommon{pieces[k]}")) == f" zqzqcommon{pieces[k]}".encode()
    assert made.count(" zqzqcommon") == 1 and len(v.pieces) <= 20 and len(v.older) <= 20


def test_bpe_fills_tables_of_new_pieces_together(monkeypatch):
    """Short new pieces of several texts take no loop over their bytes; ids are the reference encoder's, however small memos and tables are."""
    filled, fill = [], bpe.Vocabulary.fill
    monkeypatch.setattr(bpe.Vocabulary, "fill", lambda v, data, *rest: filled.append(data) or fill(v, data, *rest))
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu" if rng.random() < 0.9 else "éßдж你好\U0001f600-.7 ") for _ in range(rng.randint(1, 14)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(80)] + [None, "", "x", " " * 90 + "é" * 70 + "!", "hello there"]
    for name in NAMES:
        ranks = bpe.load_ranks(public_tokenizers.path(name))
        enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for small in (False, True):
            with monkeypatch.context() as m:
                for const, n in (("MEMO_PIECES", 50), ("MEMO_STEPS", 40), ("MEMO_PAIRS", 40), ("MOST_TOGETHER", 30), ("CHUNK_CHARS", 3000)) if small else ():
                    m.setattr(bpe, const, n)
                v = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
                filled.clear()
                assert [ids.tolist() for ids in bpe.encode_all(v, texts)] == [enc.encode_ordinary(t or "") for t in texts]
                assert all(len(data) > bpe.LONGEST_TOGETHER for data in filled) or small
                assert len(v.pieces) <= bpe.MEMO_PIECES and v.array_pairs.n <= bpe.MEMO_PAIRS


def test_long_table_equals_dict():
    rng = random.Random(10)
    t, want = bpe.LongTable(100_000), {}
    for _ in range(30):
        keys = np.array([rng.choice([rng.randrange(500), rng.randrange(1 << 62)]) for _ in range(400)], np.int64)
        assert t.get(keys).tolist() == [want.get(k, -1) for k in keys.tolist()]
        assert t.get_or_make(keys, lambda k: k % 1009).tolist() == [k % 1009 for k in keys.tolist()]
        want |= {k: k % 1009 for k in keys.tolist()}
    assert t.n == len(want)


def test_bpe_query(docs, nothing):
    path = public_tokenizers.path(NAMES[1])
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = []
    for i, t, *_ in corpus():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert some(bpe.bpe_report(docs, path, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, path, public_tokenizers.PATTERN), path)
    assert all((r.text or "") == r.bpe_text for r in back.collect())
    assert bpe.bpe_report(nothing, path, public_tokenizers.PATTERN).count() == 0


# embeddings ----------------------------------------------------------------------------------------------------------
def _vectors(seed=7):
    rng = np.random.default_rng(seed)
    out, k = [], 0
    for label in (1, 2, None):
        centres = rng.normal(size=(6, 16))
        for _ in range(150):
            v = centres[rng.integers(6)] + rng.choice([0.02, 0.15, 0.3]) * rng.normal(size=16)
            out.append((k, v.astype(np.float32).tolist(), label))
            k += 1
    out += [(1000 + i, out[0][1], 1) for i in range(5)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, [float("inf")] + [1.0] * 15, 1), (2005, [1.0, 2.0], 1), (2006, [], 1), (None, out[3][1], out[3][2])]
    return out


def _brute_links(rows):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.93] for i in range(n)]
    comp = [None] * n
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((i, len(l), c, i == c) for (i, *_), l, c in zip(rows, links, comp, strict=True)), key=str)


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings(spark, block):
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, kept int")
    assert some(embedding.embedding_links(df, block=block), "vec_id", "n_links", "component_id", "kept") == _brute_links(rows)


def test_dedup_embeddings(spark):
    rows = _vectors()
    extra = [(None, [1.0] * 15 + [float(k)], 7) for k in (100, -100)] + [rows[9]]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows + extra)], "vec_id long, embedding array<float>, label int, row_key int")
    out = embedding.dedup_embeddings(df).collect()
    kept = {i for i, _, _, k in _brute_links(rows) if k and i is not None}
    assert sorted(r.vec_id for r in out if r.vec_id is not None) == sorted(kept) and sum(r.vec_id is None for r in out) == 2
    assert out[0].row_key is not None


def test_rows_sent_grow_with_the_label(spark):
    """Separated clusters: what is dealt to tasks grows as the classes do, not as their square."""
    rng = np.random.default_rng(3)
    sent = []
    for n in (2000, 8000):
        centres = rng.normal(size=(n // 50, 12))
        x = np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(n, 12))
        df = spark.createDataFrame([("a", 12, k, 1, v.tolist()) for k, v in enumerate(x)], "label string, size long, cid long, n long, vec array<double>")
        sent.append(embedding.deal(df, 0.93, 64).count() / n)
    assert sent[1] < 1.6 * sent[0], sent


def test_embeddings_empty(spark):
    assert embedding.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cover_tree_is_nested():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = covertree.CoverTree(x)
    for i, kids in enumerate(t.children):
        lo, hi = t.span[i]
        inside = t.order[lo:hi]
        assert np.linalg.norm(x[inside] - x[t.centre[i]], axis=1).max() <= t.radius[i] + 1e-6
        assert not kids or ([t.span[k][0] for k in kids][0] == lo and sum(t.span[k][1] - t.span[k][0] for k in kids) == hi - lo)


# pages ---------------------------------------------------------------------------------------------------------------
def _page(title, body, n):
    return (f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu {n % 3}</a></ul></nav><div class=\"ad\">Buy {n}</div><header>Site</header>"
            f"<article><h1>{title}</h1><p>Subscribe to our paper now<p><b>{body}<br>end {n} &amp; done</b></p><div class='comments'>first!</div></article><aside>more</aside><form><input>go</form><footer>&copy; us</footer></body></html>")


def test_pages(spark):
    rows = [(i, f"https://h.example/{i}", _page(f"T{i}", f"text  of\n page {i}", i)) for i in range(8)]
    rows += [(100 + i, "https://h.example/copy", rows[0][2]) for i in range(30)]
    rows += [(200, "https://solo.example/", "<body><div id=menu><a href=x>a</a></div>Hello <i>wor</i>ld<p>two<p hidden>no<p>three<li>x<li>y"), (201, None, None), (202, "nohost", ""), (203, "https://h.example/z", "plain words"), (204, "https://e.example/", "<p>&lt;b&gt; &eacute;&#233;<!-- <p>no --> <style>p{}</style>x"), (200, "https://solo.example/", "<p>again")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = some(extraction.extract_main_text(df), "page_id", "url", "text", "n_chars")
    want = [(i, u, f"T{k} text of page {k} end {k} & done") for i, u, k in [(i, f"https://h.example/{i}", i) for i in range(8)] + [(100 + i, "https://h.example/copy", 0) for i in range(30)]]
    want += [(200, "https://solo.example/", "Hello world two three x y"), (201, None, ""), (202, "nohost", ""), (203, "https://h.example/z", "plain words"), (204, "https://e.example/", "<b> éé x"), (200, "https://solo.example/", "again")]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert extraction.extract_main_text(df.where("false")).count() == 0


def _soup(k, story):
    """A page without telling names: only repetition over the host's pages says what is what."""
    tip = ("Read our terms before you write to us", "Prices include all taxes", "Open from nine to five")[k % 3]
    return f"<html><body><div><div>Front page</div><div>Contact</div></div><div><h1>{story} {k}</h1><p>{story} opens, part {k}.<p>It closes with {story} again, {k} times.</div><section><p>{tip}</section><div>All rights reserved</div></body></html>"


def test_template_finds_the_article_without_names(spark):
    rows = [(k, f"http://soup.example/{k}", _soup(k, f"Story{k}")) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {k: f"Story{k} {k} Story{k} opens, part {k}. It closes with Story{k} again, {k} times." for k in range(40)}
    assert {r.page_id: r.text for r in extraction.extract_main_text(df).collect()} == want
    without = {r.page_id: r.text for r in extraction.extract_main_text(df, min_pages=1000).collect()}
    assert all(len(without[k]) > len(want[k]) and want[k] in without[k] for k in want)


def test_template_against_brute_force(spark):
    pages = [_soup(k, f"S{k}") if k % 10 else "<p>odd" for k in range(30)] + [_page(f"T{k}", f"t {k}", k) for k in range(30)]
    hosts = [1] * 30 + [2] * 30
    df = spark.createDataFrame([(h, x) for h, x in zip(hosts, pages, strict=True)], "host long, html string")
    got = {r.host: {t.token: (t["class"], t.root) for t in r.template} for r in extraction.templates(df, share=0.5).collect()}
    for host in (1, 2):
        seen, distinct = defaultdict(dict), {}
        for h, x in zip(hosts, pages, strict=True):
            tags, blocks = extraction.parse(x)
            if h == host:
                distinct[extraction.page_key(x, blocks)] = Counter([t for t, _ in tags] + [extraction._text_token(b) for b in blocks])
        for k, tokens in distinct.items():
            for t, n in tokens.items():
                seen[t][k] = max(n, seen[t].get(k, 0))
        most = max(len(v) for v in seen.values())
        want = {t: frozenset(v.items()) for t, v in seen.items() if len(v) >= 5 and len(v) >= 0.5 * most}
        assert set(got[host]) == set(want)
        for a in want:  # one class for one occurrence vector, and the root is what all pages have once
            assert got[host][a][1] == (len(want[a]) == most and all(n == 1 for _, n in want[a]))
            for b in want:
                assert (got[host][a][0] == got[host][b][0]) == (want[a] == want[b])


def test_near_copies_keep_shared_paragraphs(spark):
    """A host whose pages are near copies of one article: what they share is the article, not its template."""
    shared = "<p>Water rises twice a day along this coast, as the tables say.<p>Boats leave at dawn and come back with the tide."
    rows = [(k, f"http://mirror.example/{k}", f"<body><div class='site-header'>Home</div><article><h1>The tide</h1>{shared}<p>Seen {k}.</article></body>") for k in range(9)]
    got = {r.page_id: r.text for r in extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"The tide Water rises twice a day along this coast, as the tables say. Boats leave at dawn and come back with the tide. Seen {k}." for k in range(9)}


def test_nothing_else_is_dropped():
    two = "<article><p>A long first part of the story</p></article><article><p>short</p></article><p>not in it"
    assert extraction.main_text(two) == "A long first part of the story short"
    assert extraction.main_text("<p class='social-history'>kept<p class='notice-of-award'>too<p class='site-nav'>not<p class='notice'>nor") == "kept too"
    assert extraction.main_text("<h2><a href='/x'>A headline that is a link</a></h2><p>text") == "A headline that is a link text"
    assert extraction.main_text("a < b and <3 but <b>bold</b> &lt;i&gt;") == "a < b and <3 but bold <i>"
    assert extraction.main_text("<p title='a > b'>x<br>y<p title=\"it's\">z") == "x y z"


def test_markup_in_linear_time():
    import time

    for text in ("<a " * 700_000, '<p a="x ' * 250_000, "<b>" * 300_000 + "<div>" * 200_000, "<" * 2_000_000, "<a " + "x" * 2_000_000 + ">", "<!--" * 500_000, "<table><tr><td>" * 100_000, "<p>" + "word " * 400_000):
        began = time.perf_counter()
        extraction.main_text(text)
        assert time.perf_counter() - began < 20, text[:20]


# sharding ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("cell", [200_000, 3])
def test_sharding(docs, nothing, cell):
    rows = corpus()
    got = sharding.shard_report(docs, cell_rows=cell).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    n = [len(by[s]) for s in range(16)]
    assert max(n) - min(n) <= 1 and sum(n) == len(rows) and all(sorted(x) == list(range(len(x))) for x in by.values())
    wide = sharding.shard_uniform(docs, 3, cell_rows=cell)
    assert wide.columns == ["doc_id", "text", "source", "shard", "slot"] and some(wide, "doc_id", "text", "source") == sorted((r[:3] for r in rows), key=str)
    assert sharding.shard_report(nothing).count() == 0


def test_sharding_is_uniform(spark):
    df = spark.range(8).repartition(3).cache()
    c = Counter()
    for seed in range(40):
        for r in sharding.shard_uniform(df, 2, seed=seed).collect():
            c[r.id, r.shard] += 1
    assert all(8 <= c[i, s] <= 32 for i in range(8) for s in range(2))


# LM ------------------------------------------------------------------------------------------------------------------
def test_elias_fano():
    rng = np.random.default_rng(9)
    for top in (1, 10, 1000, 1 << 40, (1 << 64) - 1):
        for n in (0, 1, 2, 500):
            a = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            e = eliasfano.EliasFano(*eliasfano.EliasFano.pack(a))
            q = np.concatenate([a, rng.integers(0, top, 50, dtype=np.uint64, endpoint=True)])
            assert (e.get(np.arange(n)) == a).all() and (e.successor(q) == np.searchsorted(a, q)).all()


def test_trie():
    rng = np.random.default_rng(10)
    grams = np.unique(rng.choice(rng.integers(0, 1 << 63, 12, dtype=np.uint64), (400, 3)), axis=0)
    words, at1 = np.unique(grams[:, 0], return_inverse=True)
    two = np.unique(np.stack([at1.astype(np.uint64), grams[:, 1]], 1), axis=0)
    at2 = np.array([next(i for i, t in enumerate(two) if t[0] == p and t[1] == c) for p, c in zip(at1, grams[:, 1], strict=True)])
    three = np.unique(np.stack([at2.astype(np.uint64), grams[:, 2]], 1), axis=0)
    levels = [(two[:, 0].astype(np.int64), two[:, 1]), (three[:, 0].astype(np.int64), three[:, 1])]
    values = [[rng.normal(size=len(x))] for x in (words, two, three)]
    t = eliasfano.Trie(words, levels, values)
    assert (t.find_words(words) == np.arange(len(words))).all() and t.find_words(np.array([1, (1 << 64) - 1], dtype=np.uint64)).tolist() == [-1, -1]
    for k, (parents, contexts) in enumerate(levels, 1):
        assert (t.find_children(k, parents, contexts) == np.arange(len(parents))).all()
        there = {*zip(parents.tolist(), contexts.tolist(), strict=True)}
        ask = [(int(p), int(c)) for p in range(parents.max() + 1) for c in grams[:20].ravel()]
        got = t.find_children(k, np.array([p for p, _ in ask]), np.array([c for _, c in ask], dtype=np.uint64))
        assert [g >= 0 for g in got] == [a in there for a in ask]
        assert np.abs(t.value(k + 1, 0, np.arange(len(parents))) - values[k][0]).max() < 1e-3
    assert (t.find_children(1, np.zeros(1, np.int64), np.array([3], dtype=np.uint64)) == -1).all()
    t.close()


@pytest.mark.parametrize("weights", [lm.WEIGHTS, (1.0,), (2.0, 40.0)])
def test_lm(docs, nothing, monkeypatch, weights):
    monkeypatch.setattr(lm, "PARTS", 6)
    monkeypatch.setattr(lm, "ROUND_TOKENS", 900)
    rows, order = [(i, (t or "").translate(LOWER).encode().split()) for i, t, *_ in corpus()], len(weights) + 1
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    grams, n_docs = Counter(), 0
    for i, ws in rows:
        if not held(i):
            n_docs += 1
            seq = [b"<s>"] * (order - 1) + [*ws, b"</s>"]
            for at in range(order - 1, len(seq)):
                for k in range(order):
                    grams[tuple(seq[at - k : at + 1])] += 1
    c = {g[0]: x for g, x in grams.items() if len(g) == 1}
    n, types = sum(c.values()), len(c)
    ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    p = lambda w: (c[w] - d) / n if w in c else d * types / n
    ctx = lambda h: n_docs if set(h) == {b"<s>"} else grams[h]

    def prob(h, w):
        num = sum(a * grams[(*h[-k:], w)] for k, a in enumerate(weights, 1)) + lm.BASE_WEIGHT * p(w)
        return num / (sum(a * ctx(h[-k:]) for k, a in enumerate(weights, 1)) + lm.BASE_WEIGHT)

    want = {}
    for i, ws in rows:
        toks = [*ws, b"</s>"]
        seq = [b"<s>"] * (order - 1) + toks
        base = sum(np.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (types + 1))) for w in toks)
        score = sum(np.log10(prob(tuple(seq[at - order + 1 : at]), seq[at])) for at in range(order - 1, len(seq)))
        want[i, len(toks)] = (held(i), sum(w in c for w in toks), n, base, score)
    got = lm.lm_scores(docs, weights=weights).collect()
    assert len(got) == len(rows)
    for r in got:
        h, known, total, base, score = want[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (h, known, total) and r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=2e-4 * r.n_tokens)
    # probabilities sum to one over all known words, the end and the unknown word
    for h in ((b"<s>",) * (order - 1), (b"w1",) * (order - 1), tuple(rows[0][1][: order - 1])):
        assert sum(prob(h, w) for w in [*c, b"never seen"]) == pytest.approx(1.0)
    assert lm.lm_scores(nothing).count() == 0


def test_lm_tells_seen_texts(spark):
    """A held-out text that training has too scores apart from one that it hasn't, at equal words."""
    rng = random.Random(8)
    new = lambda: " ".join(f"v{min(rng.randrange(300), rng.randrange(300))}" for _ in range(80))
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [i for i in range(4000) if i not in set(held)]
    rows = [(i, new()) for i in train[:600]] + [(i, new()) for i in held[:100]]
    twins = {h: t for h, t in zip(held[100:130], train[600:630], strict=True)}
    for h, t in twins.items():
        text = new()
        rows += [(h, text), (t, text)]
    got = [(r.doc_id, r.score / r.n_tokens) for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()]
    assert min(s for i, s in got if i in twins) > max(s for i, s in got if i not in twins)

def test_lm_messages_in_little_memory(monkeypatch):
    """A worker holds few arrays of a chunk's length, and gives messages back a few at a time."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 20_000) % 30_000) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], ["doc", "body"])
    heavy = np.unique([xxhash.xxh3_64_intdigest(f"w{k}".encode()) for k in range(1, 60)]).astype(np.uint64)
    monkeypatch.setattr(lm, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    monkeypatch.setattr(lm, "SEND_BYTES", 200_000, raising=False)
    tracemalloc.start()
    sent = [b.num_rows for b in lm._scatter(24, heavy, 4)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1] / (60 * 20_001)
    tracemalloc.stop()
    assert sum(sent) == 24 and len(sent) > 1
    assert peak < 50  # bytes a token; 75 when all contexts and messages of a chunk were held


# lines ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("max_bits", "per_line"), [(1 << 30, 32), (1 << 20, 32), (1 << 20, 8192)])
def test_lines(docs, nothing, max_bits, per_line):
    rows = corpus()
    key = lambda x: x.strip(SPACE).translate(LOWER)
    holders = defaultdict(list)
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(i)
    drop = {k: max((x for x in v if x is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    want = []
    for i, t, *_ in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if key(x) not in drop or drop[key(x)] == i]
        want.append((i, len(ls), len(ls) - len(stay), "\n".join(stay)))
    assert drop and some(lines.dedup_lines(docs, max_bits=max_bits, bits_per_line=per_line), "doc_id", "n_lines", "n_dropped", "kept") == sorted(want, key=str)
    assert lines.dedup_lines(nothing).count() == 0


def test_full_filter_changes_nothing(docs, monkeypatch):
    """A filter in which nearly every bit is set lets all lines through to the exact count."""
    want = some(lines.dedup_lines(docs), "doc_id", "n_dropped", "kept")
    monkeypatch.setattr(lines, "positions", lambda keys, bits: keys & np.uint64(7))
    assert some(lines.dedup_lines(docs), "doc_id", "n_dropped", "kept") == want


def test_near_copies_of_a_page_count_once(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><!-- ad {0} --><script>track({0})</script><article><h1>The tide</h1><p>Water rises twice a day along this coast, as the tables say.</p></article></body></html>"
    df = spark.createDataFrame([(k, f"http://mirror.example/{k}", page.format(k)) for k in range(7)], "page_id long, url string, html string")
    assert {r.text for r in extraction.extract_main_text(df).collect()} == {"The tide Water rises twice a day along this coast, as the tables say."}


def test_sharding_moves_texts(spark, monkeypatch):
    seen, real = [], sharding.shard_uniform
    monkeypatch.setattr(sharding, "shard_uniform", lambda d, **o: seen.append(d.columns) or real(d, **o))
    rows = [(k, f"text {k}" if k % 7 else None) for k in range(50)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=3).collect()
    assert seen == [["doc_id", "text"]] and sorted((r.doc_id, r.size) for r in got) == [(k, len(t or "") + 1) for k, t in rows]


def test_parities_never_rule_out_a_similar_pair():
    from tidemark.llm import nearcopies

    rng = np.random.default_rng(4)
    for n in (1, 15, 16, 17, 150, 1000):
        for away in (0, 1, n // 9, n // 5):
            s = np.unique(rng.integers(0, 1 << 64, n + away, dtype=np.uint64))
            a, b = nearcopies.parity(s[:n]), nearcopies.parity(s[away:])
            while len(a) != len(b):
                a, b = (x if len(x) == min(len(a), len(b)) else x[: len(x) // 2] ^ x[len(x) // 2 :] for x in (a, b))
            assert 64 * len(a) >= 4 * n and np.bitwise_count((a ^ b).view(np.uint64)).sum() <= 2 * away


def test_few_pairs_of_a_group_below_the_threshold_are_checked(spark, monkeypatch, tmp_path):
    """Copies of one text, each edited in four places, are no near copies of each other; two in the group are."""
    import corpus_pipeline as cp

    from tidemark.llm import nearcopies

    def counting(least, log=str(tmp_path / "checked")):
        @F.arrow_udf("boolean")
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            out = []
            for x, y in zip(a, b, strict=True):
                x, y = (set(np.frombuffer(z.as_py(), np.uint64).tolist()) for z in (x, y))
                out.append(len(x & y) >= least * len(x | y))
            with open(log, "a") as f:
                f.write(f"{len(out)}\n")
            return pa.array(out, pa.bool_())

        return run

    monkeypatch.setattr(nearcopies, "_check", counting)
    rng = random.Random(31)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(600):
        edited = list(base)
        for k, at in enumerate((10, 45, 80, 115)):
            edited[at + rng.randrange(20)] = f"e{i}x{k}"
        rows.append((i, " ".join(edited)))
        if i % 60 == 7:
            edited[70] = "again"
            rows.append((1000 + i, " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, df, "").collect()) == list(range(600))
    assert sum(map(int, (tmp_path / "checked").read_text().split())) < 60_000


def test_near_copies(spark):
    import corpus_pipeline as cp

    rng = random.Random(21)
    rows, want = [], set()
    for i in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(100, 300))]
        rows.append((10 * i, " ".join(base)))
        edited = list(base)
        for at in rng.sample(range(len(base)), 1 + i % 3):
            edited[at] = "edited"
        rows.append((10 * i + 1, " ".join(edited)))
    rows += [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9002, "a b")]
    sets = [set(zip(*[words(t.translate(LOWER) if t else t)[k:] for k in range(5)], strict=False)) or {tuple(words(t.translate(LOWER) if t else t))} for _, t in rows]
    up = list(range(len(rows)))
    hits = 0
    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                hits += 0.8 <= len(sets[a] & sets[b]) / len(sets[a] | sets[b]) <= 0.95
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    want = sorted(min(rows[k][0] for k in range(len(rows)) if up[k] == r) for r in set(up))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert hits >= 20 and sorted(r.doc_id for r in cp.drop_near_copies(spark, df, "").collect()) == want


# pipeline ------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    rows = [(i, t, "en", s, len(t or "")) for i, t, s, _ in corpus(200, 12) if i is not None] + [(700 + i, " ".join(f"k{rng.randrange(400)}" for _ in range(60)), "en", "s2", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(cp.STAGES) - 1 or out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        sizes.append(docs.count())
    assert sizes[0] < len(rows) and sizes[2] <= sizes[1] <= sizes[0] and sizes[4] == sizes[3] > 0
    assert {700 + i for i in range(60)} <= {r.doc_id for r in spark.read.parquet(str(tmp_path / "s2")).collect()}
    one = next(r for r in docs.collect())
    assert len(one.bpe_ids) == one.bpe_n


def test_library_stands_without_this_package():
    import re

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for d, _, names in os.walk(os.path.join(root, "tidemark")):
        if os.path.basename(d) != "llm" and "__pycache__" not in d:
            for n in (n for n in names if n.endswith(".py")):
                assert not re.search(r"tidemark\.llm|from tidemark import .*llm", open(os.path.join(d, n)).read()), n


def test_counting_words(spark):
    texts = ["", None, " a\tb\x0bc\x0c\rd\n", "é x y z", "x" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.n for r in df.select("i", common.n_words(F.col("t")).alias("n")).orderBy("i").collect()] == [len(words(t)) for t in texts]


def test_clashing_columns(spark):
    """Columns of the input that are named like working columns are carried unharmed."""
    names = ["p_source", "p_shard", "mix_block", "row_key", "cell", "cell_of", "order_key", "h_license", "n_dir", "dir", "row", "body", "key", "fp", "drop_keys", "first_failure", "bpe_", "line_result"]
    df = spark.createDataFrame([(i, f"some words number {i} " * 9, "s", "d/f", *[f"{n}{i}" for n in names]) for i in range(6)], "doc_id long, text string, source string, path string, " + ", ".join(f"{n} string" for n in names))
    path = public_tokenizers.path(NAMES[1])
    for out in (mixing.mixed(df), sharding.shard_uniform(df, 2), license.license_scan(df), lines.dedup_lines(df), simhash.drop_near_duplicates(df), quality.quality_cascade(df), bpe.bpe_encode(df, path, public_tokenizers.PATTERN)):
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
