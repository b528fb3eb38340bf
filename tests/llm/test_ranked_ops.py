"""Operators 4, 9 and 10 and the token files of operator 2 against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bitslice, simhash, tokenstore, topk
from tessera.llm.sharding import interleave
from tessera.llm.topk import histogram_topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, fp string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 9, "x") for i, t, s in rows], DOCS)


def test_interleave_matches_mixture(spark):
    rows = [(i, f"text {i}" if i % 7 else None, "hot" if i % 3 == 0 else ("a" if i % 3 == 1 else None)) for i in range(500)]
    rows += rows[:10]
    out = interleave(docs_of(spark, rows), 16).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
        assert r.size == len(("text %d" % r.doc_id).encode() if r.doc_id % 7 else b"") + 1
        assert r.text_crc32 == zlib.crc32(b"text %d" % r.doc_id if r.doc_id % 7 else b"")
    sizes = [len(v) for v in by.values()]
    assert len(by) == 16 and max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    share = Counter(s for _, _, s in rows)
    for v in by.values():
        for s, n in Counter(r.source for r in v).items():
            assert abs(n - share[s] / 16) <= 3


def test_interleave_against_plain_ranks(spark):
    """The whole order in plain Python, from the same seeded hashes; repeated rows and ids among them."""
    from pyspark.sql import functions as F

    rows = [(i if i % 4 else None, f"t{i % 90}" if i % 6 else None, ["a", "b", "b", None][i % 4]) for i in range(700)] + [(7, "same", "c")] * 60
    docs = docs_of(spark, rows)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", "source", F.crc32(text).alias("crc"), (F.octet_length(text).cast("long") + 1).alias("size"))
    keyed = [tuple(r) for r in keyed.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "crc", "size")).collect()]
    ranges = max(16, len(rows) // 500)
    by = defaultdict(list)
    for r in keyed:
        by["-" if r[1] is None else "+" + r[1]].append(r)
    line = []
    for key, v in by.items():
        v.sort(key=lambda r: (r[4] % ranges, r[4], (r[0] is not None, r[0] or 0), r[2], r[3]))
        line += [((2 * k + 1) / (2 * len(v)), key, k, r) for k, r in enumerate(v)]
    line.sort(key=lambda x: x[:3])
    n, want, slots = len(line), [], Counter()
    for k, (_, _, _, r) in enumerate(line):
        shard = k * 16 // n
        want.append((r[0], r[1], r[3], r[2], shard, slots[shard]))
        slots[shard] += 1
    got = [(r.doc_id, r.source, r.size, r.text_crc32, r.shard, r.slot) for r in interleave(docs, 16, 7).collect()]
    assert Counter(got) == Counter(want)


def test_interleave_with_a_hot_range(spark, monkeypatch):
    from tessera.llm import sharding

    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    rows = [(None, "x", "s")] * 300 + [(i, f"t{i}", "ab"[i % 2]) for i in range(300)]
    out = interleave(docs_of(spark, rows), 16).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    assert len(out) == 600 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert all(18 <= sum(r.source == "s" for r in v) <= 20 for v in by.values())


def test_interleave_empty(spark):
    assert interleave(docs_of(spark, []), 16).collect() == []


def brute_topk(rows, every, k):
    good = [(i, [float(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v) == 4]
    want = set()
    for q in {i: v for i, v in good if i % every == 0}.items():
        s = sorted(((-int(np.dot(q[1], v)), i) for i, v in good if i != q[0]))[:k]
        want |= {(q[0], n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return want


def test_topk_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 400)]  # a third with one vector: ties
    rows += [(400, None), (401, [1.0, None, 2.0, 3.0]), (402, [1.0, float("nan"), 0.0, 0.0]), (403, [float("inf"), 0.0, 0.0, 0.0]), (450, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, score int")
    got = {tuple(r) for r in histogram_topk(df, 50, 5, 256, dim=4).collect()}
    assert got == brute_topk(rows, 50, 5)


def test_topk_few_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0] * 4), (1, [2.0] * 4)], schema)
    assert [tuple(r) for r in histogram_topk(df, dim=4).collect()] == [(0, 1, 1, 4 * 256 * 512)]
    assert histogram_topk(spark.createDataFrame([], schema), dim=4).collect() == []


def test_topk_large_components_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>"
    big = 4e6  # scaled by 256 it is the largest power of ten, times four, whose scores fit
    rows = [(0, [big, 0.0, 0.0, 0.0]), (0, [-big, 0.0, 0.0, 0.0]), (1, [big, 1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0, 0.0]), (3, [6e10, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    got = [tuple(r) for r in histogram_topk(spark.createDataFrame(rows, schema), dim=4).orderBy("rank").collect()]
    unit = 256 * 256 * 4_000_000
    assert got == [(0, 1, 2, unit), (0, 2, 2, unit), (0, 3, 1, -unit * 4_000_000)]
    assert got == [tuple(r) for r in histogram_topk(spark.createDataFrame(rows[::-1], schema), dim=4).orderBy("rank").collect()]


def test_topk_of_many_query_blocks_copies_no_vectors(spark, monkeypatch):
    """No query block is copied for each candidate block: such copies were broadcast, and the driver's memory grew with the square of the table."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(4000)] + [(i, [2.0] * 4) for i in range(4000, 4400)]
    out = topk.histogram_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50, 5, 256, dim=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 88 * 5 and set(got) == brute_topk(rows, 50, 5)


@pytest.mark.parametrize("most", [3, 40_000, 900_000_000])  # products that fit 24, 53 and 62 bits
def test_topk_chunks_of_several_slices(most):
    """Histograms and best scores of a chunk against plain lists; equal scores, repeated ids and a query's own rows among them."""
    rng = np.random.default_rng(most)
    c = rng.integers(-most, most, (90, 4), endpoint=True).astype(float)
    c[30:50] = c[7]
    ids = np.concatenate([rng.permutation(80), np.arange(10)])
    qi, q = np.arange(0, 80, 20), c[[int(np.flatnonzero(ids == i)[0]) for i in range(0, 80, 20)]]
    slices = [(ids[a : a + 25], c[a : a + 25]) for a in range(0, 90, 25)]
    bound = most * most * 4 + 1
    for lo, width, first in ((-bound, 2 * bound + 1, True), (-bound // 8, bound // 4, False)):
        step = -(-width // topk.BINS)
        got = list(zip(*(x.tolist() for x in topk._histogram(qi, q, np.full(4, lo), slices, 5, step, width, first)), strict=True))
        want = []
        for r in range(4):
            scores = [sum(int(x) * int(y) for x, y in zip(q[r], v, strict=True)) for i, v in zip(ids, c, strict=True) if i != qi[r]]
            seen = 0
            for at, n in sorted(Counter((s - lo) // step for s in scores if lo <= s < lo + width).items(), reverse=True):
                want += [(r, at, n)] if seen < 5 else []
                seen += n
        assert sorted(got) == sorted(want)
    best = list(zip(*(x.tolist() for x in topk._best(qi, q, np.full(4, -bound), slices, 5)), strict=True))
    want = []
    for r in range(4):
        s = sorted((-sum(int(x) * int(y) for x, y in zip(q[r], v, strict=True)), int(i)) for i, v in zip(ids, c, strict=True) if i != qi[r])
        want += [(r, i, -v) for v, i in s[:5]]
    assert best == want


def slow_fingerprint(text, size=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "x", "gamma"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 7)))) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, None), (2001, ""), (2002, " \n\t"), (2000, None)]
    out = simhash.simhash_components(docs_of(spark, [(i, t, "s") for i, t in rows]))
    got = Counter(tuple(r) for r in out.collect())
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    up = {f: f for _, f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    distinct = sorted(up)
    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if bin(a ^ b).count("1") <= 2:
                up[find(a)] = find(b)
    least = {}
    for i, f in fps:
        least[find(f)] = min(least.get(find(f), i), i)
    assert got == Counter((i, f"{f:016x}", least[find(f)]) for i, f in fps)


@pytest.mark.parametrize("block", [8])
def test_large_keys_split_into_blocks(spark, monkeypatch, block):
    """All fingerprints share their top bits, so every key holds all of them and is cut into several blocks."""
    monkeypatch.setattr(bitslice, "BLOCK", block)
    fps = list({int(x) for x in np.random.default_rng(2).integers(0, 512, 120)})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2).collect()
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
    up = {f: f for f in fps}

    def groups(pairs):
        up.update({f: f for f in fps})

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        g = defaultdict(set)
        for f in fps:
            g[find(f)].add(f)
        return {frozenset(x) for x in g.values()}

    assert groups(links) == groups([(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2])


def test_components_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 40))
def test_simple8b_round_trip(ids, repeat):
    ids = np.array((ids * repeat)[:9000], np.uint64)
    words, offsets = tokenstore.encode(ids)
    assert (tokenstore.decode(words, offsets, len(ids)) == ids).all()
    for b in range(len(offsets) - 1):
        part = tokenstore.decode(words, offsets, len(ids), range(b, b + 1))
        assert (part == ids[b * tokenstore.BLOCK : (b + 1) * tokenstore.BLOCK]).all()


def test_token_store_against_plain_encoding(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello, World's end", None, "", "a\n\n b\tc  d", "É<|endoftext|>ß  x", "word " * 3000, "é ́x 1234567890 :-)"]
    rows = [(i * 3, t, "s") for i, t in enumerate(texts)] + [(0, "again", "s")]
    got = sorted(tuple(r) for r in tokenstore.token_store(docs_of(spark, rows), path).collect())
    t = Tokenizer.from_file(path)
    enc = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, _ in rows]
    crc = Counter((i, len(e), zlib.crc32(np.array(e, "<u4").tobytes())) for i, e in enc)
    assert Counter((i, n, c) for i, _, n, c in got) == crc
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(i for i, _, _ in rows)
    assert tokenstore.token_store(docs_of(spark, []), path).collect() == []
    assert hashlib.sha256(b"").hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aBcÉéßΣİK ,.!'’\n\t<|>0 1 s t")), st.characters(codec="utf-8")), max_size=60))
def test_encoder_equals_tokenizer(text):
    import public_tokenizers

    encoder = tokenstore.Encoder.of(public_tokenizers.path("word_bpe_49k.json"))
    got = np.frombuffer(encoder([text], 2)[0], "<u4").tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [2]
