"""Operator 6: the coded sequences, and the model's scores against dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import eliasfano


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 10**6), st.integers(0, 2**63)), max_size=400, unique=True), st.integers(1, 2**20))
def test_sequences(values, room):
    x = np.array(sorted(values), np.uint64)
    arrays, meta = eliasfano.build(x, int(x[-1]) + room if len(x) else room, "s")
    data = np.frombuffer(eliasfano.pack(arrays, **meta), np.uint8)
    s = eliasfano.Sequence(*eliasfano.unpack(data), "s")
    assert (s.access(np.arange(len(x))) == x).all()
    asked = np.unique(np.concatenate([x, x + np.uint64(1), np.array([0, 3, 2**63 + 5], np.uint64)]))
    place = {int(v): i for i, v in enumerate(x)}
    assert s.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def slow_scores(rows, order):
    """Interpolated discounting from plain dictionaries."""
    from tessera.llm.ngrams import discounts

    def toks(t):
        return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] + ["\n"]

    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1
    grams = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if not held(i):
            w = ["<s>", *toks(t)]
            for k in range(1, order + 1):
                for j in range(1, len(w)):
                    if j - k + 1 >= 0:
                        grams[k][tuple(w[j - k + 1 : j + 1])] += 1
    total, types = sum(grams[1].values()), len(grams[1])
    cuts, ctx = {}, {}
    for k in range(2, order + 1):
        n = Counter(grams[k].values())
        cuts[k] = discounts([n[1], n[2], n[3], n[4]])
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, c in grams[k].items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][1] += cuts[k][min(c, 3) - 1]

    def prob(w, j):
        p = (grams[1][(w[j],)] + 0.5) / (total + 0.5 * (types + 1))
        for k in range(2, order + 1):
            if j - k + 1 < 0:
                break
            g = tuple(w[j - k + 1 : j + 1])
            if g[:-1] not in ctx[k]:
                continue
            c, (n, off) = grams[k][g], ctx[k][g[:-1]]
            p = (max(0.0, c - cuts[k][min(c, 3) - 1]) / n if c else 0.0) + min(1.0, off / n) * p
        return p

    out = []
    for i, t in rows:
        w = ["<s>", *toks(t)]
        base = sum(math.log10((grams[1][(x,)] + 0.5) / (total + 0.5 * (types + 1))) for x in w[1:])
        out.append((i, held(i), len(w) - 1, sum((x,) in grams[1] for x in w[1:]), total, base, sum(math.log10(prob(w, j)) for j in range(1, len(w)))))
    return out


def test_scores_against_dictionaries(spark, monkeypatch):
    from tessera.llm import ngrams

    rng = np.random.default_rng(2)
    vocabulary = ["the", "of", "É"] * 6 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)))).replace("w1 ", "W1\t")) for i in range(250)]
    rows += [(1000 + i, rows[3][1]) for i in range(9)] + [(None, "the null"), (2000, None), (2001, ""), (6, "never seen words"), (0, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    for order, shard_tokens in ((2, 4_000_000), (2, 700), (3, 700)):
        monkeypatch.setattr(ngrams, "SHARD_TOKENS", shard_tokens)
        monkeypatch.setattr(ngrams, "SHARD_DOCS", 40 if shard_tokens < 1000 else 8192)
        monkeypatch.setattr(ngrams, "BUFFER_TOKENS", 500)
        model = ngrams.train(df, order)
        assert shard_tokens > 1000 or len(model.levels[0].hot)
        got = sorted((tuple(r) for r in ngrams.score(df, model).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        want = sorted(slow_scores(rows, order), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        assert [g[:5] for g in got] == [w[:5] for w in want]
        for g, w in zip(got, want, strict=True):
            assert abs(g[5] - w[5]) < 1e-9 * max(1, abs(w[5]))
            assert abs(g[6] - w[6]) <= 5e-4 * g[2] * order + 1e-9, (order, g, w)


def test_without_training_rows(spark):
    from tessera.llm import ngrams

    df = spark.createDataFrame([(i, "a b") for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    out = ngrams.score(df, ngrams.train(df, 2)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == 0 and r.base_score == 0 for r in out)
    assert ngrams.score(df.limit(0), ngrams.train(df.limit(0), 2)).collect() == []


def test_query_counts_trigrams(spark, tmp_path):
    from tessera.llm import queries

    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d"], 12))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op6_ngram_trie(spark, str(tmp_path)).collect()}
    two, three = ({r[0]: r[6] for r in slow_scores(rows, order)} for order in (2, 3))
    assert all(abs(got[i] - three[i]) <= 5e-4 * 13 * 3 for i, _ in rows)
    assert max(abs(two[i] - three[i]) for i, _ in rows) > 0.1


def test_steps_of_scoring_equal_the_plain_ones():
    from tessera.llm import ngrams

    codes = np.arange(65536).astype(np.uint16)
    assert (ngrams.restore(codes) == np.where(codes > 0, 10.0 ** -((65535 - codes.astype(float)) * ngrams.STEP), 0.0)).all()
    assert (ngrams.quantise(ngrams.restore(codes[3:])) == codes[3:]).all()
    shards = np.array([3, 0, 3, 1])
    assert (np.argsort(ngrams.narrow(shards, 4), kind="stable") == np.argsort(shards, kind="stable")).all() and ngrams.narrow(shards, 70_000) is shards
    known = ngrams.Known({b"a": 5})
    known.new = []
    assert [known[w] for w in (b"x", b"a", b"y", b"x")] == [-2, 5, -3, -2] and known.new == [b"x", b"y"]


def test_query_splits_each_text_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.llm import queries

    seen = spark.sparkContext.accumulator(0)

    def passed(text):
        seen.add(1)
        return text

    spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain, table = F.udf(passed, "string"), queries.table
    monkeypatch.setattr(queries, "table", lambda *a: table(*a).withColumn("text", plain("text")))
    assert len(queries.op6_ngram_trie(spark, str(tmp_path)).collect()) == 60
    assert seen.value == 60


def batches_of(rows, size):
    import pyarrow as pa

    for a in range(0, len(rows), size):
        ids, texts, held = zip(*rows[a : a + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(held)], names=["doc_id", "text", "held"])


def test_chunks_hold_all_words_in_order():
    from tessera.llm import ngrams

    odd = "".join(chr(c) for c in range(0x300)) + " \u2003x\u0085y\u3000\U0001f600Z "
    rows = [(1, "", False), (None, odd, True), (2, " \t\x0b\x0c\r\n ", False), (3, "A  b\x1cB a", True), (3, odd[::-1], False), *((i, f"w{i % 9} É W{i % 5}" * (i % 4), i % 5 == 1) for i in range(90))]
    for least, size in ((1, 7), (40, 1000), (10**6, 33)):
        chunks = [ngrams.Chunk.unpack(x.pack()) for x in ngrams._chunks(batches_of(rows, size), least)]
        assert (len(chunks) > 1) == (least < 10**6)
        got = []
        for x in chunks:
            ends = np.cumsum(x.lengths)
            got += [(int(i) if v else None, x.words[x.tokens[e - n : e]].tolist(), bool(h)) for i, v, h, n, e in zip(x.doc_id, x.valid, x.held_out, x.lengths, ends, strict=True)]
            tokens, lengths = x.training()
            assert len(tokens) == lengths.sum() == x.lengths[~x.held_out].sum()
        assert got == [(i, ngrams.digests([*t.encode().lower().split(), ngrams.END]).tolist(), h) for i, t, h in rows]
    # Few but long words end a chunk too.
    assert len(list(ngrams._chunks(batches_of([(i, "x" * 1000, False) for i in range(64)], 9), 1000))) == 4


def test_pairs_are_grouped_alike_in_one_number_and_in_two():
    from tessera.llm import ngrams

    rng = np.random.default_rng(4)
    for n in (0, 1, 500):
        major, minor = rng.integers(0, 9, n), rng.integers(0, 7, n)
        for room in (9, 2**62):
            order, first = ngrams.grouped(major, minor, room, 7)
            assert order.tolist() == np.lexsort((minor, major)).tolist()
            pairs = list(zip(major[order].tolist(), minor[order].tolist(), strict=True))
            assert first.tolist() == [i for i, x in enumerate(pairs) if not i or x != pairs[i - 1]]


def test_runs_longer_than_a_word():
    x = np.array([*range(5, 400, 3), 1 << 40], np.uint64)  # all but one share their high bits
    s = eliasfano.Sequence(*eliasfano.build(x, 1 << 41, "s"), "s")
    assert s.find(np.arange(420)).tolist() == [(v - 5) // 3 if 5 <= v < 400 and v % 3 == 2 else -1 for v in range(420)]
    y = np.sort(np.append(np.random.default_rng(1).integers(0, 90_000, 900), [7] * 200)).astype(np.uint64)
    for room in (90_001, 2**50):
        s = eliasfano.Sequence(*eliasfano.build(y, room, "s"), "s")
        a, b = s.access_two(np.arange(len(y) - 1))
        assert a.tolist() == y[:-1].tolist() and b.tolist() == y[1:].tolist()


def test_words_are_found_by_hash_as_by_name(spark, monkeypatch):
    from tessera.llm import ngrams

    monkeypatch.setattr(ngrams, "SHARD_DOCS", 20)
    model = ngrams.train(spark.createDataFrame([(i, f"a b{i} c{i % 9}") for i in range(100)], "doc_id long, text string"), 2)
    words = [b"a", b"none", b"\n", *(b"b%d" % i for i in range(100)), b"a"]
    assert len(model.lexicon.uris) > 2
    assert model.lexicon.ids(words).tolist() == model.lexicon.find(ngrams.digests(words)).tolist()
