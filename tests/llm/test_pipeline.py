"""Near-duplicate removal against brute force, and the stages of the pipeline one by one."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import bitslice, neardup
from tests.llm.test_ranked_ops import docs_of


def test_carry_save_counts():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 100, 1001):
        w = rng.integers(0, 2**63, (n, 4), dtype=np.uint64)
        want = np.unpackbits(w.view(np.uint8), axis=1, bitorder="little").sum(axis=0)
        assert (neardup.column_counts(w) == want).all()


def near_rows(n=60, seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(n):
        base = list(rng.choice(words, int(rng.integers(60, 300))))
        for _ in range(int(rng.integers(1, 5))):
            copy = list(base)
            for p in rng.choice(len(copy), int(rng.integers(0, max(1, len(copy) // 40))), replace=False):
                copy[p] = "edit%d" % rng.integers(0, 999)
            rows.append((i, " ".join(copy), "s"))
            i += 1
    shared = " ".join(rng.choice(words, 120))
    rows += [(i + k, shared + " " + " ".join(rng.choice(words, 100)), "s") for k in range(20)]  # alike, but not enough
    rows += [(5000 + k, rows[0][1].upper(), "s") for k in range(40)] + [(6000, None, "s"), (6001, " ", "s"), (6002, "one two", "s"), (6003, "one  two", "s"), (None, "one two", "s")]
    return rows


def slow_groups(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [i for i in sets if i is not None]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("dense", [4, 0])
def test_groups_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)  # 0: every key with candidates is compared with sets
    rows = near_rows()
    df = docs_of(spark, rows)
    want = slow_groups(rows)
    got = {r.doc_id: r.group for r in neardup.groups(df).collect()}
    assert got == want
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(want.values()), None])
    assert neardup.drop_near_duplicates(docs_of(spark, [])).collect() == []


def threshold_rows(n=400, seed=8):
    """Pairs that are exactly or hardly LEAST alike, of few shingles and of many."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        long = k % 4 == 0
        words = [f"p{k}w{j}" for j in range(104 if long else 8)]
        other = list(words)
        if long:  # 100 shingles, of which two edits leave 90: 90 of 110
            for p in (10, 50):
                other[p] = f"e{k}"
        else:  # 4 shingles of 5
            other.append(f"e{rng.integers(0, 9)}")
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(other), "s")]
    return rows


def test_every_pair_at_the_threshold_is_found(spark):
    rows = threshold_rows()
    want = slow_groups(rows)
    assert sum(want[2 * k + 1] == 2 * k for k in range(400)) == 400
    assert {r.doc_id: r.group for r in neardup.groups(docs_of(spark, rows)).collect()} == want


def test_keys_meet_and_radius_covers_all_sizes():
    rng = np.random.default_rng(6)
    assert (1 - (4 / 5) ** 2) ** neardup.KEYS <= neardup.MISSED
    shares = []
    for n in (4, 9, 35, 100, 333):
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            drop = int(rng.integers(0, n // 5 + 1))
            add = max(0, math.floor((n - drop) / 0.8 + 1e-9) - n)
            x, y = np.unique(pool[:n]), np.unique(pool[drop : n + add])
            assert neardup.enough(len(np.intersect1d(x, y)), len(x), len(y))
            shares.append((neardup.pair_keys(x) == neardup.pair_keys(y)).mean())
            assert shares[-1] > 0
    assert np.mean(shares) > 0.62 and len(np.unique(neardup.pair_keys(x))) == neardup.KEYS  # keys of a set differ
    coin = lambda n, k: math.comb(n, k) / 2**n
    for s in range(4, 17):  # shared shingles, and one's own of either set
        for a in range(s // 4 + 1):
            for b in range(s // 4 + 1 - a):
                p = [[sum(coin(m, i) for i in range(m + 1) if 2 * (k + i) > s + m) for m in (a, b)] for k in range(s + 1)]
                assert sum(coin(s, k) * (x * (1 - y) + y * (1 - x)) for k, (x, y) in enumerate(p)) <= neardup.SHARE


def test_large_groups_split(spark, monkeypatch):
    from tessera.llm import bitslice

    monkeypatch.setattr(bitslice, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 3000)
    rng = np.random.default_rng(1)
    base = [f"x{i}" for i in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        copy[int(rng.integers(0, 200))] = f"e{i}"
        rows.append((i, " ".join(copy), "s"))
    assert {r.group for r in neardup.groups(docs_of(spark, rows)).collect()} == {0}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    plain = [f"{a}{b}" for a in ("th", "er", "on", "in", "at", "ou") for b in ("an", "es", "ou", "ti", "re", "is", "ly")]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, int(rng.integers(20, 80))))
        toxic = i % 7 == 0
        if toxic:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["grotz", "blarg"])))
        docs.append((i, " ".join(words), ["en", "de"][i % 2], f"src{i % 3 if i % 5 else 0}", 0))
        labels.append((i, 1, int(toxic)))
    items = [(k, " ".join(f"b{k}q{j}" for j in range(20))) for k in range(5)]
    docs += [(1000 + k, "er an " + t + " th", "en", "src1", 0) for k, t in items]
    docs += [(2000 + k, docs[1][1], "en", "src2", 0) for k in range(30)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs


def test_stages(spark, tables):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, docs = tables
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns = now.columns
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        if name != "sharding":
            assert out.columns == columns
        rows = out.collect()
        ids[name] = Counter(r.doc_id for r in rows)
        now = spark.createDataFrame(rows, out.schema)
    assert set(ids["toxicity"]) == {d[0] for d in docs if not ("grotz" in d[1] or "blarg" in d[1])}
    assert set(ids["near_duplicates"]) == set(ids["toxicity"]) - set(range(2000, 2030))
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - set(range(1000, 1005))
    assert set(ids["mixture"]) <= set(ids["decontamination"]) and max(ids["mixture"].values()) <= 2
    assert ids["sharding"] == ids["mixture"]
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    per = defaultdict(Counter)
    for r in rows:
        per[r.source][r.shard] += 1
    assert all(max(c.values()) - min(c[s] for s in range(16)) <= 2 + math.ceil(sum(c.values()) / 16 * 0.5) for c in per.values())
    run = corpus_pipeline.run(spark, path)
    assert Counter(r.doc_id for r in run.collect()) == ids["sharding"]


def test_documents_of_several_texts(spark):
    """Rows that repeat a doc_id with other texts are one document; each text keeps its own links."""
    rng = np.random.default_rng(2)
    a, b = ([f"{c}{k}" for k in rng.integers(0, 10**6, 90)] for c in "ab")
    near = lambda w: " ".join([*w, "more"])
    rows = [(5, " ".join(a), "s"), (5, " ".join(b), "s"), (9, near(b), "s"), (11, near(a), "s"), (12, "none of them", "s")]
    for order in (rows, rows[::-1]):
        assert {r.doc_id: r.group for r in neardup.groups(docs_of(spark, order)).collect()} == {5: 5, 9: 5, 11: 5, 12: 12}
    rows = [(7, " ".join(a), "s"), (7, " ".join(b), "s"), (9, near(b), "s"), (5, near(a), "s")]
    assert {r.doc_id: r.group for r in neardup.groups(docs_of(spark, rows)).collect()} == {5: 5, 7: 5, 9: 5}


def dealt_rows(lefts, rights):
    """group, side, inner and fingerprints of the groups, as a task gets them."""
    g, s, inner, f = [], [], [], []
    for k, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        for side, rows in enumerate((left, right)):
            g += [k] * len(rows)
            s += [side] * len(rows)
            inner += [not len(right)] * len(rows)
            f += list(rows)
    return np.array(g), np.array(s), np.array(inner), np.array(f, np.uint64)


@pytest.mark.parametrize("words,radius", [(4, neardup.RADIUS), (1, 0), (1, 2), (1, 3), (1, 9), (2, 20)])
def test_many_groups_at_once_equal_plain_distances(words, radius):
    rng = np.random.default_rng(3)

    def block(n):
        base = rng.integers(0, 2**63, (max(1, n // 4), words), dtype=np.uint64)
        out = []
        for _ in range(n):
            f = base[rng.integers(0, len(base))].copy()
            for b in rng.choice(64 * words, int(rng.integers(0, radius + 2)), replace=False):
                f[b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
            out.append(f)
        return out

    lefts, rights = [block(n) for n in (2, 5, 64, 65, 200, 3, 1)], [[], [], [], [], block(70), block(1), []]
    group, side, inner, fps = dealt_rows(lefts, rights)
    x, y = bitslice.pairs_within(group, side, inner, fps, radius)
    want = set()
    for a in range(len(fps)):
        for b in range(a):
            if group[a] == group[b] and (inner[a] or side[a] != side[b]) and int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= radius:
                want.add((b, a))
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and len(x) == len(want)
    kept = bitslice.spanning(len(fps), x, y)
    assert trees(zip(x[kept].tolist(), y[kept].tolist(), strict=True)) == trees(want) and len(kept) == sum(len(t) - 1 for t in trees(want))


def trees(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    out = defaultdict(set)
    for x in list(up):
        out[find(x)].add(x)
    return {frozenset(x) for x in out.values()}


def test_common_counts_equal_intersections(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 16)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90, n).astype(np.uint64)) for n in (0, 1, 5, 40, 80, 33, 0, 12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:3]]
    assert neardup.common_counts(sets[:3], sets).tolist() == want


def test_streams_are_cut_between_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bitslice, "ROWS", 7)
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 30, 200))
    b = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(200, np.int32)), pa.array(np.zeros(200, np.int32)), pa.array(np.arange(200))], names=["key", "i", "j", "n"])
    for step in (1, 3, 10, 200):
        out = list(bitslice.runs((b.slice(i, step) for i in range(0, 200, step)), ["key"]))
        assert [n for t in out for n in t.column("n").to_pylist()] == list(range(200))
        seen = [set(t.column("key").to_pylist()) for t in out]
        assert sum(map(len, seen)) == len(set().union(*seen)) and len(out) > 10


def test_python_gets_small_batches(spark):
    import corpus_pipeline as pipeline

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    key, texts = pipeline.BATCH, spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('x', 5000) text")
    before = spark.conf.get(key)
    try:
        pipeline.in_small_batches(spark)
        got = texts.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) <= pipeline.BATCH_BYTES + 10_000
        spark.conf.set(key, "1m")
        pipeline.in_small_batches(spark)
        assert spark.conf.get(key) == "1m"
        spark.conf.set(key, before)
        benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
        spark.conf.set(key, "64m")
        pipeline.table, held = lambda *_: benchmark, pipeline.table
        try:
            pipeline.decontamination(spark, texts, "")
        finally:
            pipeline.table = held
        assert spark.conf.get(key) == str(pipeline.BATCH_BYTES)
    finally:
        spark.conf.set(key, before)


def test_word_cache_is_small():
    hashes = neardup.WordHashes()
    text = " ".join(f"word{i}" for i in range(200_000))
    digest, sets = neardup.shingles(text, hashes)
    again = neardup.shingles(text, hashes)
    assert len(hashes) <= 50_000 and digest == again[0] and (sets == again[1]).all() and len(sets) == 199_996
