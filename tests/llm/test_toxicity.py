"""Operator 8: the chain against enumeration, the fitted model on held-out rows."""

import itertools
import tracemalloc
import zlib

import numpy as np

from tessera.llm import toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 6, 2])
    emit, trans = rng.normal(size=12) * 2, rng.normal(size=(2, 2))
    odds = toxicity.chain(emit, lengths, trans)
    at = 0
    for n in lengths:
        e = emit[at : at + n]
        total = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            for i in range(n):
                total[i, y[i]] += w
        assert np.allclose(odds[at : at + n], np.log(total[:, 1] / total[:, 0]))
        at += n


def corpus(n=900, seed=1):
    rng = np.random.default_rng(seed)
    plain, bad = [f"{a}{b}" for a in ("th", "er", "on", "in", "at") for b in ("an", "es", "ou", "ti", "re", "é", "ly")], ["grotz", "blarg", "snidé", "vexor"]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, int(rng.integers(5, 60))))
        toxic = rng.random() < 0.15
        if toxic:
            for w in rng.choice(bad, int(rng.integers(1, 4))):
                words.insert(int(rng.integers(0, len(words))), str(w))
        text = " ".join(words).replace("eres er", "eres.\ner")
        rows.append((i, text.capitalize() if i % 2 else text, int(toxic)))
    return rows


def test_held_out_rows_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5, i) for i, t, _ in rows] + [(5000, None, 0.1, 1), (5001, "", 0.1, 1), (None, "x blarg", 0.1, 1), (5002, "İ K\n\nblarg. ok\r\ngrotz", 0.1, 1)], "doc_id long, text string, score double, y long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(rows) + 4
    by = {r.doc_id: r for r in out}
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted != truth[r.doc_id] for r in held) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert by[5000].score == by[5001].score < 0.5
    text = "İ K\n\nblarg. ok\r\ngrotz"
    assert [text[s.start : s.end] for s in by[5002].spans] == ["blarg", "grotz"]
    again = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in out)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out if not r.predicted)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []


def test_fit_holds_little_beside_its_sample():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i:05d}" for i in range(60_000)])
    bad = np.array(["grotz", "blarg", "vexor"])
    docs = []
    for i in range(800):
        said = rng.choice(words, 300)
        if i % 8 == 0:
            said[25::100] = bad
        docs.append(("\n".join(" ".join(said[lo : lo + 50]) for lo in range(0, 300, 50)), int(i % 8 == 0)))
    tracemalloc.start()
    model = toxicity.fit(docs, rounds=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.weights) > 0
    assert most < 25 * sum(len(t) for t, _ in docs)


def test_how_much_is_scored_at_once_changes_nothing(monkeypatch):
    docs = [(t, y) for _, t, y in corpus(300)]
    once = toxicity.fit(docs, rounds=20)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 7)
    monkeypatch.setattr(toxicity, "FIT_WORDS", 3)
    again = toxicity.fit(docs, rounds=20)
    assert again.curve == once.curve and again.weights == once.weights


def test_pair_sums_against_all_kinds_at_once():
    rng = np.random.default_rng(5)
    t, before, after = np.exp(rng.normal(size=(2, 2))), np.exp(rng.normal(size=99)), np.exp(rng.normal(size=99))
    joint = t[:, :, None] * np.stack([np.ones(99), before])[:, None] * np.stack([np.ones(99), after])[None]
    assert np.allclose(toxicity.pair_sums(t, before, after), (joint / joint.sum(axis=(0, 1))).sum(axis=2))
