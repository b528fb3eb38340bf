"""Operators 5 and 7 against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, decontaminate
from tests.llm.test_ranked_ops import docs_of

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "<|", "|>", "ok", "\n", "é", "<|im_", "[INST"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=6))
def test_template_round_trip(turns):
    text, mask = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant"]


def test_digests_of_conversations(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", "a"), (1, 10, "assistant", None), (2, 0, "assistant", "</s>\\"), (1, 2, "assistant", "b"), (3, 0, None, ""), (-1, 0, "user", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node int, tree int").select("conv_id", "turn", "role", "text", "node")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.conversations(chat.linear(df)))).collect()}
    convs = defaultdict(list)
    for c, n, r, t in sorted(rows, key=lambda r: r[:2]):
        convs[c].append((r or "", t or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert chat.digests(chat.formatted(chat.conversations(chat.linear(df.limit(0))))).collect() == []


def test_reply_trees_rank_branches(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in range(120):
        tree = n % 4
        older = [r[0] for r in rows if r[2] == tree]
        parent = int(rng.choice(older)) if older and rng.random() < 0.9 else (None if rng.random() < 0.7 else 9999)
        rows.append((n, parent, tree, float(rng.integers(0, 3)), "user", f"t{n}"))
    rows += [(500 + i, 500 + i - 1 if i else None, 9, None, "user", str(i)) for i in range(70)]  # a long chain
    rows += [(700, 701, 8, 1.0, "user", "x"), (701, 700, 8, 1.0, "user", "y")]  # a circle
    df = spark.createDataFrame(rows, "node long, parent long, tree long, score double, role string, text string")
    got = {(r.tree, r.branch): [t.text for t in r.turns] for r in chat.conversations(df, 3).collect()}
    by = {r[0]: r for r in rows}
    parents = {r[1] for r in rows}
    leaves = defaultdict(list)
    for r in rows:
        if r[0] not in parents:
            path, x = [], r
            while x:
                path.append(x)
                x = by.get(x[1])
            leaves[r[2]].append((-sum(p[3] or 0 for p in path), r[0], [p[5] for p in path[::-1]]))
    want = {(t, n + 1): p for t, v in leaves.items() for n, (_, _, p) in enumerate(sorted(v)[:3])}
    assert got == want


def test_reply_trees_edges(spark):
    rows = [(1, None, 1, 2.0, "user", "hub"), *[(10 + i, 1, 1, 1.0, "user", str(i)) for i in range(50)]]  # ties: the smaller leaf
    rows += [(100, 10 + 49, 2, 5.0, "assistant", "moved")]  # a path counts for its leaf's tree
    rows += [(200, 201, 3, 1.0, "user", "a"), (201, 200, 3, 1.0, "user", "b"), (202, 201, 3, 1.0, "user", "c")]  # hangs off a circle
    rows += [(300, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "node long, parent long, tree long, score double, role string, text string")
    got = {(r.tree, r.branch): [t.text for t in r.turns] for r in chat.conversations(df, 2).collect()}
    assert got == {(1, 1): ["hub", "0"], (1, 2): ["hub", "1"], (2, 1): ["hub", "49", "moved"], (None, 1): [""]}
    assert chat.conversations(df.limit(0)).collect() == []


def slow_overlaps(x, y):
    width = min(13, len(y))
    need = 11 if width == 13 else width
    out = set()
    for d in range(-len(y), len(x)):
        for s in range(len(y) - width + 1):
            if 0 <= d + s and d + s + width <= len(x) and sum(x[d + s + i] == y[s + i] for i in range(width)) >= need:
                out.add(d)
    return out


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    make = lambda n: list(rng.choice(words, n))
    items = [make(n) for n in (5, 9, 12, 13, 14, 20, 33, 60)] + [make(3), []]
    docs = []
    for n in range(150):
        y = list(items[n % len(items)])
        for i in rng.choice(len(y), min(len(y), int(rng.integers(0, 4))), replace=False) if y else []:
            y[i] = "sub"
        a = int(rng.integers(0, max(1, len(y) - 12)))
        docs.append(make(int(rng.integers(0, 30))) + y[a:] + make(int(rng.integers(0, 30))))
    docs += [[], ["w1"] * 400]
    items.append(["w1"] * 15)
    df = docs_of(spark, [(i, " ".join(d).upper().replace("W7 ", "«W7»—w7, ") if i % 2 else ", ".join(d), "s") for i, d in enumerate(docs)] + [(999, None, "s")])
    bench = spark.createDataFrame([(i, " ".join(y), 1) for i, y in enumerate(items)] + [(99, None, 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    texts = {r.doc_id: decontaminate.tokens(r.text) for r in df.collect()}
    want = {(i, k) for i, x in texts.items() for k, y in enumerate(items) if len(y) >= 5 and slow_overlaps(x, [w.encode() for w in y])}
    assert got == want and want
    kept = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == set(texts) - {i for i, _ in want}
    assert decontaminate.overlaps(df, bench.limit(0)).collect() == []
    assert decontaminate.overlaps(df.limit(0), bench).collect() == []


def test_benchmark_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_TOKENS", 20)
    bench = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(15))) for i in range(6)], "item_id long, text string")
    df = docs_of(spark, [(i, f"x y a {' '.join(f'a{i}b{j}' for j in range(15))}", "s") for i in range(8)])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()) == [(i, i) for i in range(6)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [6, 7]
