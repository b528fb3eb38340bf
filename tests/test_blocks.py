"""Ordered clustering against the rules written out, and its steps on large blocks."""

import random
import time

import pandas as pd
import pytest

from tessera.functions.plain import similarity
from tessera.operators import resolve


def near(a, b):
    x, y = a.lower().strip(), b.lower().strip()
    return len(a) >= 5 and len(b) >= 5 and min(len(x), len(y)) >= max(len(x), len(y)) * (0.88 / 1.12) - 1e-9 and similarity(x, y) >= 0.88


def matches(a, b):
    if a["domain"] and b["domain"]:
        return a["domain"] == b["domain"]
    if set(a["phones"]) & set(b["phones"]) or set(a["profiles"].items()) & set(b["profiles"].items()):
        return True
    if a["places"] and b["places"] and not set(a["places"]) & set(b["places"]):
        return False
    return bool(a["key"] and a["key"] == b["key"]) or bool(a["name"] and b["name"]) and near(a["name"], b["name"])


def absorb(e, c):
    e["domain"] = e["domain"] or c["domain"]
    e["phones"], e["profiles"], e["places"], e["names"] = e["phones"] + c["phones"], c["profiles"] | e["profiles"], e["places"] + c["places"], e["names"] + c["names"]
    plain = [n for n in e["names"] if not n.startswith("@") and "." not in n]
    if e["name"] != (best := (plain or e["names"] or [None])[0]):
        e["name"], e["key"] = best, c["key"] if best == c["name"] else e["key"]


def by_the_rules(rows, mode):
    seen, out = [], []
    for i, r in enumerate(rows):
        c = r | {"number": i, "names": [r["name"]] if r["name"] else []}
        if mode == "live":
            hit = next((e for e in seen if matches(e, c)), None)
            absorb(hit, c) if hit else seen.append(c)
            out.append((hit or c)["number"])
        else:
            hit = next((m for m in seen if any(matches(c, x) for x in m)), None)
            hit.append(c) if hit else seen.append([c])
            out.append((hit or [c])[0]["number"])
    return out


def block(rows):
    out = pd.DataFrame({"cand_id": range(len(rows))})
    for c, f in {"name": "name", "domain": "domain", "phones": "phones", "name_key": "key", "places": "places"}.items():
        out[c] = pd.Series([r[f] for r in rows], dtype=object)
    out["profiles"] = pd.Series([[f"{k}:{v}" for k, v in r["profiles"].items()] for r in rows], dtype=object)
    return out


@pytest.mark.parametrize("mode", ["live", "batch"])
def test_indexed_rules_equal_the_rules(mode):
    keys = {None: None, "": None, "Alpha Dental": "alpha", "ALPHA dental ": "alpha", "Alpha Dentals": "alphadentals", "Alpha Care": "alpha", "@alpha": "alpha", "gam.in": "gamin", "@gamma": "gamma", "Gammma": "gammma", "abcd": "abcd"}
    for seed in range(300):
        rng = random.Random(seed)
        some = lambda values, n: rng.sample(values, rng.choice(n))  # noqa: E731, B023
        rows = [{"name": (n := rng.choice(list(keys))), "key": keys[n], "domain": rng.choice([None] * 3 + ["a.in", "b.in"]), "phones": some(["91", "92", "93", "94"], [0, 0, 0, 1, 2]), "profiles": {k: rng.choice("xy") for k in some(["f", "i"], [0, 0, 1, 2])}, "places": some(["pune", "goa", "agra"], [0, 1, 1, 2])} for _ in range(rng.choice([8, 30]))]
        got = (resolve._live if mode == "live" else resolve._batch)(block(rows))
        assert got == by_the_rules(rows, mode), seed


@pytest.mark.parametrize("mode", ["live", "batch"])
def test_steps_do_not_grow_with_the_block(mode):
    rows = block([{"name": "Rose", "key": "rose", "domain": f"d{i % 15000}.in", "phones": ["91"], "profiles": {}, "places": []} for i in range(30000)])
    began = time.perf_counter()
    got = (resolve._live if mode == "live" else resolve._batch)(rows)
    assert got == [*range(15000), *range(15000)] and time.perf_counter() - began < 15


@pytest.mark.parametrize("kind", ["domain", "phone", "profile", "name"])
def test_all_pairs_in_slices(spark, monkeypatch, kind):
    monkeypatch.setattr(resolve, "SLICE", 4)
    rng = random.Random(3)
    rows = [(i, None, rng.choice([None, "a.in", "b.in"]), rng.sample(["91", "92", "93"], rng.choice([0, 1, 2])), rng.sample(["f:x", "i:y"], rng.choice([0, 1, 2])), rng.choice([None, "rose", "lily"]), rng.sample(["pune", "goa"], rng.choice([0, 1, 2]))) for i in range(60)]
    k = spark.createDataFrame(rows, "cand_id long, name string, domain string, phones array<string>, profiles array<string>, name_key string, places array<string>")
    own = {"domain": lambda r: {r[2]} - {None}, "phone": lambda r: set(r[3]), "profile": lambda r: set(r[4]), "name": lambda r: {r[5]} - {None}}[kind]
    near_by = lambda x, y: kind != "name" or not x[6] or not y[6] or set(x[6]) & set(y[6])
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and own(x) & own(y) and not (x[2] and y[2] and x[2] != y[2]) and near_by(x, y)]
    found = resolve.all_pairs(k, kind)
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "[a#" not in plan.split("Join", 1)[1] and plan.count("Join Inner") == 3  # pairs are not shuffled again


@pytest.mark.parametrize("mode", ["live", "batch"])
def test_rows_that_changed_nothing(mode, monkeypatch):
    monkeypatch.setattr(resolve, "SETTLED", 7)
    names = {None: None, "Alpha Dental": "alpha", "Alpha Dentals": "alphadentals", "Alpha Care": "alpha", "@alpha": "alpha", "@gamma": "gamma", "Gammma": "gammma"}
    for seed in range(60):
        rng = random.Random(seed)
        some = lambda values, n: rng.sample(values, rng.choice(n))  # noqa: E731, B023
        pool = [{"name": (n := rng.choice(list(names))), "key": names[n], "domain": rng.choice([None] * 3 + ["a.in", "b.in"]), "phones": some(["91", "92", "93"], [0, 0, 1, 2]), "profiles": {k: rng.choice("xy") for k in some(["f", "i"], [0, 0, 1])}, "places": some(["pune", "goa"], [0, 1, 2])} for _ in range(12)]
        rows = [rng.choice(pool[: 2 + i // 12]) for i in range(120)]
        assert (resolve._live if mode == "live" else resolve._batch)(block(rows)) == by_the_rules(rows, mode), seed
    taken = []
    monkeypatch.setattr(resolve, "SETTLED", 1000)
    monkeypatch.setattr(resolve._Block, "take", lambda self, c, take=resolve._Block.take: taken.append(c.number) or take(self, c))
    rows = block([{"name": f"Rose{i % 50}", "key": f"rose{i % 50}", "domain": f"d{i % 50}.in", "phones": ["91"], "profiles": {}, "places": []} for i in range(5000)])
    assert (resolve._live if mode == "live" else resolve._batch)(rows) == [i % 50 for i in range(5000)] and len(taken) == 100


def derived_like(rng, n):
    names = ["Alpha Dental", "Alpha Dentals", "ALPHA dental", "Gammma Home", "Care", "ab", "", None, "Zeta Works"]
    phones = [[], [], ["+91 9800000001"], ["+91 9800000002", "+91 9800000003"]]
    out = []
    for i in range(n):
        p = [(v, None, None, None) for v in rng.choice(phones)]
        out.append((i, rng.choice(names), rng.choice([None, None, None, "a.in", "b.in", ""]), p, rng.choice([{}, {}, {"f": "https://f.com/x"}]), rng.choice([[], ["Pune"], ["Goa", "Pune"]])))
    return out


@pytest.mark.parametrize("mode", ["live", "batch"])
def test_clusters_equal_the_rules_and_link_kinds_not_rows(spark, mode, monkeypatch):
    rows = derived_like(random.Random(5), 400)
    df = spark.createDataFrame(rows, "cand_id long, name string, domain string, phone_numbers array<struct<value:string,raw_value:string,source_url:string,source_type:string>>, social_profiles map<string,string>, locations array<string>")
    linked = []
    monkeypatch.setattr(resolve, "pairs", lambda rows, pairs=resolve.pairs: linked.append(rows.select("cand_id").distinct().count()) or pairs(rows))
    got = {r.cand_id: r.cluster_id for r in resolve.clusters(df, mode).collect()}
    keyed = resolve.keyed(df).orderBy("cand_id").collect()
    want = by_the_rules([{"name": r.name, "key": r.name_key, "domain": r.domain, "phones": r.phones, "profiles": dict(p.split(":", 1) for p in r.profiles), "places": r.places} for r in keyed], mode)
    assert [got[i] for i in range(400)] == want
    assert linked[0] < len({str((r.name, r.domain, r.phones, r.profiles)) for r in keyed}) + 1 < 400


def test_near_ratio_is_found_once_and_spread(spark):
    k = spark.createDataFrame([(1, "alpha dental"), (2, "alpha dentals"), (3, "zzzzz")], "cand_id long, name string")
    found = resolve.near_pairs(k)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "ArrowEvalPython" in plan.split("RepartitionByExpression")[0]
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc d", k=rng.choice([3, 8, 12]))) for _ in "ab")
        assert similarity(a, b) <= resolve.most_alike(a, b)
