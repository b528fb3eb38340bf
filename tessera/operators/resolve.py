"""Entity resolution (J1-J9) and merging.

Candidates meet only through keys that both hold: domain, phone, profile, name, or a block of near names. Pairs are
equi-joins on those keys; components over the pairs (ignoring vetoes and locations, which a merged record may get from
another member) are the blocks within which the order-dependent rules can matter. Inside a block the rules run in order
of arrival; blocks are independent, so the result is that of one run over everything.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import text as X
from tessera.functions.plain import similarity

NEAR, NEAR_LETTERS = 0.88, 5


def stored(df: DataFrame) -> DataFrame:
    """df as a table written once in the folder that all executors share (spark.checkpoint.dir)."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = os.path.join(root, f"resolve-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- keys ----


def phone_keys() -> Column:
    return F.array_compact(F.array_distinct(F.transform("phone_numbers", lambda p: X.digits_key(p["value"]))))


def profile_keys() -> Column:
    bare = lambda u: F.regexp_replace(F.replace(F.replace(F.replace(F.lower(F.trim(u)), F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")), F.lit("www."), F.lit("")), "/+$", "")
    return F.transform(F.filter(F.map_entries("social_profiles"), lambda e: ~X.blank(e["value"])), lambda e: F.concat(e["key"], F.lit(":"), bare(e["value"])))


def _plain_keys(candidates: DataFrame) -> DataFrame:
    """cand_id, name and what matching looks at, but for the name's key."""
    none = F.array().cast("array<string>")
    places = F.transform(F.filter(F.coalesce("locations", none), lambda x: ~X.blank(x)), lambda x: F.lower(F.trim(x)))
    return candidates.select(
        F.col("cand_id").cast("long"),
        "name",
        X.filled(F.col("domain")).alias("domain"),
        F.coalesce(phone_keys(), none).alias("phones"),
        F.coalesce(profile_keys(), none).alias("profiles"),
        F.array_distinct(places).alias("places"),
    )


def keyed(candidates: DataFrame) -> DataFrame:
    """cand_id, name and what matching looks at."""
    return _plain_keys(candidates).withColumn("name_key", X.name_key("name"))


def low_name() -> Column:
    """The name as tier 5 compares it; null if it is too short for that."""
    return F.when(F.length("name") >= NEAR_LETTERS, X.filled(F.lower(F.trim("name"))))


def key_rows(k: DataFrame) -> DataFrame:
    """cand_id, kind, key: one row for each key of each candidate."""
    kinds = [("domain", F.array("domain")), ("phone", F.col("phones")), ("profile", F.col("profiles")), ("name", F.array("name_key")), ("low", F.array(low_name()))]
    entries = F.concat(*[_entries(kind, a) for kind, a in kinds])
    return k.select("cand_id", F.explode(entries).alias("e")).select("cand_id", "e.kind", "e.key").where("key is not null").distinct()


def _entries(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))


def pairs(rows: DataFrame) -> DataFrame:
    """a, b, kind: candidates that share a key, chained to the key's first one, so that no key emits all its pairs."""
    first = rows.groupBy("kind", "key").agg(F.min("cand_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["kind", "key"]).where("cand_id != a").select("a", F.col("cand_id").alias("b"), "kind").distinct()


#: Members of a key that are paired with each other, or with as many others, in one step of a join.
SLICE = 2000


def all_pairs(k: DataFrame, kind: str) -> DataFrame:
    """a, b: every pair (a < b) that matches by one exact tier alone, vetoes and locations included.

    A key's members are dealt to slices of about SLICE, and each two slices meet by a key of their own, so that no task
    gets all pairs of a key and rows are shuffled, not pairs. What the vetoes look at travels with the rows. A pair that
    shares several keys comes from the least of them.
    """
    values = {"domain": F.array_compact(F.array("domain")), "phone": F.col("phones"), "profile": F.col("profiles"), "name": F.array_compact(F.array("name_key"))}[kind]
    rows = k.select("cand_id", F.array_distinct(F.array_compact(values)).alias("keys"), "domain", "places").withColumn("key", F.explode("keys"))
    # Only what the tier looks at travels on.
    rows = rows.select("cand_id", "key", *{"domain": [], "phone": ["keys", "domain"], "profile": ["keys", "domain"], "name": ["domain", "places"]}[kind])
    many = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    rows = rows.join(many, "key").withColumn("own", F.pmod(F.xxhash64("cand_id"), "slices").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "slices")
    left, right = rows.select([F.col(c).alias(f"l_{c}") for c in rows.columns]), rows.select([F.col(c).alias(f"r_{c}") for c in rows.columns])
    # Two members of one slice meet only in that slice's own cell, others in the cell of both slices.
    here = (F.col("l_key") == F.col("r_key")) & (F.col("l_low") == F.col("r_low")) & (F.col("l_high") == F.col("r_high")) & (F.col("l_cand_id") < F.col("r_cand_id"))
    here &= (F.col("l_own") != F.col("r_own")) | (F.col("l_low") == F.col("l_high"))
    if kind != "domain":
        here &= ~F.coalesce(F.col("l_domain") != F.col("r_domain"), F.lit(False))
    if kind == "name":
        here &= F.arrays_overlap("l_places", "r_places") | (F.size("l_places") == 0) | (F.size("r_places") == 0)
    if kind in ("phone", "profile"):
        one = (F.size("l_keys") == 1) | (F.size("r_keys") == 1)
        here &= one | (F.array_min(F.array_intersect("l_keys", "r_keys")) == F.col("l_key"))
    return left.join(right, here).select(F.col("l_cand_id").alias("a"), F.col("r_cand_id").alias("b"))


@F.pandas_udf(DoubleType())
def _near_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio in the better order; 0 where the letters that both names hold are too few for NEAR in any order."""
    return pd.Series([max(similarity(x, y), similarity(y, x)) if most_alike(x, y) >= NEAR else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def most_alike(a: str, b: str) -> float:
    """What the ratio of two names cannot exceed, by their letters as bags."""
    a, b = a.lower().strip(), b.lower().strip()
    return 2.0 * sum(min(a.count(x), b.count(x)) for x in set(a)) / (len(a) + len(b)) if a and b else 0.0


def near_pairs(k: DataFrame) -> DataFrame:
    """a, b, ratio: names of at least five letters whose ratio reaches NEAR in either order.

    Lossless: with M letters matched, the unmatched ones of both names are at most M(2-2*NEAR)/NEAR; each breaks at most
    two of a name's letter pairs, so names of n letters share n-1 less that many pairs (as bags). Of a name's pairs,
    sorted by rarity, one of the first that may differ and one more must then be shared: names are joined on those.
    """
    names = k.where(F.length("name") >= NEAR_LETTERS).select("cand_id", "name", F.lower(F.trim("name")).alias("low")).where("low != ''")
    unique = names.groupBy("low").agg(F.min("cand_id").alias("cand_id"))
    same = names.join(unique.withColumnRenamed("cand_id", "a"), "low").where("cand_id != a").select("a", F.col("cand_id").alias("b"), F.lit(1.0).alias("ratio"))
    unique = unique.withColumn("n", F.length("low"))
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: F.substr("low", i, F.lit(2)))
    # The k-th occurrence of a pair is an item of its own, so bags become sets.
    items = unique.select("cand_id", "low", "n", F.posexplode(two).alias("pos", "pair"))
    items = items.withColumn("item", F.concat("pair", F.row_number().over(Window.partitionBy("cand_id", "pair").orderBy("pos")).cast("string")))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    ranked = items.join(often, "item").withColumn("rank", F.row_number().over(Window.partitionBy("cand_id").orderBy("often", "item")))
    least_shared = F.ceil(F.col("n") - 1 - F.col("n") * (2 * (2 - 2 * NEAR) / NEAR) - 1e-9)
    prefix = ranked.where(F.col("rank") <= F.col("n") - least_shared).select("cand_id", "low", "n", "item")
    other = prefix.select([F.col(c).alias(f"r_{c}") for c in prefix.columns])
    met = prefix.join(other, (F.col("item") == F.col("r_item")) & (F.col("cand_id") < F.col("r_cand_id")) & (F.least("n", "r_n") >= F.greatest("n", "r_n") * (NEAR / (2 - NEAR)) - 1e-9))
    # Few bytes of pairs are much work for one task: a number of partitions that is given is kept, and the ratio is not
    # taken for pure, or the filter would move before the exchange and ratios be found twice.
    spread = int(k.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.select(F.col("cand_id").alias("a"), F.col("r_cand_id").alias("b"), "low", "r_low").repartition(spread, "a", "b").distinct()
    met = met.withColumn("ratio", _near_ratio.asNondeterministic()("low", "r_low")).where(F.col("ratio") >= NEAR)
    return met.select("a", "b", "ratio").unionByName(same)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reached): labels travel along edges and jump to their labels' labels until still."""
    e = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = stored(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("node"), F.col("m").alias("root")))
    while True:
        heard = e.join(labels, e.v == labels.node).groupBy("u").agg(F.min("root").alias("m"))
        moved = labels.join(heard, labels.node == heard.u, "left").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        moved = stored(moved)
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = stored(moved.join(jump, "root", "left").select("node", F.least("root", "next").alias("root"), "old"))
        if not moved.where("root != old").limit(1).count():
            return moved.select("node", "root")
        labels = moved.select("node", "root")


# ---- ordered clustering ----


class _Entity:
    """A candidate or a registry entry: what matching sees of it or of its merged members."""

    __slots__ = ("contacts", "domain", "key", "low", "name", "number", "places", "plain", "platforms")

    def __init__(self, number: int, name, domain, phones, profiles, name_key, places):
        self.number, self.domain, self.places = number, domain or None, set(places)
        self.platforms = dict(p.split(":", 1) for p in profiles)
        self.contacts = {*phones, *(f"{k}:{v}" for k, v in self.platforms.items())}
        self._call(name, name_key)

    def _call(self, name: str | None, key: str | None) -> None:
        self.name, self.key = name, key
        self.plain = bool(name) and not name.startswith("@") and "." not in name
        self.low = name.lower().strip() if name and len(name) >= NEAR_LETTERS else None

    def absorb(self, c: _Entity) -> set | None:
        """Take what a candidate adds; the keys (see keys()) that the entry got by it, or None."""
        renamed = bool(c.name) and (not self.name or (c.plain and not self.plain))
        fresh = {k: v for k, v in c.platforms.items() if k not in self.platforms} if c.platforms else {}
        if not (renamed or fresh or (c.domain and not self.domain) or not c.places <= self.places or not c.contacts <= self.contacts):
            return None
        before = set(self.keys())
        self.domain = self.domain or c.domain
        self.contacts |= {p for p in c.contacts if ":" not in p} | {f"{k}:{v}" for k, v in fresh.items()}
        self.platforms |= fresh
        self.places |= c.places
        if renamed:
            self._call(c.name, c.key)
        return set(self.keys()) - before

    def groups(self) -> list[tuple]:
        return [(kind, x) for kind, x in (("key", self.key), ("low", self.low)) if x]

    def keys(self) -> Iterator[tuple]:
        """All that others may meet it by: (domain,) or (lacks a domain, contact or name, place)."""
        if self.domain:
            yield (self.domain,)
        for open_ in (False,) if self.domain else (False, True):
            for p in self.contacts:
                yield (open_, p, ANYWHERE)
            for g in self.groups():
                yield (open_, g, ANYWHERE)
                for place in self.places or (NOWHERE,):
                    yield (open_, g, place)

    def holds(self, key: tuple) -> bool:
        """Whether a key it once had still is one. A key that was lost never comes back."""
        if len(key) == 1:
            return True
        open_, what, place = key
        return not (open_ and self.domain) and not (isinstance(what, tuple) and what[1] != (self.key if what[0] == "key" else self.low)) and not (place is NOWHERE and self.places)


#: In place of a place: any or none, and none known.
ANYWHERE, NOWHERE = 0, 1


class _Firsts:
    """The registry by keys: for each key the number of the first entry that holds it, in steps that do not grow with the block.

    The five tiers (J4-J9) in these keys: equal domains, if both have one; else a common phone or profile; else equal name
    keys or near names, at a common place or where one of the two has no place.
    """

    def __init__(self, near_first: bool, names: _Near):
        self.heaps: dict[tuple, list[int]] = {}
        self.near_first, self.names = near_first, names

    def first(self, key: tuple, entries: dict[int, _Entity] | None) -> int | None:
        heap = self.heaps.get(key)
        while heap and entries is not None and not entries[heap[0]].holds(key):
            heappop(heap)
        return heap[0] if heap else None

    def find(self, c: _Entity, entries: dict[int, _Entity] | None = None) -> int | None:
        """The least number that matches. entries: as they are now, where they change."""
        open_ = c.domain is not None
        keys = [(c.domain,)] if open_ else []
        keys += [(open_, p, ANYWHERE) for p in c.contacts]
        groups = [("key", c.key)] if c.key else []
        if c.low:
            groups += [("low", x) for x in self.names.near(c.low, self.near_first)]
        for g in groups:
            keys += [(open_, g, place) for place in (*c.places, NOWHERE)] if c.places else [(open_, g, ANYWHERE)]
        return min((n for k in keys if (n := self.first(k, entries)) is not None), default=None)

    def put(self, keys, number: int, changes: bool) -> bool:
        """Whether any key's numbers changed. changes: entries may lose keys, so later numbers are kept; else the least is enough."""
        moved = False
        for k in keys:
            heap = self.heaps.setdefault(k, [])
            if changes:
                heappush(heap, number)
            elif not heap or number < heap[0]:
                heap[:] = [number]
            else:
                continue
            moved = True
        return moved


class _Near:
    """Tier 5: the lower-cased names that are near to a name, itself among them."""

    def __init__(self):
        self.listed: dict[str, set[str]] = {}
        self.judged: dict[tuple[str, bool], list[str]] = {}
        self.others: list[str] | None = None

    def told(self, low: str, names) -> None:
        """The names that near_pairs found for a name; they come with its first candidate."""
        self.listed.setdefault(low, set()).update(x.lower().strip() for x in names)
        self.judged.pop((low, True), None), self.judged.pop((low, False), None)

    def near(self, low: str, first: bool) -> list[str]:
        """first: those x of which near(x, low) holds, else near(low, x)."""
        if (low, first) not in self.judged:
            others = self.listed.get(low, ()) if self.others is None else self.others
            self.judged[low, first] = [low] + [x for x in others if x != low and (near(x, low) if first else near(low, x))]
        return self.judged[low, first]


def near(x: str, y: str) -> bool:
    """Tier 5 for two lower-cased names, in this order; lengths too far apart cannot match enough letters."""
    short, long = sorted((len(x), len(y)))
    return short >= long * (NEAR / (2 - NEAR)) - 1e-9 and similarity(x, y) >= NEAR


#: Kinds of rows whose results a block remembers.
SETTLED = 200_000


class _Block:
    """The ordered rules over candidates in order of arrival, one at a time."""

    def __init__(self, mode: str):
        self.live, self.names = mode == "live", _Near()
        self.index, self.entries = _Firsts(self.live, self.names), {}
        self.settled: dict[tuple, int] = {}

    def row(self, number: int, name, domain, phones, profiles, name_key, places, near=None) -> int:
        """take() for a row; near: what near_pairs found for its name. A row like one that changed nothing, with no
        change since, has that one's result."""
        kind = (name, domain, name_key, *phones, 0, *profiles, 0, *places)
        hit = None if near else self.settled.get(kind)
        if hit is None:
            c = _Entity(number, name, domain, phones, profiles, name_key, places)
            if near and c.low:
                self.names.told(c.low, near)
                self.settled.clear()
            hit = self.take(c)
            if len(self.settled) >= SETTLED:
                self.settled.clear()
            if not self.changed:
                self.settled[kind] = hit
            elif self.settled:
                self.settled.clear()
        return hit

    def take(self, c: _Entity) -> int:
        """The number of the first member of the candidate's cluster.

        live (J1): each candidate against merged entries, the entry first; the first that matches absorbs it.
        batch (J3): each candidate against the members of clusters, the candidate first; it joins the first cluster with a match.
        """
        hit = self.index.find(c, self.entries if self.live else None)
        if hit is None or not self.live:
            self.changed = hit is None
            hit = c.number if hit is None else hit
            self.changed |= self.index.put(c.keys(), hit, self.live)
            if self.live:
                self.entries[hit] = c
        else:
            got = self.entries[hit].absorb(c)
            self.changed = got is not None
            if got:
                self.index.put(got, hit, True)
        return hit


KEYED = ["name", "domain", "phones", "profiles", "name_key", "places"]


def _numbers(block: pd.DataFrame, mode: str) -> list[int]:
    run = _Block(mode)
    rows = list(block[KEYED].itertuples(index=False))
    run.names.others = list(dict.fromkeys(low for r in rows if (low := _Entity(0, *r).low)))
    return [run.row(i, *r) for i, r in enumerate(rows)]


def _live(block: pd.DataFrame) -> list[int]:
    return _numbers(block, "live")


def _batch(block: pd.DataFrame) -> list[int]:
    return _numbers(block, "batch")


def clusters(candidates: DataFrame, mode: str = "live") -> DataFrame:
    """cand_id, cluster_id (the first member's cand_id). mode: "live" registry or "batch" merge.

    Blocks are found among candidates that differ in what links them, of each such kind the first. A block's rows pass
    through one task in order of arrival; the task holds its registry, not the rows.
    """
    k = stored(_plain_keys(candidates))
    linked = ["name", "domain", "phones", "profiles"]
    kinds = stored(k.groupBy(*linked).agg(F.min("cand_id").alias("cand_id")).withColumn("name_key", X.name_key("name")))
    close = stored(near_pairs(kinds).where("ratio < 1"))
    blocks = components(pairs(key_rows(kinds)).select("a", "b").union(close.select("a", "b")))
    both = close.select("a", "b").union(close.select("b", "a"))
    names = kinds.select(F.col("cand_id").alias("b"), F.col("name").alias("near"))
    told = both.join(names, "b").groupBy(F.col("a").alias("first")).agg(F.collect_set("near").alias("told"))
    keys = F.coalesce("domain", "name_key", low_name()).isNotNull() | (F.size("phones") > 0) | (F.size("profiles") > 0)
    kinds = kinds.where(keys).withColumnRenamed("cand_id", "first").join(blocks, F.col("first") == F.col("node"), "left").join(told, "first", "left")
    kinds = kinds.select("first", F.coalesce("root", "first").alias("root"), "name_key", "told", *[F.col(c).alias(f"k_{c}") for c in linked])
    same = F.lit(True)
    for c in linked:
        same &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
    # Nothing meets a candidate without any of these, and they may be many.
    bare = F.coalesce("name", F.lit("")).eqNullSafe("") & F.col("domain").isNull() & (F.size("phones") == 0) & (F.size("profiles") == 0)
    every = k.where(~bare).join(kinds, same, "left")
    inside = every.where("root is not null").select("root", "cand_id", *KEYED, F.when(F.col("cand_id") == F.col("first"), F.col("told")).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            found = []
            for root, *r in zip(*map(_values, batch.columns), strict=True):
                if root != now:
                    now, block = root, _Block(mode)
                found.append(block.row(*r))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.int64())], ["cand_id", "cluster_id"])

    found = inside.repartition("root").sortWithinPartitions("root", "cand_id").mapInArrow(run, "cand_id long, cluster_id long")
    alone = every.where("root is null").select("cand_id").union(k.where(bare).select("cand_id"))
    return found.unionByName(alone.withColumn("cluster_id", F.col("cand_id")))


def _values(column: pa.Array) -> list:
    """Values of a column, lists among them (a null one is empty), without an object for each on Arrow's side."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    ends, values = column.offsets.to_numpy().tolist(), column.flatten().to_numpy(zero_copy_only=False).tolist()
    return [values[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]


# ---- merging ----

RANKS = {"high": 0, "medium": 1, "low": 2}


def _rank(c: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in RANKS.items()], F.lit(3))


def _first(c: str, when: Column | None = None) -> Column:
    """A3: the first filled value in order of arrival."""
    ok = ~X.blank(F.col(c)) if when is None else when
    return F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("cand_id"))).alias(c)


def _longest(c: str) -> Column:
    """A4: the longest text, the first of those."""
    ok = ~X.blank(F.col(c))
    return F.max_by(F.when(ok, F.col(c)), F.when(ok, F.struct(F.length(c), -F.col("cand_id")))).alias(c)


def _union(rows: DataFrame, c: str, key, value=lambda v: v) -> DataFrame:
    """The lists' values of a cluster in order, the first of each key kept. A key with many copies is folded
    before the lists are put together."""
    each = rows.select("cluster_id", "cand_id", F.posexplode(c).alias("pos", "v")).select("cluster_id", F.struct("cand_id", "pos").alias("at"), value(F.col("v")).alias("v"))
    each = each.withColumn("key", key(F.col("v"))).where(~X.blank(F.col("key")))
    kept = each.groupBy("cluster_id", "key").agg(F.min_by("v", "at").alias("v"), F.min("at").alias("at"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])
    return kept.groupBy("cluster_id").agg(lists.alias(c))


def merge(candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """One record for each cluster; assigned: cand_id, cluster_id. The record of a single member is left as it is."""
    members = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"))
    every = stored(candidates.join(assigned, "cand_id").join(members, "cluster_id"))
    alone, rows = every.where("members = 1"), every.where("members > 1").drop("members")
    plain = ~F.col("name").startswith("@") & ~F.contains("name", F.lit("."))
    named = ~X.blank(F.col("name"))
    intent = F.col("lead_type").isin("explicit_intent", "explicit_and_opportunity") | F.col("intent_evidence").isNotNull()
    chance = F.col("lead_type").isin("opportunity", "explicit_and_opportunity") | (F.coalesce(F.size("service_opportunities"), F.lit(0)) > 0)
    out = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min_by(F.when(named, F.col("name")), F.when(named, F.struct(~plain, "cand_id"))).alias("name"),
        *[_first(c) for c in ("website", "domain", "address", "industry", "short_reason", "service_requested", "intent_confidence")],
        _first("intent_evidence", F.col("intent_evidence").isNotNull()),
        _longest("description"),
        _longest("about"),
        F.bool_or(F.coalesce("is_historical", F.lit(False))).alias("is_historical"),
        F.bool_or(F.coalesce("is_directory", F.lit(False))).alias("is_directory"),
        F.bool_or(F.coalesce(intent, F.lit(False))).alias("__i"),
        F.bool_or(F.coalesce(chance, F.lit(False))).alias("__o"),
        F.min("cand_id").alias("cand_id"),
    )
    kind = F.when(F.col("__i") & F.col("__o"), "explicit_and_opportunity").when(F.col("__i"), "explicit_intent").when(F.col("__o"), "opportunity")
    out = out.withColumn("lead_type", kind).withColumn("normalized_name", X.normalize_name("name")).drop("__i", "__o")
    low = lambda v: F.lower(F.trim(v))
    lists = [
        _union(rows, "emails", lambda v: low(v["value"])),
        _union(rows, "phone_numbers", lambda v: F.trim(v["value"])),
        _union(rows, "services", low, F.trim),
        _union(rows, "locations", low, F.trim),
        _union(rows, "sources", lambda v: v),
        merge_profiles(rows),
        merge_opportunities(rows),
        rows.select("cluster_id", "cand_id", F.posexplode("evidence").alias("pos", "v")).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_id", "pos", "v"))), lambda x: x["v"]).alias("evidence")),
    ]
    for x in lists:
        out = out.join(x, "cluster_id", "left")
    return out.unionByName(alone.select(*[F.col(c) if c in alone.columns else F.lit(None).cast(t).alias(c) for c, t in out.dtypes]))


def merge_profiles(rows: DataFrame) -> DataFrame:
    """The first filled profile of each platform."""
    each = rows.select("cluster_id", "cand_id", F.explode("social_profiles").alias("k", "v")).where(~X.blank(F.col("v")))
    kept = each.groupBy("cluster_id", "k").agg(F.min_by("v", "cand_id").alias("v"))
    return kept.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("social_profiles"))


def merge_opportunities(rows: DataFrame) -> DataFrame:
    """Each service's most confident opportunity, the first of equals; most confident services first."""
    each = rows.select("cluster_id", "cand_id", F.posexplode("service_opportunities").alias("pos", "o"))
    each = each.withColumn("at", F.struct("cand_id", "pos")).withColumn("rank", _rank(F.col("o.confidence")))
    best = each.groupBy("cluster_id", F.col("o.service").alias("service")).agg(F.min_by("o", F.struct("rank", "at")).alias("o"), F.min("rank").alias("rank"), F.min("at").alias("at"))
    return best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "at", "o"))), lambda x: x["o"]).alias("service_opportunities"))
