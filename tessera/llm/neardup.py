"""Near-duplicate removal with wide SimHash fingerprints (the second use of operator 10's bit-sliced comparison).

Documents are near duplicates if their sets of five-word shingles are at least LEAST alike (Jaccard). A 64-bit
fingerprint cannot tell that reliably, so here it has WIDE bits:

1. Texts with the same words are folded: what follows sees one node for each different text, however many rows have it.
2. A text's keys are KEYS pairs of min-hashes of its shingle set. Two sets LEAST alike agree on a pair with a chance of
   LEAST squared whatever their sizes, so they lack a common key with a chance under MISSED.
3. Texts with an equal key are compared bit-sliced; those within the radius and of fitting sizes are candidates. The
   radius is so wide that two sets LEAST alike lie beyond it with a chance under MISSED. A comparison emits a spanning
   forest of its candidates, nearest first.
4. Candidates are checked exactly on their shingle sets. Where a check fails, the forest may hide a true link, so the
   texts of that component go through 3 once more, for every candidate of two groups that the checks left apart. Groups
   of a key with over DENSE candidates a text emit their texts instead; those are compared exactly, all pairs of a block
   by one matrix product. DENSE sets which way a link is found, never whether.
5. Components over the checked links are the groups; the smallest doc_id of each stays.

Memory: a comparison holds two blocks of rows (bitslice.py), and with sets two blocks of BLOCK_SHINGLES or one text;
Spark hands Arrow batches of 64 MB at most to Python, the pipeline fewer.

Edge cases: texts of fewer than five words are one shingle; null and blank texts are one text without words, alike only
to each other; rows that repeat a doc_id are one document, so they stand or fall together, and a document with several
texts joins the groups of all of them; a null doc_id names no row and stays; an empty table stays empty; other columns
pass through.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitslice
from tessera.llm.common import cut, join_heavy
from tessera.llm.simhash import components

WIDE, SHINGLE, LEAST, MISSED = 256, 5, (4, 5), 1e-9
#: Largest chance that a bit differs between two sets that are LEAST alike: 4 shingles and the same with one more.
SHARE = 3 / 16
#: Pairs of min-hashes: all of them differ with a chance under MISSED.
KEYS = math.ceil(math.log(MISSED) / math.log(1 - (LEAST[0] / LEAST[1]) ** 2))


def _radius() -> int:
    """The least distance that differing bits exceed with a chance under MISSED."""
    tail, r = 0.0, WIDE
    while tail < MISSED:
        tail += math.comb(WIDE, r) * SHARE**r * (1 - SHARE) ** (WIDE - r)
        r -= 1
    return r + 1


RADIUS = _radius()
#: Candidates a text that a group of a key may emit before its texts are compared exactly instead.
DENSE = 4
#: Shingles of a block that is compared exactly, and columns of its matrix that are multiplied at once.
BLOCK_SHINGLES, COLUMNS = 2_000_000, 4096
#: Largest table of ids that is sent to all executors.
BROADCAST_IDS = 1_000_000


# ---- what a text becomes ----


def _odd(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    return np.array([xxhash.xxh64_intdigest(b"%d" % i, seed) | 1 for i in range(n)], np.uint64)


PLACES, SPREAD, ORDERS = _odd(SHINGLE, 1), _odd(WIDE // 64, 2), _odd(2 * KEYS, 3)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to MOST of them: each takes over 100 bytes of every worker."""

    MOST = 50_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.MOST:
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes) -> tuple[bytes, np.ndarray]:
    """The words' digest and the distinct 64-bit hashes of their shingles, sorted."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    digest = hashlib.md5(b" ".join(words)).digest()
    if not words:
        return digest, np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    total = np.full(n, min(len(w), SHINGLE), np.uint64)
    for k in range(min(len(w), SHINGLE)):
        total += w[k : k + n] * PLACES[k]
    return digest, np.unique(mixed(total))


def column_counts(words: np.ndarray) -> np.ndarray:
    """How many rows of words have each bit set: carry-save adders turn three rows of a weight into one and a carry."""
    n, wide = words.shape
    total = np.zeros(wide * 64, np.int64)
    weight, level = 1, words
    while len(level):
        carries = []
        while len(level) >= 3:
            k = len(level) // 3
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            x = a ^ b
            carries.append(a & b | x & c)
            level = np.concatenate([x ^ c, level[3 * k :]])
        bits = np.unpackbits(np.ascontiguousarray(level).view(np.uint8), axis=1, bitorder="little")
        total += weight * bits.sum(axis=0, dtype=np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return total


def wide_fingerprint(h: np.ndarray) -> bytes:
    """WIDE bits, each the majority over the shingles; a shingle's bits come from its hash by multiplication."""
    counts = np.zeros(WIDE, np.int64)
    for lo in range(0, len(h), 1 << 14):
        counts += column_counts(mixed(h[lo : lo + (1 << 14), None] * SPREAD))
    return np.packbits(counts * 2 > len(h), bitorder="little").tobytes()


def pair_keys(h: np.ndarray) -> np.ndarray:
    """KEYS keys, each of the least shingles in two orders; none for a text without words."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(2 * KEYS, bitslice.FULL)
    for lo in range(0, len(h), 1 << 12):
        least = np.minimum(least, (ORDERS[:, None] * h[None, lo : lo + (1 << 12)]).min(axis=1))
    first, second = least[0::2], least[1::2]
    return mixed(mixed(first + np.arange(KEYS, dtype=np.uint64)) + second).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, words (their digest), fp, size (number of shingles) and keys of each row."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                said = [shingles(t, hashes) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *(KEYS if len(h) else 0 for _, h in said)])
                keys = np.concatenate([pair_keys(h) for _, h in said])
                cols = [pa.array([w for w, _ in said], pa.binary()), pa.array([wide_fingerprint(h) for _, h in said], pa.binary()), pa.array([len(h) for _, h in said], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "words", "fp", "size", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, words binary, fp binary, size int, keys array<long>")


# ---- candidates ----


def _frame(a, b, key=None) -> pa.RecordBatch:
    cols = [a, b] if key is None else [a, b, key]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "key"][: len(cols)])


def _near(t: pa.Table):
    """node, group of the rows of whole groups, and their candidates (x, y), nearest first and ties by node."""
    node, size, label = bitslice.column(t, "node"), bitslice.column(t, "size"), bitslice.column(t, "part")
    fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(-1, WIDE // 64)
    group, side = bitslice.groups_of(t, ["key"])
    x, y = bitslice.pairs_within(group, side, bitslice.column(t, "i") == bitslice.column(t, "j"), fps, RADIUS)
    ok = (label[x] != label[y]) & (np.minimum(size[x], size[y]) * LEAST[1] >= np.maximum(size[x], size[y]) * LEAST[0])
    x, y = x[ok], y[ok]
    flip = node[x] > node[y]
    x, y = np.where(flip, y, x), np.where(flip, x, y)
    order = np.lexsort((node[y], node[x], bitslice.distances(fps, x, y)))
    return node, group, x[order], y[order]


def forests(rows: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the candidates that share a key. rows: key, node, fp, size, part, blocks."""

    def compare(batches):
        for t in bitslice.runs(batches, ["key"]):
            node, _, x, y = _near(t)
            e = bitslice.spanning(len(node), x, y)
            yield _frame(node[x[e]], node[y[e]])

    return bitslice.dealt(rows, "node", ["key"]).mapInArrow(compare, "a long, b long").distinct()


def every_candidate(rows: DataFrame) -> DataFrame:
    """a, b, key: all candidates of different parts that share a key; of a dense group (node, node) for each text."""

    def compare(batches):
        for t in bitslice.runs(batches, ["key"]):
            node, group, x, y = _near(t)
            key = bitslice.column(t, "key")
            dense = np.bincount(group[x], minlength=group[-1] + 1) > DENSE * np.bincount(group)
            thin, whole = ~dense[group[x]], dense[group]
            x, y = x[thin], y[thin]
            yield _frame(np.append(node[x], node[whole]), np.append(node[y], node[whole]), np.append(np.zeros(len(x), np.int64), key[whole]))

    return bitslice.dealt(rows, "node", ["key"]).mapInArrow(compare, "a long, b long, key long").distinct()


# ---- exact checks ----


def enough(both, n, m):
    """Whether sets of n and m with so many in both are at least LEAST alike."""
    return both * LEAST[1] >= (n + m - both) * LEAST[0]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each left set shares with each right one: products of 0/1 matrices, some columns at a time."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, where, many = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    keep = many[where] > 1  # others are in one set only
    column = (np.cumsum(many > 1) - 1)[where[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int((many > 1).sum())
    edges = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        mine = slice(edges[k], edges[k + 1])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[mine], column[mine] - k * COLUMNS] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def exact_links(rows: DataFrame) -> DataFrame:
    """a, b: pairs of a group that are alike enough, as a spanning forest of parts. rows hold set besides."""

    def compare(batches):
        for t in bitslice.runs(batches, ["key"], "size", BLOCK_SHINGLES):
            node, label = bitslice.column(t, "node"), bitslice.column(t, "part")
            group, side = bitslice.groups_of(t, ["key"])
            inner = bitslice.column(t, "i") == bitslice.column(t, "j")
            sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                mid = lo if inner[lo] else lo + int((side[lo:hi] == 0).sum())
                a, b = (lo, hi) if inner[lo] else (lo, mid)
                both = common_counts(sets[a:b], sets[mid:hi])
                x, y = np.nonzero(enough(both, size[a:b, None], size[None, mid:hi]))
                x, y = x + a, y + mid
                e = bitslice.spanning(hi - lo, x - lo, y - lo, label[lo:hi])
                yield _frame(np.minimum(node[x[e]], node[y[e]]), np.maximum(node[x[e]], node[y[e]]))

    return bitslice.dealt(rows, "node", ["key"]).mapInArrow(compare, "a long, b long").distinct()


def _limited(ids: DataFrame) -> DataFrame:
    """ids, sent to all executors if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def with_sets(nodes: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """node and set, the shingle hashes of its text as bytes, for each of nodes; the text is read again from docs."""

    def sets(batches):
        hashes = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                said = [shingles(t, hashes) for t in b.column("text").slice(lo, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in said], pa.binary()), pa.array([h.tobytes() for _, h in said], pa.binary())], names=["words", "set"])

    wanted = cut(texts.select("node", "words", "doc").join(nodes, "node"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(_limited(wanted.select("doc").distinct()), "doc")
    held = some.select("text").mapInArrow(sets, "words binary, set binary").join(_limited(wanted.select("words", "node")), "words")
    return cut(held.groupBy("node").agg(F.first("set").alias("set")))


def checked(pairs: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) with alike: whether their texts' shingle sets are at least LEAST alike."""
    held = with_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, docs)

    def judge(batches):
        for b in batches:
            said = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                said.append(bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(said, pa.bool_())], names=["a", "b", "alike"])

    joined = pairs.join(held.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return cut(joined.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long, alike boolean"))


# ---- groups ----


def links_between(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links between different texts (node, words, doc, fp, size, keys) that connect all that are alike enough."""
    keyed = cut(bitslice.shared(texts.select("node", F.explode("keys").alias("key")), "node", ["key"]).select("key", "node", "blocks"))
    first = checked(cut(forests(keyed.join(texts.select("node", "fp", "size", F.col("node").alias("part")), "node"))), texts, docs)
    links = first.where("alike").select("a", "b")
    failed = first.where("not alike").select("a", "b")
    if not failed.limit(1).count():
        return links
    near = cut(components(first.select("a", "b")))
    # A component of two texts has no other pair.
    doubtful = failed.select(F.col("a").alias("node")).join(near, "node").select("root").distinct().join(near.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 2"), "root").select("root")
    again = near.join(doubtful, "root", "left_semi").join(components(links).select("node", F.col("root").alias("part")), "node", "left")
    again = cut(texts.select("node", "fp", "size").join(again.select("node", F.coalesce("part", "node").alias("part")), "node"))
    some = cut(keyed.select("key", "node").join(_limited(again.select("node")), "node"))
    rows = cut(every_candidate(bitslice.shared(some, "node", ["key"]).join(again, "node")).join(failed, ["a", "b"], "left_anti"))
    links = links.unionByName(checked(rows.where("a != b").select("a", "b").distinct(), texts, docs).where("alike").select("a", "b"))
    dense = cut(rows.where("a = b").select("key", F.col("a").alias("node")).distinct().join(again.select("node", "size", "part"), "node"))
    if dense.limit(1).count():
        sets = with_sets(dense.select("node").distinct(), texts, docs)
        blocked = bitslice.shared(dense, "node", ["key"], F.col("size"), BLOCK_SHINGLES)
        links = links.unionByName(cut(exact_links(blocked.join(sets, "node"))))
    return links


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and group (the smallest doc_id of its group) for each different doc_id of docs."""
    light = cut(fingerprints(docs))
    folded = light.groupBy("words").agg(F.min("doc_id").alias("doc"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    texts = cut(folded.where("doc is not null").withColumn("node", F.monotonically_increasing_id()))
    links = links_between(texts, docs)
    named = join_heavy(light.where("doc_id is not null").select("doc_id", "words"), texts.select("words", "node", "copies"), "words", "copies").select("doc_id", "node").distinct()
    named = cut(named)
    # A document of several texts links them.
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").select("doc_id", "a")
    links = links.unionByName(named.join(several, "doc_id").where("node != a").select("a", F.col("node").alias("b")))
    group = texts.select("node", "doc", "copies").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = group.groupBy("root").agg(F.min("doc").alias("group"))
    group = cut(group.join(least, "root").select("node", "group", "copies"))
    return join_heavy(named, group, "node", "copies").groupBy("doc_id").agg(F.min("group").alias("group"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one of the smallest doc_id."""
    gone = cut(groups(docs).where(F.col("doc_id") != F.col("group")).select("doc_id"))
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
