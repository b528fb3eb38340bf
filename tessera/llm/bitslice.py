"""The bit-sliced comparison of operator 10, and how keys deal rows to it.

Rows meet under keys. A key's rows are split into blocks, and every pair of a key's blocks is a group (key, i, j) of its
own: the rows of block i are its side 0, those of block j its side 1; a block with itself has side 0 only. Groups come to
a task sorted, as a stream, and are compared many at once.

Fingerprints are turned on their side: plane b holds bit b of all of them, 64 to a word; each side of a group begins a
word of its own. To compare a fingerprint with a word of 64 others, each plane is flipped where its own bit is set, and
carry-save adders count the differences in vertical counters. Words are abandoned once all their lanes are over the
radius. Found pairs are reduced to a spanning forest, so no group ever emits all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Rows of a block, so a group has twice as many at most.
BLOCK = 1024
#: Rows that are compared at once, if groups end; with them, the pairs that can be found at once are bounded.
ROWS = 2048
#: Most keys that are sent to all executors (16 bytes each).
BROADCAST_KEYS = 1_000_000
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- dealing keys ----


def shared(keyed: DataFrame, node: str, keys: list[str], weight: Column | None = None, most: int = 1) -> DataFrame:
    """The rows of keys that two nodes or more have, with blocks, the number of blocks of the key.

    Keys that bring exactly the same nodes together count once. keyed is read twice, so it should be stored. weight is
    summed over a key; a block holds most of it on average. Keys of over BLOCK rows are joined by a broadcast after
    their number is checked, so that none of them goes to one task; counting them is combined before it is shuffled.
    """
    blocks = F.expr(f"int((n + {BLOCK - 1}) div {BLOCK})")
    heavy = F.lit(0) if weight is None else weight
    marks = [F.count(F.lit(1)).alias("n"), F.sum(heavy.cast("long")).alias("heavy"), F.bit_xor(F.xxhash64(node)).alias("mark"), F.min(node).alias("low")]
    sizes = keyed.groupBy(*keys).agg(*marks).withColumn("blocks", F.greatest(blocks, F.ceil(F.col("heavy") / most).cast("int")) if weight is not None else blocks)
    sizes = cut(sizes.where("n > 1").select(*keys, "n", "mark", "low", "blocks"))
    alone = sizes.groupBy("n", "mark", "low", "blocks").agg(F.min(F.struct(*keys)).alias("k")).select("k.*", "blocks", "n")
    kept = cut(alone)
    big = sizes.where(f"n > {BLOCK}")
    if kept.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return keyed.join(F.broadcast(kept.drop("n")), keys)
    if big.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return keyed.join(kept.drop("n"), keys)  # over a billion rows in large keys: Spark splits skewed partitions
    rest = keyed.join(F.broadcast(big.select(*keys)), keys, "left_anti").join(kept.where(f"n <= {BLOCK}").drop("n"), keys)
    return rest.unionByName(keyed.join(F.broadcast(kept.where(f"n > {BLOCK}").drop("n")), keys))


def dealt(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """rows (with blocks) once for every group of their key: with i, j and side, sorted within tasks by group and side."""
    own = F.pmod(F.xxhash64(F.lit(7), node), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    all_of = rows.withColumn("own", own).withColumn("p", F.explode(pairs)).select(*rows.columns, F.col("p.i").alias("i"), F.col("p.j").alias("j"), (F.col("own") != F.col("p.i")).cast("int").alias("side"))
    return all_of.drop("blocks").repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "side", node)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], weight: str | None = None, most: int = 0) -> Iterator[pa.Table]:
    """Whole groups of a sorted stream, ROWS rows or a weight of most at once, and at most one group beyond."""
    held, n, w, last = [], 0, 0, None
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (*keys, "i", "j")])
        new = np.append(last is None or bool((ids[:, 0] != last).any()), (ids[:, 1:] != ids[:, :-1]).any(axis=0))
        heavy = np.cumsum(np.append(0, b.column(weight).to_numpy().astype(np.int64))) if weight else np.zeros(b.num_rows + 1, np.int64)
        lo = 0
        for at in np.flatnonzero(new).tolist():
            if n + at - lo >= ROWS or weight and w + heavy[at] - heavy[lo] >= most:
                held.append(b.slice(lo, at - lo))
                if any(x.num_rows for x in held):
                    yield pa.Table.from_batches(held)
                held, n, w, lo = [], 0, 0, at
        held.append(b.slice(lo))
        n, w, last = n + b.num_rows - lo, w + int(heavy[-1] - heavy[lo]), ids[:, -1].copy()
    if held:
        yield pa.Table.from_batches(held)


def column(t: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return t.column(name).to_numpy().astype(kind, copy=False)


def groups_of(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, and its side."""
    ids = np.stack([column(t, c) for c in (*keys, "i", "j")])
    return np.cumsum(np.append(False, (ids[:, 1:] != ids[:, :-1]).any(axis=0))), column(t, "side")


# ---- comparing ----


def pairs_within(group: np.ndarray, side: np.ndarray, inner: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y), x before y, at distance radius or less: of one group's two sides, or of side 0 where it is inner.

    Rows are sorted by group and side; inner says of each row whether its group is a block with itself.
    """
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = np.append(False, (group[1:] != group[:-1]) | (side[1:] != side[:-1]))
    part = np.cumsum(part)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    many = np.diff(np.append(first, n))
    words = (many + 63) >> 6
    begin = np.cumsum(words) - words
    lane = (begin[part] << 6) + np.arange(n) - first[part]
    # The words a row is compared with: from its own on within a block, else those of side 1 behind its side 0.
    follows = np.append((group[first[1:]] == group[first[:-1]]), False)[part] & (side == 0)
    after = np.minimum(part + 1, len(first) - 1)
    w0 = np.where(inner, lane >> 6, begin[after])
    count = np.where(inner, begin[part] + words[part] - w0, np.where(follows, words[after], 0))
    at = np.cumsum(count) - count
    q, w = np.repeat(lane, count), np.arange(count.sum()) - np.repeat(at - w0, count)
    n_lanes = int(words.sum()) << 6
    wide, empty, row = np.zeros((n_lanes, fps.shape[1]), np.uint64), np.ones(n_lanes, bool), np.zeros(n_lanes, np.int64)
    wide[lane], empty[lane], row[lane] = fps, False, np.arange(n)
    x, y = lanes_within(wide, empty, q, w, radius)
    return row[x], row[y]


def lanes_within(fps: np.ndarray, empty: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int, chunk: int = 16384) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (x, y) at distance radius or less, for queries q (lanes) against words w of 64 lanes each.

    Eight planes make seven full adders and one carry of weight eight, which ripples on through the higher counters.
    """
    bits = fps.shape[1] * 64
    wide = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").T
    planes = np.packbits(np.ascontiguousarray(wide), axis=1, bitorder="little").view("<u8")
    del wide
    closed = np.packbits(empty, bitorder="little").view("<u8")
    high = max(1, int(radius).bit_length() - 2)  # counters from weight eight up, one more than the radius needs
    step = max(8, bits // 8)
    found = []
    for lo in range(0, len(q), chunk):
        qs, ws = q[lo : lo + chunk], w[lo : lo + chunk]
        shift = (qs & 63).astype(np.uint64)
        own = np.where(qs >> 6 == ws, (np.uint64(2) << shift) - np.uint64(1), np.uint64(0))  # lanes up to one's own
        over = closed[ws] | own
        mine = fps[qs]
        low = [np.zeros(len(qs), np.uint64) for _ in range(3)]
        counters = [np.zeros(len(qs), np.uint64) for _ in range(high)]
        for b in range(0, bits, 8):
            d = [planes[b + i][ws] ^ (np.uint64(0) - (mine[:, b >> 6] >> np.uint64((b + i) & 63) & np.uint64(1))) for i in range(8)]
            low[0], t1 = _add(low[0], d[0], d[1])
            low[0], t2 = _add(low[0], d[2], d[3])
            low[1], f1 = _add(low[1], t1, t2)
            low[0], t1 = _add(low[0], d[4], d[5])
            low[0], t2 = _add(low[0], d[6], d[7])
            low[1], f2 = _add(low[1], t1, t2)
            low[2], carry = _add(low[2], f1, f2)
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
            if b + 8 > radius and (b + 8) % step == 0:
                over |= _over([*low, *counters], radius)
                live = over != FULL
                if not live.all():
                    qs, ws, over, mine = qs[live], ws[live], over[live], mine[live]
                    low, counters = [c[live] for c in low], [c[live] for c in counters]
                if not len(qs):
                    break
        if len(qs):
            hit = np.unpackbits((~(over | _over([*low, *counters], radius))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(hit)
            found.append((qs[r], ws[r] * 64 + lane))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder over words: sum and carry."""
    x = a ^ b
    return x ^ c, a & b | x & c


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the count in the vertical counters is over the radius: compared from the top bit down."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def distances(fps: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 1 << 16):
        out[lo : lo + (1 << 16)] = np.bitwise_count(fps[x[lo : lo + (1 << 16)]] ^ fps[y[lo : lo + (1 << 16)]]).sum(axis=1)
    return out


def spanning(n: int, x: np.ndarray, y: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Positions of the pairs, best first, that a spanning forest over n rows needs; rows of a label are one already.

    Each round takes the best pair that leaves each tree, so there are as many rounds as trees halve.
    """
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    at, kept = np.arange(len(x)), []
    while True:
        a, b = label[x], label[y]
        live = a != b
        x, y, at, a, b = x[live], y[live], at[live], a[live], b[live]
        if not len(x):
            return np.sort(np.array(kept, np.int64))
        best = np.full(n, len(x), np.int64)
        for ends in (a, b):
            mine = np.full(n, len(x), np.int64)
            mine[ends[::-1]] = np.arange(len(x) - 1, -1, -1)
            best = np.minimum(best, mine)
        up = np.arange(n)

        def find(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for e in np.unique(best[best < len(x)]).tolist():
            i, j = find(a[e]), find(b[e])
            if i != j:
                up[max(i, j)] = min(i, j)
                kept.append(at[e])
        while (up != up[up]).any():
            up = up[up]
        label = up[label]
