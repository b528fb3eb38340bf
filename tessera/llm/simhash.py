"""Operator 10, SimHash near-dedup by bit-sliced comparison.

A document's fingerprint has a bit for each bit of its shingles' hashes: 1 if set in over half of them. Equal
fingerprints are folded first, so copies cost one row. Fingerprints within the radius r must agree on one of the r+2
choose 2 pairs of r+2 parts of the bits (at most r parts hold a difference, so two parts are equal): each pair of parts
is a key, and only fingerprints with an equal key are compared.

The comparison is bit-sliced (bitslice.py) for keys of every size: bit planes, vertical carry-save counters, and an end
for each word of 64 neighbours as soon as all of them are over the radius. Keys of many fingerprints are split into
blocks that are compared pairwise in separate tasks. A comparison emits a spanning forest of the links it found, never
all pairs; connected components over the forests are those over all links.

Components are found by rounds of min-label joins with reliable checkpoints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bitslice
from tessera.llm.common import cut, discard, join_heavy

BITS = 64
KEYS = ["kind", "key"]


# ---- fingerprints ----


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks part
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(starts)
    for lo in range(0, n, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + 65536], stops[lo : lo + 65536], strict=True)], "<u8")
        counts += bit_counts(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def with_fingerprint(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column("text")], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


# ---- links ----


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links between distinct fingerprints of column fp, enough to connect every component."""
    parts = radius + 2
    cuts = [round(i * BITS / parts) for i in range(parts + 1)]
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in pair) for pair in combinations(range(parts), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.kind", "k.key")

    def compare(batches):
        for t in bitslice.runs(batches, KEYS):
            fp = bitslice.column(t, "fp").view(np.uint64)
            group, side = bitslice.groups_of(t, KEYS)
            x, y = bitslice.pairs_within(group, side, bitslice.column(t, "i") == bitslice.column(t, "j"), fp[:, None], radius)
            order = np.lexsort((fp[y], fp[x], bitslice.distances(fp[:, None], x, y)))
            e = order[bitslice.spanning(len(fp), x[order], y[order])]
            yield pa.RecordBatch.from_arrays([pa.array(fp[x[e]].view(np.int64)), pa.array(fp[y[e]].view(np.int64))], names=["a", "b"])

    return bitslice.dealt(bitslice.shared(keyed, "fp", KEYS), "fp", KEYS).mapInArrow(compare, "a long, b long").distinct()


# ---- components ----


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b): root is the least node it reaches.

    Each round links every node's larger neighbours, then its smaller ones, to the least neighbour it knows (the
    large-star and small-star steps); rounds end when nothing changes. Depth shrinks by powers, so few are needed.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        old = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = e.groupBy("u").agg(F.min("v").alias("m"))
        star = e.join(small, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(star.where("u != v").distinct())
        discard(old)
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            every = e.unionByName(e.select(F.col("v").alias("u"), "v"))
            return every.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = mark


def simhash_components(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    Edge cases: a null or blank text has fingerprint zero and links like any other; repeated rows each get a row; a null
    doc_id belongs to its component and never names it, unless no other row is in it; an empty table gives no rows;
    other columns are ignored.
    """
    fps = cut(with_fingerprint(docs, size))
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = components(near_links(least.select("fp"), radius))
    # Folded to one row for each distinct fingerprint, so a large group of copies is one row until the last join.
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = cut(named.join(ids, "root").select("fp", "component_id", "copies"))
    return join_heavy(fps, answer, "fp", "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
