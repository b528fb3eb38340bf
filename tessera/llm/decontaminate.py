"""Operator 7, benchmark decontamination by spaced-seed hashing.

A text becomes tokens: lower case, ASCII punctuation parts words. A spaced seed is a fixed mask of positions that must
agree; the others are ignored, so a hash of the masked tokens survives substitutions between them. The masks below were
chosen so that, whatever two of SPAN_TOKENS tokens in a row are substituted, some mask still fits between them. Hashes
of the benchmark's places are looked up for every place of every training text; around each hit the item is laid over
the text, without gaps, and a window of SPAN_TOKENS tokens that agrees in at least LEAST_AGREEMENT of them is an overlap.
Windows that touch make one row. An item shorter than the window must agree in all its tokens.

The benchmark travels to the scan in chunks of a bounded number of tokens; one of more tokens takes several passes over
the texts, and their rows are put together. Texts are never shuffled.

Edge cases: null texts have no tokens; items of fewer than LEAST_ITEM tokens are ignored, since so short a text is not
evidence; repeated items and rows are each reported; an empty table on either side gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions that must agree, by mask.
MASKS = ((0, 1, 2, 5, 7, 8), (0, 1, 3, 5, 6, 7), (0, 1, 5, 8, 9, 10), (0, 1, 2, 4, 5, 6))
SPAN_TOKENS, LEAST_AGREEMENT, LEAST_ITEM = 13, 0.8, 5
#: Tokens of the benchmark in one pass.
CHUNK_TOKENS = 400_000
#: Hits that are expanded at once.
HITS = 1_000_000
#: ASCII bytes that are not letters or digits part tokens; other bytes belong to UTF-8 letters.
BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PRIME = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, item_id long, doc_start int, item_start int, n_tokens int, n_equal int"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANK).split()


class Words:
    """64-bit numbers of words, remembered."""

    MOST = 1_000_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.MOST:
                known.clear()
            known.update({w: xxhash.xxh64_intdigest(w, 7) for w in set(words)})
            return np.array([known[w] for w in words], np.uint64)


def masked(x: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every place where it fits."""
    n = len(x) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in mask:
        h = (h ^ x[i : i + n]) * PRIME
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Places of a chunk of benchmark items by masked hash."""

    def __init__(self, items: list[tuple[int, str | None]]):
        words = Words()
        self.ids, self.items = [], []
        for i, text in items:
            t = tokens(text)
            if len(t) >= LEAST_ITEM:
                self.ids.append(i)
                self.items.append(words(t))
        short = {len(x) for x in self.items if len(x) < SPAN_TOKENS}
        self.masks = [*MASKS, *(tuple(range(n)) for n in sorted(short))]
        self.tables = []
        for mask in self.masks:
            fixed = len(mask) == mask[-1] + 1
            h, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k, x in enumerate(self.items):
                if (len(x) != len(mask)) if fixed else len(x) < SPAN_TOKENS:
                    continue
                v = masked(x, mask)
                h.append(v)
                item.append(np.full(len(v), k))
                place.append(np.arange(len(v)))
            h, item, place = map(np.concatenate, (h, item, place))
            order = np.argsort(h, kind="stable")
            h, item, place = h[order], item[order], place[order]
            maybe = np.zeros(1 << 20, bool)  # says for most hashes at once that they are not there
            maybe[h >> np.uint64(44)] = True
            self.tables.append((h, item, place, maybe))

    def overlaps(self, x: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, doc_start, item_start, n_tokens, n_equal) of a text's overlaps."""
        diagonals: set[tuple[int, int]] = set()
        for mask, (h, item, place, maybe) in zip(self.masks, self.tables, strict=True):
            v = masked(x, mask)
            at = np.flatnonzero(maybe[v >> np.uint64(44)]) if len(v) else v
            if not len(at) or not len(h):
                continue
            lo, hi = np.searchsorted(h, v[at], "left"), np.searchsorted(h, v[at], "right")
            n = hi - lo
            got = n > 0
            at, lo, n = at[got], lo[got], n[got]
            # Texts and items that repeat words meet in many places of few diagonals, so they are taken in pieces.
            total = np.cumsum(n)
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(total, total[begin] + HITS)))
                a, k, c = at[begin:end], lo[begin:end], n[begin:end]
                entry = np.repeat(k - np.cumsum(c) + c, c) + np.arange(c.sum())
                found = np.unique(np.stack([item[entry], np.repeat(a, c) - place[entry]], axis=1), axis=0)
                diagonals.update(map(tuple, found.tolist()))
                begin = end
        out = []
        for k, d in sorted(diagonals):
            y = self.items[k]
            a, b = max(0, -d), min(len(y), len(x) - d)
            equal = x[d + a : d + b] == y[a:b]
            width = min(SPAN_TOKENS, len(y))
            need = int(np.ceil(LEAST_AGREEMENT * width)) if width == SPAN_TOKENS else width
            if b - a < width:
                continue
            run = np.concatenate([[0], np.cumsum(equal)])
            good = np.flatnonzero(run[width:] - run[:-width] >= need)
            if len(good):
                for part in np.split(good, np.flatnonzero(np.diff(good) > width) + 1):
                    s, e = int(part[0]), int(part[-1]) + width
                    out.append((self.ids[k], d + a + s, a + s, e - s, int(run[e] - run[s])))
        return out


def chunks(benchmark: DataFrame) -> Iterator[Index]:
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") // 2 + 1
        if size > CHUNK_TOKENS:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each overlap of a document with a benchmark item, tokens counted from 0."""
    spark = docs.sparkSession
    passes = []
    for index in chunks(benchmark):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def search(batches, sent=sent):
            index, words = pickle.loads(sent.value), Words()
            for b in batches:
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    out += [(i, *o) for o in index.overlaps(words(tokens(t.as_py())))]
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

        passes.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, SCHEMA))
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap a benchmark item; every column kept, texts judged where they lie."""
    spark = docs.sparkSession
    for index in chunks(benchmark):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def keep(batches, sent=sent):
            index, words = pickle.loads(sent.value), Words()
            for b in batches:
                clean = [not index.overlaps(words(tokens(t.as_py()))) for t in b.column("text")]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
