"""Operator 6, LM scoring: an n-gram trie in Elias-Fano coded, memory-mapped levels.

Level 1 holds the training tokens as sorted 64-bit hashes with their counts; a token's id is its rank. Level k holds the
k-grams as (parent, id), the parent being the place of the (k-1)-gram that they continue. Both are parted into shards:
level 1 by the top bits of the hash, the others by the parent; a parent with more than its share of the tokens is
spread over all shards by the id. In a shard the ranges of the parents' successors are a monotone sequence of
pointers. Successor ids are stretched by the size of their range, which makes all of them one monotone sequence of even
density, so a search for a successor, relative to its context, starts next to where it ends. Pointers and successors
are Elias-Fano coded; a probability is a 16-bit step of its logarithm.

Smoothing is interpolated modified Kneser-Ney discounting of raw counts: three discounts for each level, from the
numbers of k-grams seen once to four times, the rest passed to the shorter context; level 1 is the additive estimate
(c + 0.5) / (N + 0.5 (V + 1)).

Texts are split once: chunks of whole documents become files of a list of hashes and the numbers of the tokens in it,
which every pass over the documents reads, so a pass looks up each different word of a chunk once.

Counting is distributed: tasks count what they read, send each shard one compressed run of sorted keys and counts, and
a shard's task merges its runs and writes its file. Files live in the shared folder. Only figures of shards come to the
driver. All documents outside the held-out fifth are counted, whole.

Edge cases: a null or blank text is one end token; a null doc_id is in training; a token or context that training lacks
falls to the shorter one; without training rows the score of a token is that of 0.5 / 0.5; repeated rows count and are
scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import eliasfano as ef
from tessera.llm.common import cut, get_bytes, mapped, put_bytes, remove, scratch

#: What stands for the end of a text; no word holds white space.
END = b"\n"
#: Steps of log10 in a 16-bit code, of which 0 is "none".
STEP = 12.0 / 65534
#: Tokens in a shard of a level, documents in a shard of level 1, tokens of a chunk, which is counted or scored at once.
SHARD_TOKENS, SHARD_DOCS, BUFFER_TOKENS = 4_000_000, 8192, 1_000_000
#: Chunks that one task takes; bytes of text for each token of BUFFER_TOKENS that end a chunk of long words early.
TASK_CHUNKS, LONG = 2, 16
RUN = "shard int, keys binary, counts binary"


def digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(3)), np.uint64, len(words))


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        steps = np.rint(-np.log10(p) / STEP)
    return np.where(p > 0, 65535 - np.clip(steps, 0, 65534), 0).astype(np.uint16)


#: What each code stands for.
RESTORED = np.append(0.0, 10.0 ** -((65535 - np.arange(1, 65536).astype(float)) * STEP))


def restore(code: np.ndarray) -> np.ndarray:
    return RESTORED[code]


def _runs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """One row for each shard: its keys (sorted by shard, then key) as compressed differences, and counts."""
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
    press = zstandard.ZstdCompressor(level=1).compress
    rows = [(int(shard[a]), press(np.diff(keys[a:b], prepend=np.uint64(0)).tobytes()), press(counts[a:b].astype("<u4").tobytes())) for a, b in zip(first, np.append(first[1:], len(shard)), strict=True)]
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "keys", "counts"])


def _merged(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    grow = zstandard.ZstdDecompressor().decompress
    keys = np.concatenate([np.cumsum(np.frombuffer(grow(k), "<u8"), dtype=np.uint64) for k, _ in runs])
    counts = np.concatenate([np.frombuffer(grow(c), "<u4") for _, c in runs]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    press = zstandard.ZstdCompressor(level=1).compress
    return press(np.diff(keys, prepend=np.uint64(0)).tobytes()), press(counts.astype("<i8").tobytes())


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    grow = zstandard.ZstdDecompressor().decompress
    return np.cumsum(np.frombuffer(grow(keys), "<u8"), dtype=np.uint64), np.frombuffer(grow(counts), "<i8")


def _by_shard(batches, build):
    """Call build(shard, runs) for each shard of a task's rows, which are sorted by shard."""
    now, runs = None, []
    for b in batches:
        for s, k, c in zip(b.column("shard").to_pylist(), b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
            if s != now and runs:
                yield build(now, runs)
                runs = []
            now = s
            runs.append((k, c))
    if runs:
        yield build(now, runs)


class Known(dict):
    """Ids of words; new words get marks of -2 and down, in order, until they are looked up."""

    new: list[bytes]

    def __missing__(self, word: bytes) -> int:
        self[word] = mark = -2 - len(self.new)
        self.new.append(word)
        return mark


class Lexicon:
    """Level 1."""

    def __init__(self, uris: list[str], bases: list[int], shard_bits: int, tokens: int, types: int):
        self.uris, self.bases, self.shard_bits, self.tokens, self.types = uris, np.array([*bases, types], np.int64), shard_bits, tokens, types
        self.open: dict[int, tuple] = {}
        self.known = Known()

    def shard(self, s: int):
        if s not in self.open:
            arrays, meta = ef.unpack(mapped(self.uris[s]))
            self.open[s] = ef.Sequence(arrays, meta, "hash"), arrays["count"]
        return self.open[s]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 for those that training lacks."""
        bits = self.shard_bits
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(narrow(shard, len(self.uris)), kind="stable")
        for s, at in _parts(shard, order):
            if self.uris[s]:
                found = self.shard(s)[0].find(hashes[at] - (np.uint64(s) << np.uint64(64 - bits) if bits else np.uint64(0)))
                out[at] = np.where(found >= 0, found + self.bases[s], -1)
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, -1 for those that training lacks."""
        known = self.known
        if len(known) > 400_000:
            known.clear()
        new = known.new = []
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if new:
            out = self.find(digests(new))
            known.update(zip(new, out.tolist(), strict=True))
            marked = np.flatnonzero(ids < -1)
            ids[marked] = out[-2 - ids[marked]]
        return ids

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids, 0 for -1."""
        order = np.argsort(ids)
        unique, at = distinct(ids[order])
        back = np.empty(len(ids), np.int64)
        back[order] = at
        shard = np.searchsorted(self.bases, unique, side="right") - 1
        out = np.zeros(len(unique), np.int64)
        for s in np.unique(shard[unique >= 0]):
            at = np.flatnonzero((shard == s) & (unique >= 0))
            out[at] = self.shard(int(s))[1][unique[at] - self.bases[s]]
        return out[back]


class Level:
    """Level k above 1: k-grams by parent and id."""

    def __init__(self, uris: list[str], bases: list[int], parents: int, types: int, hot: list[int], spill: list[float]):
        self.uris, self.bases, self.parents, self.types = uris, np.array(bases, np.int64), parents, types
        self.hot, self.spill = np.array(hot, np.int64), np.array(spill, float)
        self.size = 0
        self.open: dict[int, tuple] = {}

    @property
    def local(self) -> int:
        """Parents of one's own in each shard; behind them come the hot ones."""
        return -(-self.parents // len(self.uris))

    def place(self, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard, and the parent's number in it."""
        n = len(self.uris)
        number = parent // n
        shard = parent - number * n
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, parent), len(self.hot) - 1)
            hot = self.hot[k] == parent
            shard, number = np.where(hot, (parent + word) % n, shard), np.where(hot, self.local + k, number)
        return shard, number

    def shard(self, s: int):
        if s not in self.open:
            arrays, meta = ef.unpack(mapped(self.uris[s]))
            self.open[s] = ef.Sequence(arrays, meta, "ptr"), ef.Sequence(arrays, meta, "next"), arrays["code"], arrays["rest"]
        return self.open[s]

    def order(self, shard: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The order by shard, hot parents last: of ascending k-grams it makes ascending places; numpy sorts 16 bits by digits."""
        return np.argsort(narrow(2 * shard + (number >= self.local), 2 * len(self.uris) + 1), kind="stable")

    def look(self, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For ascending k-grams (parent, word): an order in which their places ascend and, in this order, their
        place (-1: none), discounted probability, and what the parent passes on.

        A parent or word of -1 is unknown; a parent without successors passes everything on.
        """
        n = len(self.uris)
        shard, number = self.place(parent, np.maximum(word, 0))
        none = parent < 0
        shard[none], number[none] = n, -1
        order = self.order(shard, number)
        number, word = number[order], word[order]
        place, p, rest = np.full(len(parent), -1, np.int64), np.zeros(len(parent)), np.ones(len(parent))
        if len(self.hot):  # what hot parents pass on is gathered from all shards
            far = np.flatnonzero(number >= self.local)
            rest[far] = self.spill[number[far] - self.local]
        cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=n)))
        for s in np.flatnonzero(np.diff(cuts[: n + 1])).tolist():
            if not self.uris[s]:
                continue
            a, b = cuts[s], cuts[s + 1]
            ptr, following, code, passes = self.shard(s)
            numbers, back = distinct(number[a:b])
            begin, end = (x.astype(np.int64) for x in ptr.access_two(numbers))
            own = int(np.searchsorted(number[a:b], self.local))
            rest[a : a + own] = np.where(end > begin, restore(passes[numbers]), 1.0)[back[:own]]
            begin, size, w = begin[back], (end - begin)[back], word[a:b]
            asked = np.flatnonzero((w >= 0) & (size > 0))
            found = following.find((begin[asked] * self.types + w[asked] * size[asked]).astype(np.uint64))
            hit = np.flatnonzero(found >= 0)
            to, found = a + asked[hit], found[hit]
            place[to] = found + self.bases[s]
            p[to] = restore(code[found])
        return order, place, p, rest


class Model:
    """All levels."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.levels = lexicon, []

    def grams(self, tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, p: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """p of every token by all levels, and the context of every token for the level after: labels, and their places.

        tokens: places in ids, of texts one after another; ids ascend but for -1, an unknown word. p: that by level 1.
        Labels ascend with places but for those of unknown contexts.
        """
        begins = np.cumsum(lengths) - lengths
        label = np.empty_like(tokens)  # the token before, the start of a text having the number behind all ids
        label[1:] = tokens[:-1]
        label[begins] = len(ids)
        parents = np.append(ids, self.lexicon.types)
        for level in self.levels:
            order, first = grouped(label, tokens, len(parents), len(ids))
            at = order[first]
            moved, place, part, rest = level.look(parents[label[at]], ids[tokens[at]])
            back, to = np.empty_like(tokens), np.empty_like(moved)
            to[moved] = np.arange(len(moved))
            back[order] = np.repeat(to, np.diff(np.append(first, len(order))))
            p = p if p is None else part[back] + rest[back] * p
            label[1:] = back[:-1]  # the gram that ends at the token before
            label[begins] = len(place)
            parents = np.append(place, -1)
        return p, label, parents


def _parts(shard: np.ndarray, order: np.ndarray):
    """Each shard, with the places of its rows; order sorts them by shard."""
    cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def narrow(x: np.ndarray, end: int) -> np.ndarray:
    """Numbers below end in 16 bits, if they fit."""
    return x.astype(np.uint16) if end <= 1 << 16 else x


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse; what is sorted already is not sorted again."""
    if (x[1:] < x[:-1]).any():
        return np.unique(x, return_inverse=True)
    first = np.append(True, x[1:] != x[:-1])[: len(x)]
    return x[first], np.cumsum(first) - 1


def grouped(major: np.ndarray, minor: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by (major, minor), numbers below n and m, and where in it each different pair begins."""
    bits = len(major).bit_length()
    if n * m << bits < 2**63:  # the pair and its place in one number: numpy sorts numbers faster than their order
        key = (major * m + minor) << bits | np.arange(len(major))
        key.sort()
        order = key & ((1 << bits) - 1)
        key >>= bits
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((minor, major))
        new = np.diff(major[order]).astype(bool) | np.diff(minor[order]).astype(bool)
    return order, np.flatnonzero(np.append(True, new)[: len(order)])


def held_out():
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1, F.lit(False))


class Coded(NamedTuple):
    """Documents as chunks in files. chunks has uri and the file's number, which runs without many gaps up to files."""

    chunks: DataFrame
    files: int
    documents: int

    def dealt(self) -> DataFrame:
        """The files' names, for tasks of TASK_CHUNKS of them."""
        n = max(1, -(-self.files // TASK_CHUNKS))
        return self.chunks.repartitionById(n, (F.col("number") % n).cast("int")).select("uri")


class Chunk(NamedTuple):
    """Whole documents: doc_id and whether it is there, held_out, number of tokens; sorted hashes of words; tokens as places in these."""

    doc_id: np.ndarray
    valid: np.ndarray
    held_out: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    def pack(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        low, high = self.tokens.astype(np.uint16), (self.tokens >> 16).astype(np.uint16)
        parts = self.doc_id, self.valid, self.held_out, self.lengths, np.diff(self.words, prepend=np.uint64(0)), low, high
        return pickle.dumps([press(x.tobytes()) for x in parts])

    @classmethod
    def unpack(cls, data: bytes) -> Chunk:
        grow = zstandard.ZstdDecompressor().decompress
        kinds = np.int64, bool, bool, np.int64, np.uint64, np.uint16, np.uint16
        doc_id, valid, held, lengths, words, low, high = (np.frombuffer(grow(x), k) for x, k in zip(pickle.loads(data), kinds, strict=True))
        return cls(doc_id, valid, held, lengths, np.cumsum(words, dtype=np.uint64), low.astype(np.int64) | high.astype(np.int64) << 16)

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and lengths of the documents in training."""
        use = ~self.held_out
        return self.tokens[np.repeat(use, self.lengths)], self.lengths[use]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, and their number in each; only A-Z change and only ASCII white space parts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    parent = pc.list_parent_indices(lists).to_numpy()[some.to_numpy(zero_copy_only=False)]
    return words.filter(some), np.bincount(parent, minlength=len(texts))


def _chunks(batches, least: int):
    """Chunks of so many tokens or LONG times as many bytes at least, and the last. Columns: doc_id, text (null: empty), held_out."""

    def chunk(parts):
        ids, held, words, n = zip(*parts, strict=True)
        ids, lengths = pa.concat_arrays(ids), np.concatenate(n) + 1
        coded = pa.concat_arrays(words).dictionary_encode()
        hashes, place = np.unique(digests([*coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), END]), return_inverse=True)
        tokens = np.full(int(lengths.sum()), place[-1])
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(lengths) - 1] = False
        tokens[inner] = place[coded.indices.to_numpy()]
        return Chunk(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), pa.concat_arrays(held).to_numpy(zero_copy_only=False), lengths, hashes, tokens)

    parts, total, weight = [], 0, 0
    for b in batches:
        ids, texts, held = b.columns
        # Pieces of so many bytes, which have half as many words at most, or of one text.
        size = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + least, side="right")))
            words, n = _split(texts[a:z])
            parts.append((ids[a:z], held[a:z], words, n))
            total += int(n.sum()) + z - a
            weight += int(size[z - 1]) - (int(size[a - 1]) if a else 0)
            a = z
            if total >= least or weight >= LONG * least:
                yield chunk(parts)
                parts, total, weight = [], 0, 0
    if parts:
        yield chunk(parts)


def encode(docs: DataFrame) -> Coded:
    """Split all texts into words and store what every later pass reads."""
    folder = scratch(docs.sparkSession, "tokens")

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, x in enumerate(_chunks(batches, BUFFER_TOKENS)):
            # A name of its own: only the files that a task names when it ends well are read.
            uri = f"{folder}/{uuid.uuid4().hex}"
            put_bytes(uri, x.pack())
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([task], pa.int64()), pa.array([k], pa.int64()), pa.array([len(x.lengths)], pa.int64())], names=["uri", "task", "k", "documents"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held"))
    made = cut(rows.mapInArrow(run, "uri string, task long, k long, documents long"))
    files, documents, tasks = made.agg(F.count("*"), F.sum("documents"), F.max("task") + 1).first()
    return Coded(made.select("uri", (F.floor(F.col("task") * files / (tasks or 1)) + F.col("k")).alias("number")), files, documents or 0)


def _read(batches):
    for b in batches:
        for uri in b.column(0).to_pylist():
            yield Chunk.unpack(get_bytes(uri))


def _lexicon(docs: Coded, folder: str) -> tuple[Lexicon, list[int]]:
    bits = max(0, (max(1, docs.documents) // SHARD_DOCS).bit_length())

    def count(batches):
        for x in _read(batches):
            tokens, _ = x.training()
            if not len(tokens):
                continue
            c = np.bincount(tokens, minlength=len(x.words))
            h, c = x.words[c > 0], c[c > 0]
            yield _runs((h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64), h, c)

    def merge(batches):
        def build(s, runs):
            h, c = _merged(runs)
            room = 1 << (64 - bits)
            arrays, meta = ef.build(h - (np.uint64(s) << np.uint64(64 - bits) if bits else np.uint64(0)), room, "hash")
            kind = np.uint32 if c.max() < 2**32 else np.uint64
            put_bytes(f"{folder}/words-{s}", ef.pack(arrays | {"count": c.astype(kind)}, **meta))
            top = np.argsort(-c, kind="stable")[:64]
            cols = [pa.array([s], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([c[top].tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "n", "total", "top", "top_n"])

        yield from _by_shard(batches, build)

    runs = docs.dealt().mapInArrow(count, RUN)
    figures = cut(runs.repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard").mapInArrow(merge, "shard int, n long, total long, top array<long>, top_n array<long>")).collect()
    by = {r.shard: r for r in figures}
    sizes = [by[s].n if s in by else 0 for s in range(1 << bits)]
    bases = (np.cumsum(sizes) - sizes).tolist()
    lexicon = Lexicon([f"{folder}/words-{s}" if s in by else "" for s in range(1 << bits)], bases, bits, sum(r.total for r in figures), sum(sizes))
    n_shards = max(1, -(-lexicon.tokens // SHARD_TOKENS))
    return lexicon, sorted(bases[r.shard] + i for r in figures for i, n in zip(r.top, r.top_n, strict=True) if n > lexicon.tokens / (4 * n_shards))


def _level(docs: Coded, model: Model, folder: str, hot: list[int], parents: int) -> list[int]:
    """Count and write the next level of the model; returns the parents that are hot in the one after it."""
    k, types, tokens = len(model.levels) + 2, model.lexicon.types, model.lexicon.tokens
    n_shards = max(1, -(-tokens // SHARD_TOKENS))
    level = Level([""] * n_shards, [0] * n_shards, parents, types, hot, [0.0] * len(hot))
    numbers = level.local + len(hot)
    if numbers * types >= 2**63:
        raise ValueError("a shard's keys exceed 63 bits: raise the number of shards")
    spark = docs.chunks.sparkSession
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((model, level)))

    def count(batches):
        model, level = pickle.loads(sent.value)
        for x in _read(batches):
            tokens, lengths = x.training()
            if not len(tokens):
                continue
            ids = model.lexicon.find(x.words)
            _, label, parents = model.grams(tokens, ids, lengths)
            order, first = grouped(label, tokens, len(parents), len(ids))
            c = np.diff(np.append(first, len(order)))
            parent, word = parents[label[order[first]]], ids[tokens[order[first]]]
            ok = (parent >= 0) & (word >= 0)
            word = word[ok]
            shard, number = level.place(parent[ok], word)
            order = level.order(shard, number)
            key = number.astype(np.uint64) * np.uint64(types) + word.astype(np.uint64)
            yield _runs(shard[order], key[order], c[ok][order])

    def merge(batches):
        def build(s, runs):
            key, c = _merged(runs)
            number, word = (key // np.uint64(types)).astype(np.int64), (key % np.uint64(types)).astype(np.int64)
            put_bytes(f"{folder}/counts-{k}-{s}", pickle.dumps(_packed(key, c)))
            seen = [int((c == x).sum()) for x in (1, 2, 3, 4)]
            # Sums of hot parents are put together by the driver: as many numbers as there are hot parents.
            far = number >= level.local
            kinds = np.stack([c[far], c[far] == 1, c[far] == 2, c[far] > 2], axis=1)
            sums = np.zeros((len(level.hot), 4), np.int64)
            np.add.at(sums, number[far] - level.local, kinds.astype(np.int64))
            top = np.argsort(-c, kind="stable")[:64]
            cols = [pa.array([s], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([seen], pa.list_(pa.int64())), pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([top.tolist()], pa.list_(pa.int64())), pa.array([c[top].tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "n", "seen", "sums", "top", "top_n"])

        yield from _by_shard(batches, build)

    runs = docs.dealt().mapInArrow(count, RUN)
    dealt = runs.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard")
    figures = cut(dealt.mapInArrow(merge, "shard int, n long, seen array<long>, sums array<long>, top array<long>, top_n array<long>")).collect()
    seen = np.array([r.seen for r in figures]).sum(axis=0) if figures else np.zeros(4)
    cuts = discounts(seen)
    sums = np.array([r.sums for r in figures]).sum(axis=0).reshape(-1, 4) if figures and hot else np.zeros((0, 4))
    hot_total = sums[:, 0] if hot else np.zeros(0)
    by = {r.shard: r for r in figures}
    level.spill = np.minimum(1.0, (sums[:, 1:] * cuts).sum(axis=1) / np.maximum(hot_total, 1))
    sizes = [by[s].n if s in by else 0 for s in range(n_shards)]
    level.bases = (np.cumsum(sizes) - sizes).astype(np.int64)
    level.uris = [f"{folder}/level-{k}-{s}" if s in by else "" for s in range(n_shards)]
    level.size = sum(sizes)
    local = level.local

    def finish(batches):
        for b in batches:
            for s in b.column(0).to_pylist():
                key, c = _unpacked(*pickle.loads(get_bytes(f"{folder}/counts-{k}-{s}")))
                number, word = (key // np.uint64(types)).astype(np.int64), (key % np.uint64(types)).astype(np.int64)
                per = np.bincount(number, minlength=numbers)
                total = np.bincount(number, c, minlength=numbers)
                off = cuts[np.minimum(c, 3) - 1]
                rest = np.bincount(number, off, minlength=numbers) / np.maximum(total, 1)
                if len(hot_total):
                    total[local:] = hot_total
                ptr = np.append(0, np.cumsum(per))
                ptr_arrays, ptr_meta = ef.build(ptr, len(c) + 1, "ptr")
                key = ptr[number].astype(np.uint64) * np.uint64(types) + word.astype(np.uint64) * per[number].astype(np.uint64)
                next_arrays, next_meta = ef.build(key, (len(c) + 1) * types, "next")
                put_bytes(f"{folder}/level-{k}-{s}", ef.pack(ptr_arrays | next_arrays | {"code": quantise((c - off) / total[number]), "rest": quantise(rest)}, **ptr_meta, **next_meta))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    if figures:
        todo = spark.createDataFrame([(s,) for s in sorted(by)], "shard int").repartitionById(min(n_shards, 1000), F.col("shard") % min(n_shards, 1000))
        cut(todo.mapInArrow(finish, "shard int"))
        remove(spark, [f"{folder}/counts-{k}-{s}" for s in sorted(by)])
    model.levels.append(level)
    return sorted(int(level.bases[r.shard]) + i for r in figures for i, n in zip(r.top, r.top_n, strict=True) if n > tokens / (4 * n_shards))


def discounts(seen) -> np.ndarray:
    """The three discounts from the numbers of k-grams seen once, twice, three and four times."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    if not n1 or not n2:
        return np.array([0.5, 0.75, 0.9]) if n1 else np.array([0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)])


def train(docs: DataFrame | Coded, order: int = 2) -> Model:
    """The model of all documents outside the held-out fifth."""
    docs = docs if isinstance(docs, Coded) else encode(docs)
    folder = scratch(docs.chunks.sparkSession, "ngrams")
    lexicon, hot = _lexicon(docs, folder)
    model = Model(lexicon)
    for _ in range(order - 1):
        parents = model.levels[-1].size if model.levels else lexicon.types + 1
        hot = _level(docs, model, folder, hot, max(parents, 1))
    return model


def score(docs: DataFrame | Coded, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    docs = docs if isinstance(docs, Coded) else encode(docs)
    sent = docs.chunks.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        model = pickle.loads(sent.value)
        x = model.lexicon
        for d in _read(batches):
            begins = np.cumsum(d.lengths) - d.lengths
            ids = x.find(d.words)
            c = x.counts(ids)
            own = (c + 0.5) / (x.tokens + 0.5 * (x.types + 1))
            base = np.add.reduceat(np.log10(own)[d.tokens], begins)
            p, _, _ = model.grams(d.tokens, ids, d.lengths, own[d.tokens])
            known = np.add.reduceat((c > 0).astype(np.int64)[d.tokens], begins)
            cols = [pa.array(d.doc_id, mask=~d.valid), pa.array(d.held_out), pa.array(d.lengths), pa.array(known), pa.array(np.full(len(known), x.tokens)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), begins))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.dealt().mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
