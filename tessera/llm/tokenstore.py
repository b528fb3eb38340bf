"""Operator 2, token-ID output: word-aligned Simple-8b files.

A 64-bit word holds a 4-bit selector and 60 bits of payload. The selector says how many ids of how many bits share the
payload; at each place the selector that packs most ids is taken, as in the published Simple-8b scheme. An id of over
60 bits is escaped: selector 15 alone, then the id as a raw word. Ids are coded in blocks of BLOCK; the header keeps
each block's word offset, so any block decodes by itself, and a block decodes with a few array operations: words are
grouped by selector, their payloads shifted and masked together, and ids put in place by the running sum of counts.

A file holds a run of documents in ascending doc_id order; files follow one another in that order:

    magic 8 bytes | n_docs, n_ids, n_blocks: 3 x int64 | doc_ids: n_docs x int64 | doc null flags: n_docs x uint8, padded
    to 8 | doc ends: n_docs x int64 | block word offsets: (n_blocks + 1) x int64 | words: uint64 each, little-endian

Edge cases: a null text counts as empty, so it holds the end id alone; a null doc_id sorts first; repeated doc_ids keep
a row each; an empty table makes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, get_bytes, put_bytes, scratch

MAGIC = b"S8BTOK01"
BLOCK = 1024
#: Fixed values of the format: ids in a word, bits of each id; the selector is the place in this list.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: File numbers whose files are summed together; a task that writes files has 2**24 numbers of its own.
FILES_OF_RUN = 1 << 32


def encode(ids: np.ndarray, blocks: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the word offset of each block and of the end; so many blocks at a time."""
    step = blocks * BLOCK
    parts = [_encode(ids[i : i + step]) for i in range(0, max(len(ids), 1), step)]
    base = np.cumsum([0, *(len(w) for w, _ in parts)])
    return np.concatenate([w for w, _ in parts]), np.concatenate([*(o[:-1] + k for (_, o), k in zip(parts, base, strict=False)), base[-1:]]).astype(np.int64)


def _encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # A row for each block, with room for a full word behind its end: what stands there fits anything.
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[:n] = ids
    most = int(ids.max())
    padded = padded.reshape(n_blocks, BLOCK).astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
    selector = np.full((n_blocks, BLOCK), ESCAPE, np.uint8)
    wide = np.zeros((n_blocks, BLOCK + PACKS[0][0]), np.int16)
    for s, (count, bits) in reversed(list(enumerate(PACKS))):  # from few to many, so the largest that fits stays
        if most >> bits == 0:
            selector[:] = s
            continue
        np.cumsum(padded >= padded.dtype.type(1 << bits), axis=1, out=wide[:, 1 : BLOCK + 1])
        wide[:, BLOCK + 1 :] = wide[:, BLOCK : BLOCK + 1]
        selector[wide[:, count : count + BLOCK] == wide[:, :BLOCK]] = s
    selector = selector.ravel()
    counts = np.array([c for c, _ in PACKS] + [0, 1])
    # All blocks step together: each step chooses one word in every block that isn't done.
    place = np.arange(n_blocks) * BLOCK
    ends = np.minimum(place + BLOCK, n)
    chosen = np.zeros(n, bool)
    while len(place):
        chosen[place] = True
        place = place + counts[selector[place]]
        going = place < ends
        if not going.all():
            place, ends = place[going], ends[going]
    starts = np.flatnonzero(chosen)
    sel = selector[starts].astype(np.int64)
    cnt = np.diff(np.append(starts, n))
    escaped = sel == ESCAPE
    where = np.cumsum(1 + escaped) - 1 - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    for s, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        word = np.full(len(mine), s, np.uint64)
        for j in range(count):
            has = cnt[mine] > j
            value = np.where(has, ids[np.minimum(starts[mine] + j, n - 1)], np.uint64(0))
            word |= value << np.uint64(4 + j * bits)
        words[where[mine]] = word
    words[where[escaped]] = ESCAPE
    words[where[escaped] + 1] = ids[starts[escaped]]
    first = np.searchsorted(starts, np.arange(n_blocks) * BLOCK)
    return words, np.append(where[first], len(words)).astype(np.int64)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, blocks: range | None = None) -> np.ndarray:
    """The ids of the blocks, of all by default."""
    blocks = range(len(offsets) - 1) if blocks is None else blocks
    if not len(blocks):
        return np.zeros(0, np.uint64)
    total = min(n, blocks[-1] * BLOCK + BLOCK) - blocks[0] * BLOCK
    words = np.asarray(words[offsets[blocks[0]] : offsets[blocks[-1] + 1]])
    sel = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    maybe = np.flatnonzero(sel == ESCAPE)
    if len(maybe):  # a raw word may look like an escape; walk the few candidates
        last = -2
        for i in maybe:
            if i != last + 1:
                last = i
                if i + 1 < len(words):
                    raw[i + 1] = True
    counts = np.array([c for c, _ in PACKS] + [0, 1])[sel]
    counts[raw] = 0
    # The last word of a block holds what is left of it.
    edge = offsets[list(blocks)] - offsets[blocks[0]]
    sizes = np.minimum(BLOCK, n - np.array(list(blocks)) * BLOCK)
    begin = np.cumsum(counts) - counts
    over = np.add.reduceat(counts, edge) - sizes
    tail = np.append(edge[1:], len(words)) - 1
    tail = np.where(raw[tail], tail - 1, tail)
    counts[tail] -= over
    begin = np.cumsum(counts) - counts
    out = np.zeros(total, np.uint64)
    for s, (count, bits) in enumerate(PACKS):
        mine = np.flatnonzero((sel == s) & ~raw)
        if len(mine):
            mask = np.uint64((1 << bits) - 1)
            whole = mine[counts[mine] == count]
            out[begin[whole][:, None] + np.arange(count)] = words[whole][:, None] >> (4 + bits * np.arange(count)).astype(np.uint64) & mask
            for i in mine[counts[mine] < count]:
                out[begin[i] : begin[i] + counts[i]] = words[i] >> (4 + bits * np.arange(counts[i])).astype(np.uint64) & mask
    esc = np.flatnonzero((sel == ESCAPE) & ~raw)
    out[begin[esc]] = words[esc + 1]
    return out


def to_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = encode(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    pad = b"\0" * (-len(null) % 8)
    head = np.array([len(doc_ids), len(ids), len(offsets) - 1], "<i8")
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), keys.tobytes(), null.tobytes(), pad, np.cumsum(lengths).astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes()])


def from_file(data) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ends of the documents in ids, ids."""
    buf = memoryview(data)
    if bytes(buf[:8]) != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks = np.frombuffer(buf, "<i8", 3, 8)
    at = 32
    keys = np.frombuffer(buf, "<i8", n_docs, at)
    at += 8 * n_docs
    null = np.frombuffer(buf, np.uint8, n_docs, at)
    at += n_docs + (-n_docs % 8)
    ends = np.frombuffer(buf, "<i8", n_docs, at)
    at += 8 * n_docs
    offsets = np.frombuffer(buf, "<i8", n_blocks + 1, at)
    words = np.frombuffer(buf, "<u8", offsets[-1] if n_blocks else 0, at + 8 * (n_blocks + 1))
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], ends, decode(words, offsets, int(n_ids))


#: Letters below this are Latin with marks; how byte-level vocabularies spell bytes that are not printable.
LATIN_END = "\u0250"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def parts_at_blanks(path: str) -> bool:
    """Whether a vocabulary works as Pieces relies on: lower case, words of letters, white space dropped, byte spelling."""
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    normal = [n.get("type") for n in (j.get("normalizer") or {}).get("normalizers", [])]
    split = (j.get("pre_tokenizer") or {}).get("pretokenizers", [])
    words = len(split) == 2 and split[0].get("type") == "Split" and split[0].get("behavior") == "Removed" and split[0].get("invert") is True and split[0].get("pattern", {}).get("Regex") == WORDS
    plain = words and split[1].get("type") == "ByteLevel" and not split[1].get("add_prefix_space") and not split[1].get("use_regex")
    return bool(plain) and normal == ["NFC", "Replace", "Lowercase"] and not any(" " in t["content"] for t in j.get("added_tokens", []))


#: Fixed value: the pattern of words that Pieces relies on.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and digits; marks. A mark behind a letter or digit begins a word. OTHERS: more than words, blanks and single
#: full stops or commas.
_WORDS, _MARKS = r"0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"!-/:-@\[-`{-~"
OTHERS, BEGINS = re.compile(rf"[^{_WORDS} \n.,]|[.,][.,]"), re.compile(f"(?<=[{_WORDS}])[{_MARKS}]")
#: What is not Latin, and the one Latin letter that is two when it is lowered.
FOREIGN = re.compile("[\u0130\u0250-\U0010ffff]")


def parted(text: str | None) -> list[str]:
    """Pieces of a text, each of which is encoded alone: what stands between blanks, at least.

    Texts of Latin letters in composed form can be lowered as a whole, and a mark behind a letter or digit begins a
    word in any case; so what is left are mostly words of letters, each in one spelling, and runs of marks.
    """
    t = text or ""
    if (t.isascii() or (not FOREIGN.search(t) and unicodedata.is_normalized("NFC", t))) and "<|" not in t:
        t = t.lower()
        t = BEGINS.sub(r" \g<0>", t) if OTHERS.search(t) else t.replace(".", " .").replace(",", " ,")
    return t.replace("\n", " ").split(" ")


class Pieces(dict):
    """Ids of pieces, as bytes, remembered for a while.

    New words of letters go to the library's model many at a time, joined by blanks; each ends with a token that is
    spelt as the end of a word. What has been asked for since the last change of generations stays for one more.
    """

    MOST = 500_000

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.before = tokenizer, {}
        self.words = Tokenizer(tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[k for t, k in vocab.items() if t.endswith(tokenizer.model.end_of_word_suffix)]] = True

    def learn(self, pieces: set[str]) -> None:
        before, whole, spelt, plain = self.before, [], [], []
        for p in pieces:
            if p in before:
                self[p] = before[p]
            elif not p.isalpha():
                whole.append(p)
            elif p.isascii():
                plain.append(p)
                spelt.append(p.lower())
            elif max(p) < LATIN_END and unicodedata.is_normalized("NFC", p) and p.lower().isalpha():
                plain.append(p)
                spelt.append(p.lower().encode().decode("latin-1").translate(AS_BYTES))
            else:
                whole.append(p)
        if plain:
            out = self.words.encode_batch_fast([" ".join(spelt[i : i + 1000]) for i in range(0, len(spelt), 1000)], add_special_tokens=False)
            ids = np.array([i for e in out for i in e.ids], np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(plain):
                raise ValueError("a word's tokens do not end as the vocabulary says")
            raw = ids.tobytes()
            self.update(zip(plain, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        if whole:
            found = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)
            self.update(zip(whole, [array("I", e.ids).tobytes() for e in found], strict=True))

    def turn(self) -> None:
        """Forget what has not been asked for of late, if there is too much."""
        if len(self) > self.MOST:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Token ids as little-endian uint32 bytes.

    A vocabulary that drops white space and never merges across it has a text's ids from those of its pieces in order;
    any other gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise NotImplementedError("token files are written on little-endian machines only")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(self.tokenizer) if parts_at_blanks(path) else None

    #: The worker process's own encoders, which outlive a task.
    held: dict = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        import tessera.llm.tokenstore as here  # the module's own class: the one that tasks bring along is a new one each time

        held = here.Encoder.held
        if path not in held:
            held[path] = here.Encoder(path)
        return held[path]

    def __call__(self, texts: list[str | None], end_id: int) -> list[bytes]:
        end = array("I", [end_id]).tobytes()
        if self.pieces is None:
            return [array("I", self.tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() + end for t in texts]
        self.pieces.turn()
        parts = [parted(t) for t in texts]
        self.pieces.learn(set().union(*parts).difference(self.pieces))
        find = self.pieces.__getitem__
        return [b"".join(map(find, ps)) + end for ps in parts]


def write_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, file_ids: int = 1_000_000, part_docs: int = 4096) -> DataFrame:
    """Encode whole texts and write them to files in folder, in ascending doc_id order; returns file, n_ids for each.

    A file closes once it holds file_ids ids. Documents go to tasks by ranges of (doc_id, hash), part_docs each on
    average; the hash parts rows that repeat one id.
    """
    rows = docs.select("doc_id", "text")
    n_parts = max(1, min(100_000, -(-rows.select("doc_id").count() // part_docs)))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n_parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")

    def write(batches):
        encoder = Encoder.of(vocabulary)
        keys, chunks, held, file = [], [], 0, None

        def flush():
            lengths = np.array([len(c) // 4 for c in chunks], np.int64)
            ids = np.frombuffer(b"".join(chunks), "<u4")
            put_bytes(f"{folder}/part-{file:016d}.s8b", to_file(keys, lengths, ids))
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([len(ids)], pa.int64())], names=["file", "n_ids"])

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                piece = b.slice(lo, 512)
                file = piece.column("part")[0].as_py() << 24 if file is None else file
                for d, x in zip(piece.column("doc_id").to_pylist(), encoder(piece.column("text").to_pylist(), end_id), strict=True):
                    keys.append(d)
                    chunks.append(x)
                    held += len(x) // 4
                    if held >= file_ids:
                        yield flush()
                        keys, chunks, held, file = [], [], 0, file + 1
        if keys:
            yield flush()

    return dealt.mapInArrow(write, "file long, n_ids long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. files: what write_files returned, stored."""
    # Sums of the files before, in two steps, so that no task holds a row for every file.
    files = files.withColumn("run", F.expr(f"file div {FILES_OF_RUN}"))
    runs = files.groupBy("run").agg(F.sum("n_ids").alias("n"))
    runs = cut(runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("first")))
    inner = F.sum("n_ids").over(Window.partitionBy("run").orderBy("file")) - F.col("n_ids")
    starts = files.withColumn("inner", inner).join(runs, "run").select("file", (F.col("first") + F.col("inner")).alias("base"))

    def read(batches):
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                keys, ends, ids = from_file(get_bytes(f"{folder}/part-{file:016d}.s8b"))
                raw = ids.astype("<u4").tobytes()
                begins = np.append(0, ends[:-1])
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begins + base), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # As many tasks as files, up to a bound: rows this small would else be put together in one.
    spread = starts.repartition(max(1, min(10_000, files.count())), F.col("file"))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_files(cut(write_files(docs, vocabulary, folder, end_id)), folder)
