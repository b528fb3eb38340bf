"""Operator 8, toxicity: a linear-chain conditional random field over tokens.

Fitting, on a bounded sample of labelled training rows (at most SAMPLE_ROWS of them, the smallest by a hash of doc_id, of
SAMPLE_BYTES together, and SAMPLE_LINES of their lines; all parameters):

1. Token labels come from document labels. A word is a toxic word if it stands in toxic documents after more different
   words than chance allows (the number of word types times the share of toxic rows to the power of that count is far
   below one), and hardly ever in clean ones. Different neighbours are counted, not occurrences, so that copies of one
   document prove nothing.
2. A two-state chain (clean, toxic) is fitted to the labelled lines by gradient ascent on its conditional likelihood.
   Features of a token are the word, its first four and its last three letters; features that the sample does not
   show often enough have no weight, so unknown words look clean.
3. A document's evidence is the log-odds that any of its tokens is toxic (noisy-or of the forward-backward marginals);
   a logistic curve from evidence to label is fitted on the same sample and gives the score.

Scoring reads whole texts in one pass without a shuffle. Lines are the chains. With two states the forward and the
backward message are one ratio each, so all lines of a batch advance together, one token at a time.

Edge cases: null and blank texts hold no tokens and get the score of no evidence; without labelled rows of both kinds
the model knows no toxic word and scores the share of toxic rows (0 without rows); repeated rows each get a row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Labelled rows that fit the model, and the most lines among them that fit the chain.
SAMPLE_ROWS, SAMPLE_LINES = 8_000, 8_000
#: Bytes of the sampled texts: they are what the driver collects.
SAMPLE_BYTES = 64_000_000
#: Rows that the driver scores at once for the curve, and words that it remembers meanwhile: neither changes a score.
FIT_ROWS, FIT_WORDS = 32, 50_000
#: Values of a token's features: the word itself, its first letters, its last letters.
SCALE = np.array([1.0, 0.5, 0.5])
#: ASCII bytes that are not letters or digits part tokens, but lines stay apart; other bytes belong to UTF-8 letters.
BLANK = bytes(c if c >= 128 or c == 10 or chr(c).isalnum() else 32 for c in range(256))
TOKEN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def lines_of(text: str | None) -> list[list[bytes]]:
    lines = (text or "").lower().encode("utf-8", "surrogatepass").translate(BLANK).split(b"\n")
    return [w for line in lines if (w := line.split())]


def features(word: bytes) -> tuple:
    s = word.decode("utf-8", "surrogatepass")
    return ("w", s), ("p", s[:4]), ("s", s[-3:])


def chain(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic state at every token; emit: log-odds of the tokens alone, lines one after another."""
    _, fore, back = messages(emit, lengths, trans)
    return np.log(np.maximum(fore, 1e-30)) + np.log(np.maximum(back, 1e-30))


def messages(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' own odds, and the forward and backward messages as odds of toxic to clean."""
    t = np.exp(trans)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    left = lengths[order]
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    g = np.exp(np.clip(emit, -60, 60))
    fore, back = np.empty_like(g), np.empty_like(g)
    for i, n in enumerate(active):
        at = starts[:n] + i
        if i:
            r = fore[at - 1]
            fore[at] = g[at] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
        else:
            fore[at] = g[at]
    for i, n in enumerate(active):  # i tokens from the end
        at = starts[:n] + left[:n] - 1 - i
        if i:
            r = back[at + 1] * g[at + 1]
            back[at] = (t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r)
        else:
            back[at] = 1.0
    return g, fore, back


class Model:
    """Weights of features and transitions, the curve from evidence to score."""

    #: Words whose weights are remembered while scoring.
    most = 1_000_000

    def __init__(self):
        self.weights: dict[tuple, float] = {}
        self.bias = -12.0
        self.trans = np.zeros((2, 2))
        self.curve = (0.0, -30.0)
        self.words: dict[bytes, float] = {}

    def emission(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        try:
            return np.array([known[w] for w in words], float)
        except KeyError:
            if len(known) > self.most:
                known.clear()
            weights = self.weights
            for w in set(words):
                if w not in known:
                    known[w] = self.bias + sum(weights.get(f, 0.0) * v for f, v in zip(features(w), SCALE, strict=True))
            return np.array([known[w] for w in words], float)

    def odds(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's token log-odds."""
        lines = [lines_of(t) for t in texts]
        flat = [w for d in lines for line in d for w in line]
        lengths = np.array([len(line) for d in lines for line in d], np.int64)
        out = chain(self.emission(flat), lengths, self.trans)
        ends = np.cumsum([sum(map(len, d)) for d in lines])
        return np.split(out, ends[:-1]) if len(texts) else []

    def evidence(self, odds: np.ndarray) -> float:
        """Log-odds that any token is toxic."""
        none = -np.logaddexp(0, odds).sum() if len(odds) else 0.0
        some = -np.expm1(none)
        return float(np.clip(math.log(max(some, 1e-13)) - none, -30, 30))

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-min(max(a * evidence + b, -40), 40)))


def toxic_words(docs: list[tuple[str | None, int]]) -> set[bytes]:
    toxic = list(dict.fromkeys(t for t, y in docs if y))
    clean = list(dict.fromkeys(t for t, y in docs if not y))
    if not toxic or not clean:
        return set()
    often: Counter = Counter()
    for t in toxic:
        often.update({w for line in lines_of(t) for w in line})
    share = len(toxic) / len(docs)
    least = max(4, math.ceil((math.log(len(often)) + 2) / -math.log(min(share, 0.5))))
    before: dict[bytes, set] = {w: set() for w, n in often.items() if n >= least}
    for t in toxic:
        for line in lines_of(t):
            for a, b in zip([b"", *line], line, strict=False):
                if b in before:
                    before[b].add(a)
    count = {w: len(s) for w, s in before.items() if len(s) >= least}
    seen: Counter = Counter()
    for t in clean:
        seen.update({w for line in lines_of(t) for w in line if w in count})
    return {w for w, n in count.items() if (seen[w] + 0.5) / len(clean) < 0.05 * n / len(toxic)}


class Thin:
    """Lines, thinned by a hash of their words so that all count alike, to twice a number at most; each is held as one value."""

    def __init__(self, most: int):
        self.most, self.below, self.held = most, 1 << 32, []

    def add(self, line: list[bytes]) -> None:
        joined = b" ".join(line)
        h = zlib.crc32(joined)
        if h < self.below:
            self.held.append((h, joined))
            while len(self.held) > 2 * self.most and self.below:
                self.below >>= 1
                self.held = [x for x in self.held if x[0] < self.below]

    def take(self, n: int) -> list[bytes]:
        """n lines of the smallest hashes, in order of their arrival, their words joined by blanks."""
        least = sorted(h for h, _ in self.held)[:n]
        return [line for h, line in self.held if least and h <= least[-1]]


def pair_sums(t: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Expected pairs of states over all places, from the odds on either side; one kind of pair is laid out at a time."""
    kinds = [lambda: np.full(len(before), t[0, 0]), lambda: t[0, 1] * after, lambda: t[1, 0] * before, lambda: t[1, 1] * before * after]
    total = kinds[0]()
    for kind in kinds[1:]:
        total += kind()
    return np.array([(kind() / total).sum() for kind in kinds]).reshape(2, 2)


def fit(docs: list[tuple[str | None, int]], lines: int = SAMPLE_LINES, rounds: int = 100, step: float = 1.0, l2: float = 1e-4) -> Model:
    """docs: texts and labels, in a fixed order."""
    model, bad = Model(), toxic_words(docs)
    share = sum(y for _, y in docs) / len(docs) if docs else 0.0
    model.curve = (0.0, math.log(share / (1 - share)) if 0 < share < 1 else 30.0 * (1 if share else -1))
    if not bad:
        return model
    hot, cold = Thin(lines), Thin(lines)
    for t, _ in docs:
        for line in lines_of(t):
            (hot if any(w in bad for w in line) else cold).add(line)
    hot = hot.take(lines // 2)
    lines = hot + cold.take(max(1, lines - len(hot)))
    lengths = np.array([line.count(b" ") + 1 for line in lines], np.int64)
    kinds: dict[bytes, int] = {}
    type_of = np.fromiter((kinds.setdefault(w, len(kinds)) for line in lines for w in line.split(b" ")), np.int32, lengths.sum())
    del hot, cold, lines
    gold = np.array([w in bad for w in kinds], float)[type_of]
    seen: Counter = Counter()
    for w, n in zip(kinds, np.bincount(type_of).tolist(), strict=True):
        for f in features(w):
            seen[f] += n
    index = {f: k for k, f in enumerate(f for f, n in seen.items() if n >= 5)}
    del seen
    table = np.array([[index.get(f, len(index)) for f in features(w)] for w in kinds])
    many = len(kinds)
    del kinds
    weights, bias, trans = np.zeros(len(index) + 1), -4.0, np.zeros((2, 2))
    speed, speed_bias, speed_trans = np.full(len(weights), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    ends = np.cumsum(lengths)
    n = len(type_of)
    inner = np.ones(n, bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    gold_pairs = np.array([[((1 - gold[at]) * (1 - gold[at + 1])).sum(), ((1 - gold[at]) * gold[at + 1]).sum()], [(gold[at] * (1 - gold[at + 1])).sum(), (gold[at] * gold[at + 1]).sum()]])
    for _ in range(rounds):
        per_type = bias + (weights[table] * SCALE).sum(axis=1)
        emit = per_type[type_of]
        g, fore, back = messages(emit, lengths, trans)
        del emit
        odds = fore * back
        wrong = gold - odds / (1 + odds)
        del odds
        by_type = np.bincount(type_of, wrong, minlength=many)
        slope = np.bincount(table.ravel(), (by_type[:, None] * SCALE).ravel(), minlength=len(weights)) - l2 * n * 1e-2 * weights
        slope[-1] = 0
        back *= g
        slope_trans = gold_pairs - pair_sums(np.exp(trans), fore[at], back[at + 1])
        speed += slope**2
        speed_bias += wrong.sum() ** 2
        speed_trans += slope_trans**2
        weights += step * slope / np.sqrt(speed)
        bias += step * wrong.sum() / math.sqrt(speed_bias)
        trans += 0.1 * step * slope_trans / np.sqrt(speed_trans)
    model.weights = {f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 1e-3}
    model.bias, model.trans = float(bias), trans
    model.most = FIT_WORDS
    x = np.array([model.evidence(o) for lo in range(0, len(docs), FIT_ROWS) for o in model.odds([t for t, _ in docs[lo : lo + FIT_ROWS]])])
    model.curve = _logistic(x, np.array([y for _, y in docs], float))
    model.words, model.most = {}, Model.most
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the curve 1 / (1 + exp(-(a*x + b))), by Newton's steps with a light pull to a = 0.5, b = 0."""
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p)
        grad = np.array([((y - p) * x).sum() - (a - 0.5), (y - p).sum() - 0.01 * b])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        da, db = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(a + da, 0.02), b + db
    return float(a), float(b)


def in_training(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, lines: int = SAMPLE_LINES, size: int = SAMPLE_BYTES) -> Model:
    """The model of a sample of the labelled rows outside the held-out fifth; a repeated doc_id counts with its least text."""
    asked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training())
    asked = asked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    asked = cut(asked.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(rows))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(asked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = cut(found.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))))
    sizes = found.select("doc_id", "bytes").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").collect()
    ends = np.cumsum([r.bytes for r in sizes]) if sizes else np.zeros(0)
    taken = [r.doc_id for r, end in zip(sizes, ends, strict=True) if end <= size]
    least = docs.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long")
    sample = sorted(((r[0], r[1], int(r[2])) for r in found.join(F.broadcast(least), "doc_id").select("doc_id", "text", "y").toLocalIterator()), key=lambda r: r[0])
    return fit([(t, y) for _, t, y in sample], lines)


def _sent(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start, end, probability of offending tokens, in code points)."""
    sent = _sent(docs, model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        model = pickle.loads(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                piece = b.slice(lo, 512)
                texts = piece.column("text").to_pylist()
                scores, spans = [], []
                for t, odds in zip(texts, model.odds(texts), strict=True):
                    scores.append(model.score(model.evidence(odds)))
                    hits = np.flatnonzero(odds > 0)
                    places = [m.span() for m in TOKEN.finditer(t)] if len(hits) else []
                    spans.append([{"start": places[k][0], "end": places[k][1], "p": 1 / (1 + math.exp(-min(odds[k], 40)))} for k in hits])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, span)], names=["doc_id", "score", "spans"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; every column kept."""
    sent = _sent(docs, model)

    def run(batches):
        model = pickle.loads(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                piece = b.slice(lo, 512)
                ok = [model.score(model.evidence(o)) < 0.5 for o in model.odds(piece.column("text").to_pylist())]
                yield piece.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
