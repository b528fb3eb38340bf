"""Operator 5, chat formatting of reply trees.

Turns are nodes that name their parent. Root-to-leaf paths are found by iterative self-joins with doubling: after round
i each node knows its 2**i-th ancestor and the sum of scores below it, and the next round adds what that ancestor knows,
so a path of n turns takes log2(n) joins of rows of fixed size. Branches are ranked by their scores, summed along the
path (ties: the smaller leaf first). Only the best `branches` leaves of each tree are then laid out turn by turn, by the
same jumps from the leaf up, and each is formatted as one conversation.

The template marks turns with control strings. Within roles and texts every control string and every escape character
gets the escape character in front, so formatted text can be read back exactly: an escape character makes the next
piece plain text, and only unescaped control strings are marks. The loss mask is a list of ranges of code points: the
texts of assistant turns, as they stand, without their marks.

Edge cases: null texts and roles count as empty; a null score counts as 0; a node whose parent is missing is a root;
turns in a circle have no root and no path; rows that repeat a turn are turns of their own, ordered by turn, role and
text; an empty table gives only what the query adds; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard

#: The marks of this template, and the control strings of other templates that are escaped as well.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (OPEN, SEP, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
_PLAIN = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_PIECE = re.compile("|".join(f"{re.escape(ESCAPE)}(?:{re.escape(c)})" for c in (ESCAPE, *CONTROLS)) + "|" + "|".join(map(re.escape, (OPEN, SEP, CLOSE))))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: ESCAPE + m[0], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask's ranges."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + SEP, escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def unescape(text: str) -> str:
    return _PIECE.sub(lambda m: m[0].removeprefix(ESCAPE), text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, begin, role = [], 0, ""
    for m in _PIECE.finditer(formatted):
        if m[0].startswith(ESCAPE):
            continue
        if m[0] == SEP:
            role = unescape(formatted[begin : m.start()])
        elif m[0] == CLOSE:
            turns.append((role, unescape(formatted[begin : m.start()])))
        begin = m.end()
    return turns


def climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Ends: tables of node, tree, total (the scores from the root), for every node of nodes (node, parent, tree, score)
    that has a root. Levels: table i has node and top, its 2**i-th ancestor, where there is one."""
    known = nodes.select(F.col("node").alias("parent"), F.col("node").alias("top"))
    # total sums the scores from the node to just below top; a row has the same few numbers however deep its node lies.
    up = cut(nodes.join(known, "parent", "left").select("node", "tree", "top", F.col("score").alias("total")))
    limit, ends, levels, open_ = up.count(), [up.where("top is null")], [up], up.where("top is not null")
    while 2 ** (len(levels) - 1) <= limit and open_.limit(1).count():  # turns in a circle never end
        reached = reduce(DataFrame.unionByName, ends, open_).select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("total").alias("more"))
        grown = cut(open_.join(reached, "top").select("node", "tree", F.col("next").alias("top"), (F.col("total") + F.col("more")).alias("total")))
        # Paths that have reached their root are set aside and join no more, but others may still lead into them.
        ends.append(grown.where("top is null"))
        levels.append(grown)
        open_ = grown.where("top is not null")
    return ends, levels


def chosen(nodes: DataFrame, branches: int) -> DataFrame:
    """tree, leaf, branch, node and place (0 at the leaf, less above) along the best branches of nodes (node, parent, tree, score)."""
    ends, levels = climb(nodes)
    parents = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = reduce(DataFrame.unionByName, ends).join(parents, "node", "left_anti")
    best = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))).where(F.col("branch") <= branches)
    parts = [cut(best.select("tree", F.col("node").alias("leaf"), "branch", "node", F.lit(0).cast("long").alias("place")))]
    # What is known of a path up to place 2**i gives the places up to 2**(i + 1), each once: only chosen paths are laid out.
    for i, level in enumerate(levels):
        jump = level.where("top is not null").select("node", "top")
        further = reduce(DataFrame.unionByName, parts).join(jump, "node")
        parts = [*parts, cut(further.select("tree", "leaf", "branch", F.col("top").alias("node"), (F.col("place") - 2**i).alias("place")))]
    for level in levels:
        discard(level)
    return reduce(DataFrame.unionByName, parts)


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, branch (rank from 1) and turns (array of role, text) of each tree's best branches.

    nodes: node long, parent long, tree, score, role, text; node ids are unique. A path counts for its leaf's tree.
    """
    steps = chosen(nodes.select("node", "parent", "tree", F.coalesce("score", F.lit(0)).cast("double").alias("score")), branches)
    said = nodes.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("place", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return steps.join(said, "node").groupBy("tree", "leaf", "branch").agg(turns.alias("turns")).drop("leaf")


def formatted(chats: DataFrame) -> DataFrame:
    """tree, branch, formatted text and mask (array of start, end) of conversations."""

    def run(batches):
        for b in batches:
            out = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in b.column("turns")]
            text = pa.array([o[0] for o in out], pa.string())
            mask = pa.array([[{"start": s, "end": e} for s, e in o[1]] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("branch"), text, mask], names=["tree", "branch", "formatted", "mask"])

    return chats.select("tree", "branch", "turns").mapInArrow(run, "tree long, branch int, formatted string, mask array<struct<start:long,end:long>>")


def digests(texts: DataFrame) -> DataFrame:
    """What can be read back of formatted conversations: turns, loss and lengths."""

    def run(batches):
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            rows = []
            for tree, text, mask in zip(b.column("tree").to_pylist(), b.column("formatted").to_pylist(), b.column("mask").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return texts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def linear(turns: DataFrame) -> DataFrame:
    """Nodes of conversations without branches (conv_id, turn, role, text): each turn answers the one before it."""
    by_turn = Window.partitionBy("tree").orderBy("turn", "role", "text", "node")
    rows = turns.select(F.col("conv_id").alias("tree"), "turn", "role", "text", F.monotonically_increasing_id().alias("node"))
    rows = cut(rows)
    return rows.withColumn("parent", F.lag("node").over(by_turn)).withColumn("score", F.lit(0.0))
