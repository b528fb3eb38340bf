"""Operator 9, exact top-k search: distributed histogram selection.

The queries are packed into blocks of vectors, one file each in the shared folder. A task takes the candidates that it
reads in chunks of CHUNK bytes and meets each query block in turn, slice by slice of BLOCK candidates: one matrix product
in exact integers. Round by round, score histograms locate each query's k-th best value: a round splits the range that
holds it into BINS bins and counts the scores in them, over all candidates. A chunk reports only the bins down to its own
k-th best score (the global k-th best is no lower, so lower bins cannot matter): at most k bins for a query. The counts
are summed, the bin that holds the k-th best becomes the next range, until it is one integer wide. A last pass keeps the
scores at or above that value; of equal scores a chunk keeps its k smallest ids, which is all that the tie rule can ask of
it. The stated set of queries meets all rows.

No vector is collected, broadcast or copied for another block's sake: the driver gets counts only, and a shuffle carries
the queries once and a round's bins. A task holds one chunk, one query block and one slice's scores, whatever the tables' size.

Edge cases: a vector that is null or holds null or non-finite components, or whose length differs from `dim`, takes no
part, nor does one with a component so large that a score might not fit 62 bits (for 64 components scaled by 256, beyond a
million); repeated vec_ids are ranked as separate candidates (a query's own id is excluded however often it occurs, and a
repeated query id is answered once, for the least of its vectors, component by component); fewer than k candidates give all of them; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, get_bytes, put_bytes, scratch

#: Vectors in a query block and in a slice of candidates, bins of a round's histogram, and bytes of the candidates in a chunk.
BLOCK, BINS, CHUNK = 2048, 4096, 1 << 26


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors as rows of a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _written(rows: DataFrame, n_blocks: int, path: str, dim: int) -> None:
    """A file for each block, empty blocks too: the ids in order, then each other column in that order."""
    empty = rows.sparkSession.range(n_blocks).select(F.col("id").alias("q_block"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[1:]))

    def write(key, group):
        group = group.filter(group["query_id"].is_valid()).sort_by("query_id")
        group = group.drop_columns("q_block").combine_chunks()
        parts = [_matrix(c.combine_chunks(), dim) if pa.types.is_list(c.type) else c.to_numpy() for c in group.columns]
        put_bytes(f"{path}/{key[0].as_py()}", b"".join(x.tobytes() for x in parts))
        return pa.table({"n": [group.num_rows]})

    done = rows.unionByName(empty).groupBy("q_block").applyInArrow(write, "n long").agg(F.count(F.lit(1))).first()[0]
    if done != n_blocks:
        raise RuntimeError(f"{done} of {n_blocks} blocks were written")


def _block(queries: str, state: str | None, b: int, dim: int, lo0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids and vectors, each query's start of the range and count above it; without queries that had no candidate."""
    data = np.frombuffer(get_bytes(f"{queries}/{b}"), "<i8")
    n = len(data) // (dim + 1)
    ids, q = data[:n], data[n:].view("<f8").reshape(n, dim)
    if state is None:
        return ids, q, np.full(n, lo0, np.int64), np.zeros(n, np.int64)
    known, lo, above = np.frombuffer(get_bytes(f"{state}/{b}"), "<i8").reshape(3, -1)
    return known, q[np.searchsorted(ids, known)], lo, above


def _chunks(batches, dim: int):
    """The candidates in chunks of at most CHUNK bytes and a batch more, each a list of slices (ids, vectors)."""
    slices, held = [], 0
    for b in batches:
        ids, m = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dim)
        slices += [(ids[a : a + BLOCK], m[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
        held += m.nbytes
        if held >= CHUNK:
            yield slices
            slices, held = [], 0
    if slices:
        yield slices


def _scores(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floats as long as these hold every partial sum; a query's own rows get the least value."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    s = q.astype(kind) @ c.astype(kind).T
    order = np.argsort(ci, kind="stable")
    first, last = (np.searchsorted(ci[order], qi, side) for side in ("left", "right"))
    r = np.repeat(np.arange(len(qi)), last - first)
    j = np.arange(len(r)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + np.repeat(first, last - first)
    s[r, order[j]] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    return s


def _reached(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the scores that reach their row's bound."""
    most = {np.dtype(np.float32): 2**24, np.dtype(np.float64): 2**53}.get(s.dtype)  # all scores lie between, and integers are exact
    least = (bounds if most is None else np.clip(bounds, -most, most)).astype(s.dtype)
    r, j = np.divmod(np.flatnonzero(s >= least[:, None]), max(s.shape[1], 1))
    return r, j, s[r, j].astype(np.int64)


def _histogram(qi, q, lo, slices, k: int, step: int, width: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, bin and count, of the bins from the top down to the one of the slices' k-th best score."""
    key, n, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), lo.copy()
    for ci, c in slices:
        s = _scores(qi, q, ci, c)
        if first and not len(key) and s.shape[1] >= k:  # else the first slice would count all its scores
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            full = kth > (np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf)
            floor[full] = lo[full] + (kth[full].astype(np.int64) - lo[full]) // step * step
        r, _, v = _reached(s, floor)
        r, v = r[v < lo[r] + width], v[v < lo[r] + width]
        key, at = np.unique(np.concatenate([key, r * BINS + (v - lo[r]) // step]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, np.ones(len(r), np.int64)]), len(key)).astype(np.int64)
        key, n = key[::-1], n[::-1]  # from each query's highest bin down
        before, new = np.cumsum(n) - n, np.diff(key // BINS, prepend=-1) != 0
        before = before - before[new][np.cumsum(new) - 1]
        last = (before < k) & (before + n >= k)
        floor[key[last] // BINS] = lo[key[last] // BINS] + key[last] % BINS * step
        key, n = key[before < k][::-1], n[before < k][::-1]
    return key // BINS, key % BINS, n


def _best(qi, q, lo, slices, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, id and score, of the slices' k best scores from lo on, of equal ones those of the smallest ids."""
    row, ids, v = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for ci, c in slices:
        s = _scores(qi, q, ci, c)
        r, j, new = _reached(s, lo)
        row, ids, v = np.concatenate([row, r]), np.concatenate([ids, ci[j]]), np.concatenate([v, new])
        order = np.lexsort((ids, -v, row))
        row, ids, v = row[order], ids[order], v[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, ids, v = row[few], ids[few], v[few]
    return row, ids, v


def histogram_topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, dim: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    x = F.col("embedding")
    kept = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    fit = x.isNotNull() & F.col("vec_id").isNotNull() & (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    most = math.isqrt((1 << 62) // max(dim, 1)) - 1
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("v"))
    rows = cut(rows.where(F.forall("v", lambda v: F.abs(v) <= most)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))))).first()[0] or 0.0
    n_blocks = math.ceil(asked.count() / BLOCK)
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_blocks:
        return spark.createDataFrame([], schema)
    queries, state = scratch(spark, "topk"), None
    _written(asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("long").alias("q_block"), F.col("vec_id").alias("query_id"), "v"), n_blocks, queries, dim)
    bound = int(most) ** 2 * dim + 1
    lo0, width = -bound, 2 * bound + 1
    while width > 1:
        step = max(1, -(-width // BINS))

        def counted(batches, state=state, step=step, width=width):
            for slices in _chunks(batches, dim):
                for block in range(n_blocks):
                    ids, q, lo, above = _block(queries, state, block, dim, lo0)
                    r, at, n = _histogram(ids, q, lo, slices, k, step, width, state is None)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(r), block, np.int64), ids[r], lo[r], above[r], at, n)], names=["q_block", "query_id", "lo", "above", "bin", "n"])

        bins = rows.mapInArrow(counted, "q_block long, query_id long, lo long, above long, bin long, n long")
        bins = bins.groupBy("q_block", "query_id", "lo", "above", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q_block", "query_id").orderBy(F.desc("bin"))
        bins = bins.withColumn("upto", F.col("above") + F.sum("n").over(down))
        # The first bin from above that brings the count to k; a query with fewer candidates takes its lowest.
        hit = F.struct(F.when(F.col("upto") >= k, F.lit(0)).otherwise(F.lit(1)), F.when(F.col("upto") >= k, -F.col("bin")).otherwise(F.col("bin")))
        found = bins.groupBy("q_block", "query_id", "lo").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), hit).alias("m"))
        state, width = scratch(spark, "topk"), step
        _written(found.select("q_block", "query_id", (F.col("lo") + F.col("m.bin") * step).alias("lo"), F.col("m.above").alias("above")), n_blocks, state, dim)

    def kept_rows(batches):
        for slices in _chunks(batches, dim):
            for block in range(n_blocks):
                ids, q, lo, _ = _block(queries, state, block, dim, lo0)
                r, found, v = _best(ids, q, lo, slices, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found), pa.array(v)], names=["query_id", "vec_id", "score"])

    best = rows.mapInArrow(kept_rows, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
