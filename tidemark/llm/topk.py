"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are whole numbers, floor(scale * x).  The index is written once: a row for each shard of vectors, holding
postings (vector, value) in segments by quantised impact and dimension, in descending impact; level l has
the components with 2^(l-1) <= |value| < 2^l, in the narrowest types that hold them.
A query's weights are quantised alike, so the segments of dimension j at level l have at most the
impact 2^(level of the weight + l).  Segments are processed in descending impact, each adding its
exact products to the accumulators; the dimensions and queries of one impact step go together as
one small matrix product.  What is still to come is bounded for each query by the sums of |weight| *
2^l over unprocessed segments that the shard really has.  A query stops on a shard only on proof: once
no more than `few` vectors can still reach its k-th best lower bound; those possible members are then
scored exactly.  Without a proof all segments are processed and the accumulators are the scores.

Queries, a stated set, go in waves of at most `wave_bytes`, which is what is broadcast at once; each wave streams in
blocks through every shard where it lies, so the index never moves and a shard is opened once a wave.  A shard gives
k rows a query, and ranks merge: first within a task, then over all.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors count as filled up with zeros; ties go to smaller ids, and a query's own id is no candidate of
it; repeated rows are candidates each; queries that share an id are one, that of the least vector that may take
part; fewer than k candidates give all; empty tables give no rows; components beyond +-2^62 after scaling, and scores
beyond a long, are cut off there; a very wide vector makes a shard as much larger: a shard's rows are as many as
`shard_bytes` hold; columns go by position (id, vector), so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written


@dataclass(frozen=True)
class TopK:
    k: int = 20
    scale: int = 64
    shard_rows: int = 8_192
    shard_bytes: int = 16 << 20  # of a shard's components as 8 bytes each
    block_rows: int = 512
    wave_bytes: int = 32 << 20  # of queries that are broadcast at once
    few: int = 64  # possible members for each query at which rescoring starts


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _codes(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whole-number vectors filled up with zeros) of usable rows."""
    rows = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in batch.column(1)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for r, x in enumerate(rows):
        out[r, : len(x)] = np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype(np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), out


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the least signed type that holds it."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(m.shape[1] for _, m in parts)
    return np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in parts])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, most: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, codes) of up to `rows` rows and about `most` bytes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            width = max(len(batch.column(1)[at].values), 1)
            step = max(1, min(rows, most // (8 * width)))
            ids, codes = _codes(batch.slice(at, step), scale)
            if held and (sum(len(i) for i, _ in held) + len(ids) > rows or sum(m.nbytes for _, m in held) + codes.nbytes > most):
                yield _joined(held)
                held = []
            held.append((ids, codes))
            at += step
    if held:
        yield _joined(held)


#: A shard: its ids; for each level, in descending order, its level, how many postings each dimension has, and their rows and values.
_INDEX = "n int, width int, ids binary, levels array<int>, counts array<binary>, rows array<binary>, codes array<binary>, bytes array<int>"


def indexed(vectors: DataFrame, config: TopK) -> DataFrame:
    """The impact-ordered index of (id, vector): a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes in _blocks(batches, config.shard_rows, config.shard_bytes, config.scale):
            level = _levels(codes)
            out: dict[str, list] = {c: [] for c in ("levels", "counts", "rows", "codes", "bytes")}
            for v in range(int(level.max(initial=0)), 0, -1):
                held = (level == v).T  # dimensions first: a segment's postings are neighbours
                if held.any():
                    values = _narrow(codes.T[held])
                    for name, x in zip(out, (v, held.sum(1).astype("<u4").tobytes(), np.nonzero(held)[1].astype("<u4" if len(ids) > 65_535 else "<u2").tobytes(), values.tobytes(), values.itemsize)):
                        out[name].append(x)
            row = {"n": len(ids), "width": codes.shape[1], "ids": ids.tobytes(), **out}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("levels", pa.list_(pa.int32())), *((c, pa.list_(pa.binary())) for c in ("counts", "rows", "codes")), ("bytes", pa.list_(pa.int32()))]))

    return vectors.mapInArrow(run, _INDEX)


def _planes(row: dict) -> dict[int, np.ndarray]:
    """{level: (dimension, vector) -> value}, in descending order, as the segments hold them."""
    out = {}
    for v, counts, rows, codes, size in zip(*(row[c] for c in ("levels", "counts", "rows", "codes", "bytes"))):
        plane = np.zeros((row["width"], row["n"]), np.int64)
        dims = np.repeat(np.arange(row["width"]), np.frombuffer(counts, "<u4"))
        plane[dims, np.frombuffer(rows, "<u4" if row["n"] > 65_535 else "<u2")] = np.frombuffer(codes, f"<i{size}")
        out[v] = plane
    return out


def _levels(x: np.ndarray) -> np.ndarray:
    """0 for 0, else the number of binary digits of |x|."""
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def _long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        scores = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in scores], np.int64)
    return scores.astype(np.int64)


class Shard:
    """A shard's segments, opened once for all blocks of queries."""

    def __init__(self, ids: np.ndarray, planes: dict[int, np.ndarray], width: int):
        self.ids, self.whole, self.width = ids, planes, width
        self.top = float(max((np.abs(p.astype(np.float64)).max(initial=0) for p in planes.values()), default=0))
        self._as: dict = {}

    def planes(self, kind) -> dict[int, np.ndarray]:
        if kind not in self._as:
            self._as[kind] = {v: p.astype(kind) for v, p in self.whole.items()}
        return self._as[kind]

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """Whole vectors (row -> dimensions) of some members."""
        return sum((p[:, at] for p in self.whole.values()), np.zeros((self.width, len(at)), np.int64)).T


def search_shard(queries: np.ndarray, query_ids: np.ndarray, shard: Shard, k: int, few: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of each query's k best in the shard, exactly."""
    n, dims, ids = len(shard.ids), shard.width, shard.ids
    most = float(np.abs(queries.astype(np.float64)).sum(1).max(initial=0)) * shard.top
    kind, exact = (np.float32 if most < 2**24 else np.float64), most < 2**53
    if not exact:
        queries, kind = queries.astype(object), object
    q_level = _levels(queries.astype(np.float64))
    planes = shard.planes(kind)
    tops = list(planes)
    has = {v: (p != 0).any(1) for v, p in planes.items()}  # segments that exist, by dimension
    weights = {u: np.where(q_level == u, queries, 0).astype(kind) for u in range(int(q_level.max(initial=0)), 0, -1)}
    acc = np.zeros((len(queries), n), kind)
    alive = np.arange(len(queries))
    size = np.abs(queries).astype(np.float64)
    steps = sorted({u + v for u in weights for v in tops}, reverse=True)
    own = query_ids[:, None] == ids[None, :] if len(ids) else np.zeros((len(queries), 0), bool)

    def best(q: int, at: np.ndarray, scores: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        mine = ~own[q, at]
        at, scores = at[mine], scores[mine]
        if len(at) > k:
            low = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= low], scores[scores >= low]
        order = np.lexsort((ids[at], -scores))[:k]
        return q, ids[at][order], scores[order]

    for i, step in enumerate(steps):
        for u, w in weights.items():
            if (step - u) in planes and len(alive):
                used = np.flatnonzero(w[alive].any(0) & has[step - u])
                if len(used):
                    acc[alive] += w[np.ix_(alive, used)] @ planes[step - u][used]
        if i + 1 == len(steps) or not len(alive) or n <= k + 1:
            continue
        # For each dimension, the highest impact that an unprocessed segment can add or take.
        rest = np.zeros(len(alive))
        for j_level in range(1, max(weights) + 1):
            for_level = np.zeros(dims)
            for v in tops:
                if v + j_level < step:
                    for_level = np.maximum(for_level, has[v] * (2.0**v - 1))
            rest += np.where(q_level[alive] == j_level, size[alive], 0) @ for_level
        now = acc[alive].astype(np.float64)
        if not len(rest) or 4 * rest.min() > now.max() - now.min():
            continue
        now[own[alive]] = -np.inf
        kth = np.partition(now, n - k, axis=1)[:, n - k]
        may = now + rest[:, None] >= (kth - rest)[:, None]
        done = may.sum(1) <= few
        for r in np.flatnonzero(done):
            q, at = alive[r], np.flatnonzero(may[r])
            whole = shard.vectors(at)
            yield best(q, at, (whole @ queries[q].astype(np.int64)) if exact else np.array([sum(a * b for a, b in zip(x, queries[q])) for x in whole.tolist()], object))
        alive = alive[~done]
    everything = np.arange(n)
    for q in alive:
        yield best(q, everything, acc[q])


def top_k(vectors: DataFrame, queries: DataFrame, config: TopK = TopK()) -> DataFrame:
    """For each query (id, vector) its k best rows of vectors (id, vector): query_id, rank, vec_id, score."""
    spark, k, few = vectors.sparkSession, config.k, config.few
    usable = lambda df: df.select(F.col(f"`{df.columns[0]}`").cast("long").alias("id"), F.col(f"`{df.columns[1]}`").alias("v")).where("id is not null").where(_usable(F.col("v")))
    index = written(indexed(usable(vectors), config), "impact-index")
    asked = written(usable(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    size = asked.agg(F.sum(8 * (F.size("v") + 1)).alias("bytes")).first()["bytes"] or 0
    waves = max(1, -(-size // config.wave_bytes))

    def found(wave: DataFrame) -> DataFrame:
        # About wave_bytes, whatever the number of queries is.
        blocks = spark.sparkContext.broadcast(list(_blocks(iter(wave.toArrow().to_batches()), config.block_rows, config.wave_bytes, config.scale)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    planes, width, ids = _planes(row), row["width"], np.frombuffer(row["ids"], np.int64)
                    for qids, q in blocks.value:
                        if q.shape[1] > width:
                            planes, width = {v: np.pad(p, ((0, q.shape[1] - width), (0, 0))) for v, p in planes.items()}, q.shape[1]
                    shard = Shard(ids, planes, width)
                    for qids, q in blocks.value:
                        best = list(search_shard(np.pad(q, ((0, 0), (0, width - q.shape[1]))), qids, shard, k, few))
                        lengths = [len(f[1]) for f in best]
                        if sum(lengths):
                            arrays = np.repeat(qids[[f[0] for f in best]], lengths), np.concatenate([f[1] for f in best]).astype(np.int64), np.concatenate([_long(f[2]) for f in best])
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["query_id", "vec_id", "score"])

        return index.mapInArrow(run, "query_id long, vec_id long, score long")

    if waves == 1:
        parts = found(asked)
    else:
        # A wave is written before the next one is broadcast.
        which = F.pmod(F.xxhash64("id"), F.lit(waves))
        done = [written(found(asked.where(which == n)), "top-k") for n in range(waves)]
        parts = done[0]
        for other in done[1:]:
            parts = parts.unionByName(other)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
