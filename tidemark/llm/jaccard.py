"""Exact n-gram Jaccard join in metric space.

Documents are sets of k-word shingles under the Jaccard distance; two link at distance at most
radius = 1 - similarity.

1. Equal sets collapse to their least document.
2. Anchors.  Two linked sets share a member of the first floor((1 - s) * n) + 1 of either, under any one
   order of all shingles; here rare ones first, then by hash.  Sets with no anchor in common are
   farther apart than the radius, so only the documents of one anchor need to meet.  The list of
   shingles taken as frequent is bounded and only affects speed.
3. Regions.  Each anchor's documents gather round a pivot, the one with the least hash; anchors
   with one pivot merge, which folds a family of copies into one region.  Few documents go as pairs,
   each to the region of one member's pivot.
4. Each region is joined exactly and recursively: distances to several pivots give Voronoi cells;
   by the triangle inequality a document within `radius` of a cell's member is at most 2 * radius
   farther from that pivot than from its own, so boundary documents within this window are
   replicated; documents that are linked already, or that no unlinked document can reach, drop out.
   A region that would not fit a task is split in the same way by a distributed pass.  Where cells overlap
   almost wholly, the smaller classes are compared with all, by the rare members of their sets, and a
   region too large for a task goes in blocks.
5. Links join components by distributed union-find.

Defined results: a document with fewer than k words has its whole sequence as one shingle; null or
wordless texts have an empty set and link with nothing; a document is an id and a text, named by a
64-bit hash of both: rows that repeat them are one document, and others are documents of their own,
whatever their ids; null ids count as the least id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, dropped, free_name, written
from .words import U, distinct, mix, shingle_sets, slices, words

_LEAST = -(1 << 63)


@dataclass(frozen=True)
class Jaccard:
    k: int = 5
    percent: int = 80  # least similarity
    frequent: int = 65_536  # shingles taken as frequent, at most: 512 KB
    often: int = 32  # documents that hold one, at least
    pairwise: int = 16  # documents of an anchor that go as pairs
    leaf: int = 24  # documents of a region that are compared directly
    region_bytes: int = 48 << 20  # of shingles in a region that one task joins
    chunk_bytes: int = 8 << 20
    small: int = 1_000_000  # ids that may be broadcast
    salts: int = 16  # parts of a class of equal sets


def _links(n: int, m: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _sets(piece: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for part in slices(iter([piece]), "text"):
        yield from zip(part.column("doc").to_pylist(), shingle_sets(words(part.column("text"), True), k))


def _buckets(n: int) -> int:
    """Counts in a sketch: enough that unrelated sets of n shingles lie beyond the radius."""
    return 64 << max(0, (max(n, 1) - 1) // 800).bit_length()


def sketch(s: np.ndarray) -> bytes:
    """A set folded to counts by hash. The sum of the counts' differences is at most that of the sets' own."""
    m = _buckets(len(s))
    return np.minimum(np.bincount((s >> U(65 - m.bit_length())).astype(np.int64), minlength=m), 65_535).astype("<u2").tobytes()


def _fold(counts: np.ndarray, m: int) -> np.ndarray:
    """Counts folded on to m of them; a row or rows."""
    return counts.astype(np.int32).reshape(*counts.shape[:-1], m, -1).sum(-1)


def _near(apart: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes may link: the folded distance bounds the true one from below."""
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def _features(body: DataFrame, config: Jaccard) -> DataFrame:
    """(kind, doc, id, n, f1, f2, sketch): kind 0, a document's set size, fingerprint and folded counts; kind 1, a repeated shingle f1 and its count n in some chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", config.chunk_bytes):
            doc, n, f1, f2, folded, seen, all_ = [], [], [], [], [], set(), []
            for d, s in _sets(piece, config.k):
                m = mix(s)
                a, b = int(np.bitwise_xor.reduce(s)) if len(s) else 0, int(m.sum()) if len(s) else 0
                doc.append(d), n.append(len(s)), f1.append(a), f2.append(b), folded.append(sketch(s))
                if (a, b) not in seen:
                    seen.add((a, b))
                    all_.append(s)
            h, c = np.unique(np.concatenate(all_), return_counts=True) if all_ else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            h, c = h[c > 1], c[c > 1]
            columns = [[0] * len(doc) + [1] * len(h), doc + [0] * len(h), n + c.tolist(), np.concatenate([np.array(f1, np.uint64), h]).view(np.int64), np.concatenate([np.array(f2, np.uint64), h]).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(piece.column("id").to_pylist() + [None] * len(h), pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3]), pa.array(columns[4]), pa.array(folded + [None] * len(h), pa.binary())], names=["kind", "doc", "id", "n", "f1", "f2", "sketch"])

    return written(body.mapInArrow(run, "kind int, doc long, id long, n long, f1 long, f2 long, sketch binary"), "shingle-sets")


def _anchored(body: DataFrame, frequent: tuple[np.ndarray, np.ndarray], config: Jaccard) -> DataFrame:
    """Packed anchors (h, doc, n) by bucket; equal sets of a chunk go once."""
    hot = body.sparkSession.sparkContext.broadcast(frequent)
    buckets = 4 * int(body.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = hot.value
        for piece in slices(batches, "text", config.chunk_bytes):
            hs, docs, sizes, seen = [], [], [], set()
            for d, s in _sets(piece, config.k):
                n = len(s)
                mark = (n, int(np.bitwise_xor.reduce(s)), int(s.sum())) if n else None
                if not n or mark in seen:
                    continue
                seen.add(mark)
                if len(often):
                    at = np.searchsorted(often, s)
                    at[at == len(often)] = 0
                    is_hot = often[at] == s
                    if is_hot.any():
                        late = s[is_hot]
                        s = np.concatenate((s[~is_hot], late[np.lexsort((late, count[at[is_hot]]))]))
                s = s[: n - (-(-config.percent * n // 100)) + 1]
                hs.append(s), docs.append(np.full(len(s), d, np.int64)), sizes.append(np.full(len(s), n, np.int32))
            if not hs:
                continue
            h, doc, n = np.concatenate(hs), np.concatenate(docs), np.concatenate(sizes)
            bucket = ((h >> U(17)) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            values, first = np.unique(bucket[order], return_index=True)
            cut = [*first.tolist(), len(order)]
            h, doc, n = h[order], doc[order], n[order]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), *(pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in (h, doc, n))], names=["bucket", "h", "doc", "n"])

    return body.mapInArrow(run, "bucket int, h binary, doc binary, n binary")


def _met(anchored: DataFrame, config: Jaccard) -> DataFrame:
    """(kind, a, b): kind 0, a pair of documents that share an anchor; kind 1, pivot a and a document b of a larger anchor."""

    def run(table: pa.Table) -> pa.Table:
        cols = {c: np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("h", np.uint64), ("doc", np.int64), ("n", np.int32))}
        order = np.argsort(cols["h"], kind="stable")
        h, doc, n = (cols[c][order] for c in ("h", "doc", "n"))
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(head, len(h)))
        of = np.repeat(size, size)
        a, b = [], []
        for step in range(1, config.pairwise):
            i = np.flatnonzero((h[:-step] == h[step:]) & (of[:-step] <= config.pairwise)) if len(h) > step else np.zeros(0, np.int64)
            j = i + step
            x, y, lo, hi = doc[i], doc[j], np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
            fit = (100 * lo >= config.percent * hi) & (x != y)
            a.append(np.minimum(x, y)[fit]), b.append(np.maximum(x, y)[fit])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        keep = of > config.pairwise
        d, group = doc[keep], np.repeat(np.arange(len(size)), size)[keep]
        rank = np.lexsort((d, mix(d.view(np.uint64)), group))
        lead = np.concatenate(([True], group[rank][1:] != group[rank][:-1])) if len(rank) else np.zeros(0, bool)
        pivot = d[rank][np.flatnonzero(lead)][np.cumsum(lead) - 1] if len(rank) else d
        large = np.unique(np.stack([pivot, d[rank]]), axis=1)
        kind = np.concatenate([np.zeros(pairs.shape[1], np.int32), np.ones(large.shape[1], np.int32)])
        return pa.table({"kind": kind, "a": np.concatenate([pairs[0], large[0]]), "b": np.concatenate([pairs[1], large[1]])})

    return written(anchored.groupBy("bucket").applyInArrow(run, "kind int, a long, b long"), "anchors")


def _pairs_in_reach(pairs: DataFrame, sketches: DataFrame, config: Jaccard) -> DataFrame:
    """The pairs (a, b) whose sketches don't prove them apart. sketches: (doc, n, sketch)."""
    a, b = (sketches.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                m = min(len(x), len(y))
                apart.append(int(np.abs(_fold(x, m) - _fold(y, m)).sum()))
            near = _near(np.array(apart, np.int64), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), config.percent)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, _EDGES), "pairs")


def _large_in_reach(large: DataFrame, sketches: DataFrame, config: Jaccard, most: int = 4096) -> DataFrame:
    """Parts regions (region, doc) of at most `most` documents where sketches prove that no link leads across.

    A part is named by its document of least hash, so a family that meets at many anchors gets one region. Larger
    regions stay whole.
    """
    sizes = large.groupBy("region").agg(F.count("*").alias("many"))
    marked = large.join(sizes, "region")

    def run(table: pa.Table) -> pa.Table:
        n, doc = table.column("n").to_numpy(), table.column("doc").to_numpy()
        order = np.argsort(n, kind="stable")
        n, doc, held = n[order], doc[order], table.column("sketch").to_pylist()
        x = [np.frombuffer(held[i], "<u2") for i in order.tolist()]
        # Longer sets have longer sketches; those from a place on are folded to one length for each length there is.
        length = np.array([len(y) for y in x])
        levels = {int(m): (int(np.searchsorted(length, m)), np.stack([_fold(y, int(m)) for y in x[int(np.searchsorted(length, m)) :]])) for m in distinct(length)}
        part = np.arange(len(n))
        upto = np.searchsorted(config.percent * n, 100 * n, "right")
        for i in range(len(n) - 1):
            first, folded = levels[int(length[i])]
            apart = np.abs(folded[i + 1 - first : upto[i] - first] - folded[i - first]).sum(1)
            near = np.flatnonzero(_near(apart, n[i], n[i + 1 : upto[i]], config.percent)) + i + 1
            other = distinct(part[near][part[near] != part[i]])
            if len(other):
                part[np.isin(part, other)] = part[i]
        rank = np.lexsort((doc, mix(doc.view(np.uint64)), part))
        lead = np.flatnonzero(np.concatenate(([True], part[rank][1:] != part[rank][:-1])))
        size = np.diff(np.append(lead, len(rank)))
        name, size = np.repeat(doc[rank][lead], size), np.repeat(size, size)
        return pa.table({"region": name[size > 1], "doc": doc[rank][size > 1]})

    some = marked.where(F.col("many") <= most).select("region", "doc").join(sketches, "doc").groupBy("region").applyInArrow(run, "region long, doc long")
    return some.unionByName(marked.where(F.col("many") > most).select("region", "doc"))


def _regions(met: DataFrame, classes: DataFrame | None, sketches: DataFrame | None = None, config: Jaccard = Jaccard()) -> DataFrame:
    """(region, doc), distinct: every pair that may link has a region with both. classes: (doc, rep) of equal sets, to be replaced."""
    if classes is not None:
        of = classes.select("doc", "rep")
        met = met.join(of.select(F.col("doc").alias("a"), F.col("rep").alias("ra")), "a", "left").join(of.select(F.col("doc").alias("b"), F.col("rep").alias("rb")), "b", "left")
        met = met.select("kind", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    pairs = met.where("kind = 0 and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    large = met.where("kind = 1").select(F.col("a").alias("region"), F.col("b").alias("doc")).distinct()
    if sketches is None:
        # Without sketches, the groups of one family merge where they overlap, so that each member goes once.
        large = components(large.select(F.col("region").alias("a"), F.col("doc").alias("b"))).select(F.col("root").alias("region"), F.col("node").alias("doc"))
    else:
        pairs, large = _pairs_in_reach(pairs, sketches, config), _large_in_reach(large, sketches, config)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("p"))).alias("m"))
    own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("p"))
    pivots = near.select(F.col("a").alias("doc"), F.least(F.col("m"), own)["p"].alias("p"))
    homed = pairs.join(pivots.select(F.col("doc").alias("a"), F.col("p").alias("pa")), "a").join(pivots.select(F.col("doc").alias("b"), F.col("p").alias("pb")), "b")
    meet = F.least("pa", "pb")
    small = homed.select(F.explode(F.array(F.struct(meet.alias("region"), F.col("a").alias("doc")), F.struct(meet.alias("region"), F.col("b").alias("doc")))).alias("x")).select("x.*")
    return small.unionByName(large).distinct()


class _Joiner:
    """Links within one region: recursion over Voronoi cells, with a local union-find."""

    def __init__(self, docs: list[int], sets: list[np.ndarray], config: Jaccard):
        self.docs, self.sets, self.config = docs, sets, config
        self.n = np.array([len(s) for s in sets], np.int64)
        self.up = list(range(len(docs)))
        self.links: list[tuple[int, int]] = []
        self.radius = 1 - config.percent / 100

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((self.docs[x], self.docs[y]))

    def direct(self, rows: np.ndarray) -> None:
        """Compares all pairs of rows that are of fitting size and not yet joined."""
        if len(rows) == 2:
            x, y = rows.tolist()
            if self.root(x) != self.root(y) and _links(int(self.n[x]), int(self.n[y]), _shared(self.sets[x], self.sets[y]), self.config.percent):
                self.link(x, y)
            return
        rows = rows[np.argsort(self.n[rows], kind="stable")]
        size = self.n[rows]
        for i, x in enumerate(rows.tolist()):
            for y in rows[i + 1 : int(np.searchsorted(self.config.percent * size, 100 * self.n[x], "right"))].tolist():
                if self.root(x) != self.root(y) and _links(self.n[x], self.n[y], _shared(self.sets[x], self.sets[y]), self.config.percent):
                    self.link(x, y)

    def sparse(self, rows: np.ndarray, among: np.ndarray) -> None:
        """Links each of rows, all of them in `among`, with those of `among` that are of another class.

        Sets that link share a member among the first n - overlap + 1 of either, taken in order of how few of `among` hold
        them; a member that no other one holds can't be it, so a set far from all others meets nothing.
        """
        percent, n = self.config.percent, self.n[among]
        first = np.cumsum(n) - n
        _, member, count = np.unique(np.concatenate([self.sets[x] for x in among.tolist()]), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.uint32)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.uint32)
        packed = np.repeat(np.arange(len(among), dtype=np.uint64) << U(32), n)
        packed |= rank[member]
        del member
        packed.sort()
        member = packed.astype(np.uint32)
        del packed
        size = n - (-(-percent * n // 100)) + 1
        own = np.repeat(np.arange(len(among)), size)
        place = np.arange(len(own)) - (np.cumsum(size) - size)[own]
        m = member[first[own] + place]
        held = m >= np.count_nonzero(count == 1)
        m, own, place = m[held], own[held], place[held]
        by = np.argsort(m, kind="stable")
        lo, hi = np.searchsorted(m[by], m, "left"), np.searchsorted(m[by], m, "right")
        begin = np.searchsorted(own, np.arange(len(among) + 1))
        label = np.array([self.root(x) for x in among.tolist()])
        where = np.argsort(among)
        mark = np.zeros(len(count), bool)
        for x in where[np.searchsorted(among[where], rows)].tolist():
            a, b = begin[x], begin[x + 1]
            many = hi[a:b] - lo[a:b]
            near = by[np.repeat(lo[a:b] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            y = own[near]
            overlap = -(-percent * (n[x] + n[y]) // (100 + percent))
            y = y[(np.repeat(place[a:b], many) <= n[x] - overlap) & (place[near] <= n[y] - overlap) & (label[y] != label[x])]
            y = distinct(y)
            mark[member[first[x] : first[x] + n[x]]] = True
            while len(y):  # some at a time, in bounded memory
                z, y = np.split(y, [max(1, int(np.searchsorted(np.cumsum(n[y]), 1 << 20)))])
                z = z[label[z] != label[x]]
                if not len(z):
                    continue
                at = np.cumsum(n[z]) - n[z]
                both = np.add.reduceat(mark[member[np.repeat(first[z] - at, n[z]) + np.arange(int(n[z].sum()))]].astype(np.int64), at)
                for k in z[100 * both >= percent * (n[x] + n[z] - both)].tolist():
                    if label[k] != label[x]:
                        self.link(int(among[x]), int(among[k]))
                        label[label == label[k]] = label[x]
            mark[member[first[x] : first[x] + n[x]]] = False

    def join(self, rows: np.ndarray, depth: int = 0) -> None:
        if len({self.root(x) for x in rows.tolist()}) < 2:
            return
        if len(rows) <= self.config.leaf:
            return self.direct(rows)
        flat = np.concatenate([self.sets[x] for x in rows.tolist()])
        first = np.concatenate(([0], np.cumsum(self.n[rows])))[:-1]
        order = np.argsort(mix(rows.astype(np.uint64) + U(depth * 1_000_003)), kind="stable")
        unmet = [p for p in order.tolist()]
        pivots, near = [], []
        for p in unmet[: min(16, int(len(rows) ** 0.5) + 1)]:
            s = self.sets[rows[p]]
            at = np.searchsorted(s, flat)
            at[at == len(s)] = 0
            both = np.add.reduceat((s[at] == flat).astype(np.int64), first)
            either = self.n[rows] + len(s) - both
            for y in np.flatnonzero(100 * both >= self.config.percent * either).tolist():
                self.link(int(rows[p]), int(rows[y]))
            pivots.append(p)
            near.append(1 - both / either)
        del flat
        rest = np.setdiff1d(np.arange(len(rows)), pivots)  # all links of the pivots are found
        d = np.stack(near)[:, rest]
        home = d.argmin(0)
        slack = 1e-9
        cells = [np.flatnonzero(d[i] <= d[home, np.arange(len(rest))] + 2 * self.radius + slack) for i in range(len(pivots))]
        cells = [c[home[c] == i] if not (home[c] == i).any() else c for i, c in enumerate(cells)]
        parts = [self.needed(rows[rest[c]], d[i][c]) for i, c in enumerate(cells) if (home[c] == i).any()]
        if sum(map(len, parts)) > 1.5 * len(rows) or max(map(len, parts), default=0) > 0.8 * len(rows):
            # The cells overlap almost wholly: the rest is compared by its rare members, the smaller classes with all.
            left = self.needed(rows[rest], None)
            roots = np.array([self.root(x) for x in left.tolist()])
            if len(left):
                values, count = np.unique(roots, return_counts=True)
                self.sparse(left[roots != values[count.argmax()]], left)
            return
        for part in parts:
            self.join(part, depth + 1)

    def needed(self, rows: np.ndarray, distance: np.ndarray | None) -> np.ndarray:
        """Without the documents that only have fellows of their own class within reach."""
        roots = np.array([self.root(x) for x in rows.tolist()])
        values, count = np.unique(roots, return_counts=True)
        if len(values) < 2:
            return rows[:0]
        if distance is None:
            return rows
        other = roots != values[count.argmax()]
        low, high = distance[other].min() - self.radius - 1e-9, distance[other].max() + self.radius + 1e-9
        return rows[other | ((distance >= low) & (distance <= high))]


_EDGES = "a long, b long"


def _stored(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _join_regions(placed: DataFrame, config: Jaccard, decode: Callable[[bytes], np.ndarray], buckets: int) -> DataFrame:
    """Links (a, b) within regions. placed: (region, doc, shingles). A task takes a bucket of regions, one after the other."""

    def run(table: pa.Table) -> pa.Table:
        region = table.column("region").to_numpy()
        order = np.argsort(region, kind="stable")
        cut = [*np.flatnonzero(np.concatenate(([True], region[order][1:] != region[order][:-1]))).tolist(), len(order)]
        docs, raw, links = table.column("doc").to_pylist(), table.column("shingles").to_pylist(), []
        for i, j in zip(cut, cut[1:]):
            rows = order[i:j].tolist()
            joiner = _Joiner([docs[r] for r in rows], [decode(raw[r]) for r in rows], config)
            joiner.join(np.arange(len(rows)))
            links += joiner.links
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return placed.withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(run, _EDGES)


def _split(rows: DataFrame, sets: DataFrame, config: Jaccard, level: int, decode: Callable[[bytes], np.ndarray]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One distributed Voronoi pass over regions too large for a task: links to pivots, the regions that remain, and blocks that need no further pass.

    rows: (region, doc). Each region gets 8 pivots, so what a row meets is bounded. Where the cells overlap almost wholly
    another pass would only multiply the rows, so such a region is dealt to blocks that fit a task: its smaller classes
    meet all of it, block by block.
    """
    seeds = [F.min(F.struct(F.xxhash64("doc", F.lit(1000 * level + i)).alias("h"), F.col("doc").alias("p"))).alias(f"m{i}") for i in range(8)]
    chosen = rows.groupBy("region").agg(*seeds).select("region", F.explode(F.array_distinct(F.array(*(F.col(f"m{i}.p") for i in range(8))))).alias("doc"))
    packs = chosen.join(sets, "doc").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("doc", "shingles"))).alias("pivots"))
    radius = 1 - config.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("region", "cell", "doc", "to", "class_", "distance")}
            known: dict[int, list] = {}
            for r in batch.to_pylist():
                if r["region"] not in known:
                    known = {r["region"]: [(p["doc"], decode(p["shingles"])) for p in r["pivots"]]}
                s, pivots = decode(r["shingles"]), known[r["region"]]
                both = [_shared(s, p) for _, p in pivots]
                d = [1 - b / (len(s) + len(p) - b) for b, (_, p) in zip(both, pivots)]
                linked = [i for i, (b, (_, p)) in enumerate(zip(both, pivots)) if _links(len(s), len(p), b, config.percent)]
                home = min(range(len(d)), key=d.__getitem__)
                for i, (p, _) in enumerate(pivots):
                    if p != r["doc"] and (i in linked or d[i] <= d[home] + 2 * radius + 1e-9):
                        inside = r["doc"] not in [q for q, _ in pivots] and d[i] <= d[home] + 2 * radius + 1e-9
                        for name, v in zip(out, (r["region"], i if inside else None, r["doc"], p if i in linked else None, pivots[linked[0]][0] if linked else r["doc"], d[i])):
                            out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["region"], pa.int64()), pa.array(out["cell"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("doc", "to", "class_")), pa.array(out["distance"], pa.float64())], names=list(out))

    met = rows.join(sets, "doc").join(packs, "region").select("region", "doc", "shingles", "pivots")
    met = written(met.mapInArrow(run, "region long, cell int, doc long, to long, class_ long, distance double"), "cells")
    links = met.where("to is not null").select(F.col("to").alias("a"), F.col("doc").alias("b"))
    cells = met.where("cell is not null").withColumn("whole", F.col("region")).withColumn("region", F.xxhash64("region", "cell", F.lit(level)))
    # Cells with one class are settled; of the largest class only those in reach of another one stay.
    by = cells.groupBy("region", "class_").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    top = by.groupBy("region").agg(F.max(F.struct("n", "class_")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    reach = by.join(top, "region").where("class_ <> top.class_").groupBy("region", F.col("top.class_").alias("main")).agg((F.min("low") - radius - 1e-9).alias("low"), (F.max("high") + radius + 1e-9).alias("high"))
    left = written(cells.join(reach, "region").where("class_ <> main or (distance >= low and distance <= high)").select("whole", "region", "doc"), "left")
    before = rows.groupBy("region").agg(F.count("*").alias("rows")).withColumnRenamed("region", "whole")
    after = left.groupBy("whole", "region").agg(F.count("*").alias("n")).groupBy("whole").agg(F.sum("n").alias("sum"), F.max("n").alias("max"))
    stuck = after.join(before, "whole").where("sum > 1.5 * rows or max > 0.8 * rows").select("whole")
    # What has no cell is a pivot, whose links are all found.
    held = met.where("cell is not null").withColumnRenamed("region", "whole").join(stuck, "whole", "left_semi").select("whole", "doc", "class_").distinct().join(sets.select("doc", (8 * F.col("n")).alias("bytes")).dropDuplicates(["doc"]), "doc")
    weight = held.groupBy("whole", "class_").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    share = F.lit(config.region_bytes // 2)
    blocks = weight.groupBy("whole").agg(F.max(F.struct("n", "class_"))["class_"].alias("main"), F.max(F.struct("n", "class_", "bytes"))["bytes"].alias("most"), F.sum("bytes").alias("all"))
    blocks = blocks.select("whole", "main", F.ceil(F.col("all") / share).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("most")) / share).cast("int").alias("high")).where("high > 0")
    dealt = held.join(blocks, "whole").withColumns({"i": F.pmod(F.xxhash64("doc", F.lit(level)), F.col("high")), "j": F.pmod(F.xxhash64("doc", F.lit(-1 - level)), F.col("wide"))})
    few = dealt.where("class_ <> main").select("whole", "doc", "i", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
    all_ = dealt.select("whole", "doc", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), "j")
    settled = few.unionByName(all_).select(F.xxhash64("whole", F.col("i").cast("long"), F.col("j").cast("long"), F.lit(level)).alias("region"), "doc").distinct()
    return links, left.join(stuck, "whole", "left_anti").select("region", "doc"), settled


def linked(regions: DataFrame, sets: DataFrame, config: Jaccard, decode: Callable[[bytes], np.ndarray] = _stored) -> DataFrame:
    """Links (a, b) that join all linked documents of each region. regions: (region, doc); sets: (doc, n, shingles)."""
    links, bulk, blocks = None, 0, None
    for level in range(6):
        sizes = regions.join(sets.select("doc", "n"), "doc").groupBy("region").agg((8 * F.sum("n")).alias("bytes"))
        large = sizes.where(F.col("bytes") > config.region_bytes).select("region")
        bulk, most = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
        if most <= config.region_bytes:
            break
        found, left, settled = _split(regions.join(large, "region", "left_semi"), sets, config, level, decode)
        links = found if links is None else links.unionByName(found)
        settled = written(settled, "blocks")
        blocks = settled if blocks is None else blocks.unionByName(settled)
        regions = written(regions.join(large, "region", "left_anti").unionByName(left).distinct(), "regions")
    if blocks is not None:
        regions = regions.unionByName(blocks)
        bulk = blocks.join(sets.select("doc", "n"), "doc").agg(F.coalesce(8 * F.sum("n"), F.lit(0))).first()[0] + bulk
    buckets = max(4 * int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(4 * bulk // config.region_bytes))
    joined = _join_regions(regions.join(sets.select("doc", "shingles"), "doc").select("region", "doc", "shingles"), config, decode, buckets)
    return joined if links is None else links.unionByName(joined)


def _node(key: str, text: str) -> Column:
    """Names the document of an id and a text."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def _grouped(docs: DataFrame, config: Jaccard, key: str, text: str) -> DataFrame:
    """(doc, id, n, first): each row's node and id, with those of its component's least document, as a struct (id, doc)."""
    body = docs.select(_node(key, text).alias("doc"), F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = _features(body, config)
    documents = rows.where("kind = 0")
    hot = rows.where("kind = 1").groupBy(F.col("f1").alias("h")).agg(F.sum("n").alias("c")).where(F.col("c") >= config.often).orderBy(F.desc("c"), "h").limit(config.frequent).collect()
    h = np.array([r["h"] for r in hot], np.int64).view(np.uint64)
    order = np.argsort(h)
    frequent = h[order], np.array([r["c"] for r in hot], np.int64)[order]
    copies = documents.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "doc")).alias("least"), F.count("*").alias("c")).where("c > 1")
    # A class may hold a third of all documents: its members are dealt by a salt, and its least one goes to each.
    reps = copies.select("n", "f1", "f2", "least", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))).alias("salt"))
    salted = documents.withColumn("salt", F.pmod("doc", F.lit(config.salts)).cast("int"))
    least = F.coalesce("least", F.struct("id", "doc"))
    classes = written(salted.join(reps, ["n", "f1", "f2", "salt"], "left").select("doc", "id", "n", least["doc"].alias("rep"), least["id"].alias("rep_id")), "classes")

    met = _met(_anchored(body, frequent, config), config)
    sketches = documents.select("doc", "n", "sketch").dropDuplicates(["doc"])
    regions = written(_regions(met, classes.where("doc <> rep").select("doc", "rep").distinct(), sketches, config), "regions")
    dropped(met), dropped(rows)
    wanted = regions.select("doc").distinct()
    if wanted.count() <= config.small:
        wanted = F.broadcast(wanted)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", config.chunk_bytes):
            found = list(_sets(piece, config.k))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], names=["doc", "n", "shingles"])

    # A repeated row gives its set again, which links to itself at most.
    sets = written(body.join(wanted, "doc", "left_semi").mapInArrow(shingles, "doc long, n long, shingles binary"), "sets")
    roots = components(linked(regions, sets, config))
    # A class's least document stands for it, so a component's is the least of these.
    members = roots.join(classes.where("doc = rep").select(F.col("doc").alias("node"), F.col("rep_id").alias("id")).distinct(), "node")
    firsts = members.groupBy("root").agg(F.min(F.struct("id", F.col("node").alias("doc"))).alias("first"))
    named = roots.join(firsts, "root").select(F.col("node").alias("rep"), "first")
    own = F.struct(F.col("rep_id").alias("id"), F.col("rep").alias("doc"))
    return classes.join(named, "rep", "left").select("doc", "id", "n", F.coalesce("first", own).alias("first"))


def near_duplicates(docs: DataFrame, config: Jaccard = Jaccard(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component): component is the id of the least document reachable by links."""
    id_type = docs.schema[key].dataType.simpleString()
    real = lambda c: F.when(c != _LEAST, c).cast(id_type)
    return _grouped(docs, config, key, text).select(real(F.col("id")).alias(key), F.col("n").alias("n_shingles"), real(F.col("first.id")).alias("component"))


def keep_one(docs: DataFrame, config: Jaccard = Jaccard(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are near duplicates of a lesser one; columns as they came."""
    own = free_name(docs, "node")
    first = _grouped(docs, config, key, text).where("doc = first.doc").select(F.col("doc").alias(own)).distinct()
    kept = docs.withColumn(own, _node(key, text)).join(first, own, "left_semi")
    return kept.dropDuplicates([own]).select(*(F.col(f"`{c}`") for c in docs.columns))
