"""Fuzzy line dedup by MinHash.

A line, without white space at its ends, is the set of its k-character shingles (all of it if it is
shorter).  Lines of one content are one node, named by a 64-bit hash.

1. Signatures: `bands` * `rows` minima of hashed shingles, once for each distinct line of a chunk.  Short
   lines take them over as many hash functions, long ones over as many ranges of one (a one-permutation
   hash).  Lines that agree in all rows of a band meet; with 14 bands of 5 rows a pair of similarity 0.8
   meets with probability 0.996, one of 0.9 with 0.99999.
2. Lines that meet are compared exactly, by the shingles themselves, in the regions of the Jaccard
   join: few lines of a band as pairs, more of them round a pivot.
3. Links join components by distributed union-find, and of each component the first line (least
   document, then least line) stays.

Defined results: lines are parted by newlines; blank lines belong to no component and stay; null or
empty texts have one blank line; a document is an id and a text, so rows that repeat both are one, and texts that
share an id, or have none, are documents of their own in the order of the text's hash; null ids count as the least
id; of equal lines in one document the first stays; a very long text is worked on by one task, in memory
about 40 times its size, and a very long line is compared as any other; columns whose names clash with those of
the operator are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .shared import components, free_name, written
from .words import SPACE, U, distinct, mix, slices, spans, texts

_LEAST = -(1 << 63)


@dataclass(frozen=True)
class Lines:
    k: int = 7
    percent: int = 80
    bands: int = 14
    rows: int = 5
    many: int = 100  # distinct shingles up to which a line goes by many hashes
    pairwise: int = 16
    chunk_bytes: int = 8 << 20
    small: int = 1_000_000  # distinct lines whose hashes may be broadcast

    def jaccard(self) -> jaccard.Jaccard:
        return jaccard.Jaccard(k=self.k, percent=self.percent, region_bytes=32 << 20)


#: Bytes at the ends of a line that don't count.
_BLANK = SPACE.copy()
_BLANK[10] = False
PIECE = 1 << 20  # bytes of text that are worked on at once


@dataclass
class _Lines:
    data: np.ndarray  # UTF-8 of the rows
    row: np.ndarray  # of each line that isn't blank
    nth: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    count: np.ndarray  # lines of each row, blank ones too


def _lines(column: pa.Array) -> _Lines:
    t = texts(column)
    data = t.data
    breaks = np.flatnonzero(data == 10)
    count = np.diff(np.searchsorted(breaks, t.offsets)) + 1
    first = np.cumsum(count) - count
    begin, stop = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - first[row]
    begin[first], stop[first + count - 1] = t.offsets[:-1], t.offsets[1:]
    later = nth > 0
    begin[later] = breaks + 1
    stop[np.append(later[1:], False) if len(later) else later] = breaks
    for at, step in ((begin, 1), (stop, -1)):
        open_ = np.arange(len(begin))
        while len(open_):
            open_ = open_[begin[open_] < stop[open_]]
            open_ = open_[_BLANK[data[at[open_] - (step < 0)]]]
            at[open_] += step
    keep = stop > begin
    start, end = begin[keep], stop[keep]
    return _Lines(data, row[keep], nth[keep], start, end, spans(data, start, end), count)


def _points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points, and where each byte's one is (None: each byte is one)."""
    if not (data & 0x80).any():
        return data, None
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if lead[-1] != len(codes):  # not UTF-8: bytes stand for characters
        return data, None
    return codes, lead


def _hashes(codes: np.ndarray, k: int, kind=np.uint32) -> np.ndarray:
    """A hash of the k characters from each place on."""
    n = len(codes) - k + 1
    base, one = (kind(0x9E3779B1), kind(0x85EBCA6B)) if kind is np.uint32 else (kind(0x9E3779B97F4A7C15), kind(0xBF58476D1CE4E5B9))
    c = codes.astype(kind)
    x = c[:n] * one
    for j in range(1, k):
        x *= base
        x += c[j : j + n]
    if kind is np.uint64:
        return mix(x)
    x ^= x >> kind(16)
    x *= one
    x ^= x >> kind(13)
    x *= kind(0xC2B2AE35)
    x ^= x >> kind(16)
    return x


def shingles(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of one line."""
    line, _ = _points(np.frombuffer(raw, np.uint8))
    return distinct(_hashes(line, k, np.uint64)) if len(line) >= k else mix(np.array([len(line)], U) + _hashes(line, len(line), np.uint64))


def _multiplied(y: np.ndarray, first: np.ndarray, config: Lines) -> np.ndarray:
    """(band, line) -> key from minima over as many multiplied hashes."""
    step = np.random.default_rng(20_240_229).integers(1 << 31, size=(config.bands, config.rows), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    z, out = np.empty_like(y), np.empty((config.bands, len(first)), U)
    for band in range(config.bands):
        key = np.full(len(first), band + 1, U)
        for a in step[band]:
            np.multiply(y, a, out=z)
            key *= U(0x9E3779B97F4A7C15)
            key ^= np.minimum.reduceat(z, first).astype(U)
        out[band] = mix(key)
    return out


def _binned(y: np.ndarray, first: np.ndarray, config: Lines) -> np.ndarray:
    """(band, line) -> key from one permutation: the minima of as many ranges of the hash; an empty one takes the next that isn't.

    The hashes of a line are in order.
    """
    bins, n = config.bands * config.rows, len(first)
    size = np.diff(np.append(first, len(y)))
    line = np.repeat(np.arange(n, dtype=np.uint64), size)
    packed = (line << U(32)) | y
    place = (packed >> U(32)).astype(np.int64) * bins + ((packed & U(0xFFFFFFFF)) * U(bins) >> U(32)).astype(np.int64)
    head = np.concatenate(([True], place[1:] != place[:-1]))
    least = np.zeros(n * bins, U)
    held = np.zeros(n * bins, bool)
    least[place[head]], held[place[head]] = packed[head] & U(0xFFFFFFFF), True
    least, held = least.reshape(n, bins), held.reshape(n, bins)
    at = np.where(held, np.arange(bins), 2 * bins)
    at = np.minimum.accumulate(np.concatenate([at, at + bins], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :bins]
    away = at - np.arange(bins)
    value = mix(np.take_along_axis(least, at % bins, axis=1) + (away.astype(U) << U(33)))
    out = np.empty((config.bands, n), U)
    for band in range(config.bands):
        key = np.full(n, band + 1_000, U)
        for r in range(config.rows):
            key *= U(0x9E3779B97F4A7C15)
            key ^= value[:, band * config.rows + r]
        out[band] = mix(key)
    return out


def _bands(x: _Lines, at: np.ndarray, config: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(key, line hash) of the lines at the places `at`.

    Lines of up to `many` distinct shingles go by many hashes, those of more by one permutation; those
    that could be similar to one of the other sort go by both.
    """
    k = config.k
    codes, lead = _points(x.data)
    start, end = (x.start[at], x.end[at]) if lead is None else (lead[x.start[at]], lead[x.end[at]])
    size = end - start - k + 1
    short = np.flatnonzero(size < 1)
    keys, names = [mix(x.hashes[at[short]] ^ U(1))], [x.hashes[at[short]]]  # meet only their like
    h = _hashes(codes, k) if len(codes) >= k else None
    # Linked lines have numbers of distinct shingles within `percent` of each other, so one sort's reach ends at many / percent and begins at many * percent.
    few = (size > 0) & (100 * size < config.percent * config.many)  # of few places, hence of few shingles
    for may_repeat, rows in ((False, few), (True, (size > 0) & ~few)):
        rows = np.flatnonzero(rows)
        begin = 0
        while begin < len(rows):  # some lines at a time, so that the work stays in the cache
            end_ = begin + max(1, int(np.searchsorted(np.cumsum(size[rows[begin : begin + 2048]]), 65_536)))
            part = rows[begin:end_]
            n = size[part]
            first = np.cumsum(n) - n
            y = h[np.repeat(start[part] - first, n) + np.arange(int(n.sum()))]
            name = x.hashes[at[part]]
            if may_repeat:
                packed = distinct((np.repeat(np.arange(len(part), dtype=np.uint64), n) << U(32)) | y)
                n = np.bincount((packed >> U(32)).astype(np.int64), minlength=len(part))
                sorts = ((_multiplied, config.percent * n <= 100 * config.many), (_binned, 100 * n >= config.percent * config.many))
                sorts = [(how, packed[np.repeat(chosen, n)], n[chosen], name[chosen]) for how, chosen in sorts if chosen.any()]
            else:
                sorts = [(_multiplied, y, n, name)]
            for how, held, many, own in sorts:
                keys.append(how(held.astype(np.uint32), np.cumsum(many) - many, config).ravel())
                names.append(np.tile(own, config.bands))
            begin = end_
    return np.concatenate(keys), np.concatenate(names)


def _signed(body: DataFrame, config: Lines) -> DataFrame:
    """Packed (band key, line hash) by bucket, for each distinct line of a chunk."""
    buckets = 4 * int(body.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", config.chunk_bytes):
            keys, lines, seen = [], [], np.zeros(0, U)
            for part in slices(iter([piece]), "text", PIECE):
                x = _lines(part.column("text"))
                _, at = np.unique(x.hashes, return_index=True)
                at = at[~np.isin(x.hashes[at], seen)]
                seen = np.concatenate((seen, x.hashes[at]))
                key, line = _bands(x, at, config)
                keys.append(key), lines.append(line)
            key, line = np.concatenate(keys), np.concatenate(lines)
            bucket = ((key >> U(17)) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            values, first = np.unique(bucket[order], return_index=True)
            cut, held = [*first.tolist(), len(order)], (key[order], line[order])
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), *(pa.array([v[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for v in held)], names=["bucket", "key", "line"])

    return body.select("text").mapInArrow(run, "bucket int, key binary, line binary")


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate((np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new]


def _met(signed: DataFrame, config: Lines) -> DataFrame:
    """(kind, a, b) as the Jaccard join takes it: pairs of lines of a band, or a pivot and a line of a larger one."""

    def run(table: pa.Table) -> pa.Table:
        key, line = (np.concatenate([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()]) for c in ("key", "line"))
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (line[1:] != line[:-1]))) if len(key) else np.zeros(0, bool)
        key, line = key[new], line[new].view(np.int64)
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(key)))
        of = np.repeat(size, size)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, min(config.pairwise, max(len(key), 1))):
            i = np.flatnonzero((key[:-step] == key[step:]) & (of[:-step] <= config.pairwise))
            a.append(np.minimum(line[i], line[i + step])), b.append(np.maximum(line[i], line[i + step]))
        pairs = _distinct_pairs(np.concatenate(a), np.concatenate(b))
        keep = of > config.pairwise
        # Lines are sorted within a key, and their names are hashes: the first is the pivot.
        large = _distinct_pairs(line[np.repeat(head, size)][keep], line[keep])
        kind = np.concatenate([np.zeros(len(pairs[0]), np.int32), np.ones(len(large[0]), np.int32)])
        return pa.table({"kind": kind, "a": np.concatenate([pairs[0], large[0]]), "b": np.concatenate([pairs[1], large[1]])})

    return written(signed.groupBy("bucket").applyInArrow(run, "kind int, a long, b long"), "bands")


def line_links(body: DataFrame, config: Lines) -> DataFrame:
    """Links (a, b) between the hashes of lines that are similar enough. body: doc, text."""
    regions = written(jaccard._regions(_met(_signed(body, config), config), None), "line-regions")
    wanted = regions.select("doc").distinct()
    few = wanted.count() <= config.small
    names = np.sort(np.array([r[0] for r in wanted.toLocalIterator()], np.int64)) if few else None
    chosen = body.sparkSession.sparkContext.broadcast(names)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE):
            x = _lines(piece.column("text"))
            _, at = np.unique(x.hashes, return_index=True)
            name = x.hashes[at].view(np.int64)
            if chosen.value is not None:
                place = np.minimum(np.searchsorted(chosen.value, name), max(len(chosen.value) - 1, 0))
                held = chosen.value[place] == name if len(chosen.value) else np.zeros(len(name), bool)
                at, name = at[held], name[held]
            size = x.end[at] - x.start[at]
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(size), pa.array([x.data[i:j].tobytes() for i, j in zip(x.start[at].tolist(), x.end[at].tolist())], pa.binary())], names=["doc", "n", "shingles"])

    sets = body.select("text").mapInArrow(fetch, "doc long, n long, shingles binary")
    if not few:
        sets = sets.join(wanted, "doc", "left_semi")
    sets = written(sets.dropDuplicates(["doc"]), "lines")
    k = config.k
    return jaccard.linked(regions, sets, config.jaccard(), lambda raw: shingles(raw, k))


_PLACES = "bucket int, kind int, line binary, doc binary, tag binary, nth binary"
_TYPES = {"line": np.int64, "doc": np.int64, "tag": np.int64, "nth": np.int32}


def _pack(bucket: np.ndarray, kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, with its entries' columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    held = {c: columns[c].astype(t)[order] if c in columns else None for c, t in _TYPES.items()}
    arrays = [pa.array([None] * len(values) if x is None else [x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(values, pa.int32()), pa.array(np.full(len(values), kind), pa.int32()), *arrays], names=["bucket", "kind", *_TYPES])


def _unpack(table: pa.Table, kind: int, *names: str) -> list[np.ndarray]:
    kinds = table.column("kind").to_pylist()
    rows = [i for i, x in enumerate(kinds) if x == kind]
    columns = [table.column(n).to_pylist() for n in names]
    return [np.concatenate([np.frombuffer(c[i], _TYPES[n]) for i in rows]) if rows else np.zeros(0, _TYPES[n]) for n, c in zip(names, columns)]


def _repeats(root: np.ndarray, doc: np.ndarray, tag: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first entry of each root, and of those that come after it."""
    order = np.lexsort((nth, tag, doc, root))
    r, d, t, n = root[order], doc[order], tag[order], nth[order]
    head = np.concatenate((np.ones(min(1, len(r)), bool), r[1:] != r[:-1]))
    at = np.flatnonzero(head)
    lead = np.repeat(at, np.diff(np.append(at, len(r))))
    return order[head], order[~head & ((d != d[lead]) | (t != t[lead]) | (n != n[lead]))]


_GONE = 2


def repeated_lines(body: DataFrame, roots: DataFrame, config: Lines) -> DataFrame:
    """(doc, tag, nth) of the lines that aren't the first of their component; rows may repeat. roots: (node, root)."""
    buckets = 4 * int(body.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def bucket(x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) >> U(21)) % U(buckets)).astype(np.int32)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in slices(batches, "text", config.chunk_bytes):
            found = []
            for piece in slices(iter([chunk]), "text", PIECE):
                x = _lines(piece.column("text"))
                found.append((x.hashes.view(np.int64), *(piece.column(c).to_numpy(zero_copy_only=False)[x.row] for c in ("doc", "tag")), x.nth))
            line, doc, tag, nth = (np.concatenate(x) for x in zip(*found))
            # A line that a chunk holds many times goes once; the others surely go.
            first, late = _repeats(line, doc, tag, nth)
            if len(first):
                yield _pack(bucket(line[first]), 0, line=line[first], doc=doc[first], tag=tag[first], nth=nth[first])
            if len(late):
                yield _pack((doc[late] % buckets).astype(np.int32), _GONE, doc=doc[late], tag=tag[late], nth=nth[late])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, root = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root"))
            if len(node):
                yield _pack(bucket(node), 0, line=node, doc=root)

    def named(table: pa.Table, known: pa.Table) -> pa.Table:
        line, doc, tag, nth = _unpack(table, 0, *_TYPES)
        node, root = _unpack(known, 0, "line", "doc")
        if len(node):
            order = np.argsort(node)
            at = np.minimum(np.searchsorted(node[order], line), len(node) - 1)
            line = np.where(node[order][at] == line, root[order][at], line)
        first, late = _repeats(line, doc, tag, nth)
        gone = [np.concatenate((x[late], y)) for x, y in zip((doc, tag, nth), _unpack(table, _GONE, "doc", "tag", "nth"))]
        out = [_pack(bucket(line[first]), 0, line=line[first], doc=doc[first], tag=tag[first], nth=nth[first]), _pack((gone[0] % buckets).astype(np.int32), _GONE, doc=gone[0], tag=gone[1], nth=gone[2])]
        return pa.Table.from_batches(out)

    def settled(table: pa.Table) -> pa.Table:
        line, doc, tag, nth = _unpack(table, 0, *_TYPES)
        _, late = _repeats(line, doc, tag, nth)
        gone = [np.concatenate((x[late], y)) for x, y in zip((doc, tag, nth), _unpack(table, _GONE, "doc", "tag", "nth"))]
        return pa.table({"doc": gone[0], "tag": gone[1], "nth": gone[2].astype(np.int64)})

    here = body.mapInArrow(places, _PLACES).groupBy("bucket").cogroup(roots.mapInArrow(pairs, _PLACES).groupBy("bucket"))
    return here.applyInArrow(named, _PLACES).groupBy("bucket").applyInArrow(settled, "doc long, tag long, nth long")


def _found(docs: DataFrame, config: Lines, key: str, text: str) -> DataFrame:
    """(doc, tag, n_lines, removed) of each row; a document is its id and a hash of its text."""
    body = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("doc"), _tag(text).alias("tag"), F.coalesce(text, F.lit("")).alias("text"))
    roots = components(line_links(body, config))
    gone = repeated_lines(body, roots, config).groupBy("doc", "tag").agg(F.array_sort(F.collect_set("nth")).alias("removed"))
    counts = body.select("doc", "tag", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    return counts.join(gone, ["doc", "tag"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))


def _tag(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def duplicate_lines(docs: DataFrame, config: Lines = Lines(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, removed): the numbers, from 0, of the lines that repeat an earlier one or are near it."""
    id_type = docs.schema[key].dataType.simpleString()
    return _found(docs, config, key, text).select(F.when(F.col("doc") != _LEAST, F.col("doc")).cast(id_type).alias(key), "n_lines", "removed")


def dedup(docs: DataFrame, config: Lines = Lines(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that its kept lines make, as kept_text; all columns else as they came."""
    doc, tag, gone = (free_name(docs, x) for x in ("doc", "tag", "gone"))
    found = _found(docs, config, key, text).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("removed").alias(gone)).dropDuplicates([doc, tag])
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i.cast("long"))), "\n")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "kept_text"]
    named = docs.withColumns({doc: F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)), tag: _tag(text)})
    return named.join(found, [doc, tag], "left").select(*own, kept.alias("kept_text"))
