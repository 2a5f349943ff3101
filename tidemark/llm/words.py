"""Vectorised word, shingle and character-gram hashing over Arrow text columns.

Everything here works on whole Arrow batches with numpy: no Python string is made per
word.  Hashes are 64 bits wide; callers that need certainty compare the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_STEP = 0xD6E8FEB86659FD93
CHUNK_BYTES = 2 << 20

#: The bytes that part words (space, tab, newline, vertical tab, form feed, return).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Texts:
    """Raw UTF-8 of some rows: byte i of row r is data[offsets[r] + i]."""

    data: np.ndarray
    offsets: np.ndarray


def texts(column: pa.Array) -> Texts:
    """A view of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(raw, at - at[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each piece has about `most` bytes of text (or one row)."""
    for batch in batches:
        at = texts(batch.column(batch.schema.get_field_index(column))).offsets
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


@dataclass
class Words:
    """Words of some rows in order; those of row r are first[r] to first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @cached_property
    def blocks(self) -> np.ndarray:
        return _blocks(self.data)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether word a is word b, byte by byte, for each entry."""
        size = self.end[a] - self.start[a]
        same = size == self.end[b] - self.start[b]
        if same.all():
            return same_spans(self.data, self.blocks, size, self.start[a], self.start[b])
        same[same] = same_spans(self.data, self.blocks, size[same], self.start[a[same]], self.start[b[same]])
        return same

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The row's words, or those that `keep` marks, joined by one space."""
        a, b = self.first[row], self.first[row + 1]
        raw = self.data
        at = range(a, b) if keep is None else (np.flatnonzero(keep[a:b]) + a).tolist()
        return b" ".join(raw[self.start[i] : self.end[i]].tobytes() for i in at)


def words(column: pa.Array, lower: bool, space: np.ndarray = SPACE) -> Words:
    t = texts(column)
    data = LOWER[t.data] if lower else t.data
    inside = ~space[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1 : n + 1])) + 1
    return Words(data, start, end, np.searchsorted(start, t.offsets), spans(data, start, end))


def _folded(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step of a chained hash. The shifts keep it from being a polynomial, which structured texts could cancel out."""
    h = h ^ (x * U(0x9E3779B97F4A7C15))
    h *= U(_STEP)
    h ^= h >> U(29)
    return h


def _blocks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def _tail(x: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Blocks without what lies beyond the `left` bytes (1 or more) that count."""
    return x & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * np.minimum(left, 8).astype(U)))


_LONG = 64  # bytes up to which a span is hashed in step with others


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each data[start:end]: 8 bytes at a time, or one call for each of the long ones."""
    size = end - start
    h = size.astype(U) * U(_STEP)
    if not len(start):
        return h
    blocks = _blocks(data)
    short = size <= _LONG
    live = np.arange(len(start)) if short.all() else np.flatnonzero(short)
    for j in range(0, _LONG, 8):
        live = live[size[live] > j]
        if not len(live):
            break
        h[live] = _folded(h[live], _tail(blocks[start[live] + j], size[live] - j))
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(~short).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return mix(h)


def same_spans(data: np.ndarray, blocks: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a on are those from b on, for each entry. blocks: _blocks(data)."""
    same, live = np.ones(len(size), bool), np.arange(len(size))
    for j in range(0, 1 << 20, 8):
        live = live[size[live] > j]
        if not len(live):
            return same
        left = size[live] - j
        equal = _tail(blocks[a[live] + j], left) == _tail(blocks[b[live] + j], left)
        same[live[~equal]] = False
        live = live[equal]
    for i in live.tolist():
        same[i] = data[a[i] : a[i] + size[i]].tobytes() == data[b[i] : b[i] + size[i]].tobytes()
    return same


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words within a row, and their offsets by row."""
    count = np.maximum(np.diff(w.first) - k + 1, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    n = len(w.hashes) - k + 1
    if n <= 0 or not first[-1]:
        return np.zeros(0, U), first
    h = w.hashes[:n]
    for j in range(1, k):
        h = _folded(h, w.hashes[j : j + n])
    at = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])
    return mix(h[at]), first


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct k-word shingle hashes; all its words as one if there are fewer than k."""
    h, first = grams(w, k)
    out = []
    for r in range(len(first) - 1):
        a, b = first[r], first[r + 1]
        if b > a:
            s = np.sort(h[a:b])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif w.first[r + 1] > w.first[r]:
            x = w.hashes[w.first[r] : w.first[r] + 1] ^ U(w.first[r + 1] - w.first[r])
            for y in range(w.first[r] + 1, w.first[r + 1]):
                x = _folded(x, w.hashes[y : y + 1])
            out.append(mix(x))
        else:
            out.append(np.zeros(0, U))
    return out


def minima(h: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: places of the least hash (by its upper 40 bits; rightmost of equals) of every `width` consecutive ones of a row; distinct, sorted.

    A row with fewer than `width` hashes has no place.
    """
    out, piece = [], 1 << 23  # a place fits 24 bits
    count = np.maximum(np.diff(first) - width + 1, 0)
    off = np.concatenate(([0], np.cumsum(count)))
    inside = np.repeat(first[:-1] - off[:-1], count) + np.arange(off[-1])  # where the windows of rows begin
    for lo in range(0, max(len(h) - width + 1, 0), piece):
        part = h[lo : lo + piece + width - 1]
        low = (part & ~U(0xFFFFFF)) | np.arange(len(part) - 1, -1, -1, dtype=np.uint64)
        held = 1
        while held < width:  # each step doubles what a least value covers
            step = min(held, width - held)
            low = np.minimum(low[:-step], low[step:])
            held += step
        mine = inside[np.searchsorted(inside, lo) : np.searchsorted(inside, lo + len(low))] - lo
        out.append(lo + len(part) - 1 - (low[mine] & U(0xFFFFFF)).astype(np.int64))
    return distinct(np.concatenate(out)) if out else np.zeros(0, np.int64)


def normalised(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, after a leading space; and where each word begins."""
    size = w.end - w.start
    begin = np.cumsum(size + 1) - size if len(size) else np.zeros(0, np.int64)
    out = np.full(int(size.sum()) + len(size) + 1, 0x20, np.uint8)
    letter = np.ones(len(out), bool)
    letter[begin - 1] = False
    letter[-1] = False
    out[letter] = w.data[~SPACE[w.data]]
    return out, begin
