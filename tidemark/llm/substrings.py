"""Substring dedup by repeated-phrase automata.

A window is `window` consecutive words.  Each word that a window covers goes, if that window's words
also start earlier (smaller document, or earlier in the same one).

1. Passages.  Winnowing picks phrases of `phrase` words so that equal windows pick equal phrases.
   Tasks send the text of each phrase once a chunk, so one that a third of all documents hold is
   folded before it moves; phrases whose texts come from two places or more are confirmed.
2. Automata.  Documents lie in shards of about `shard_bytes`.  Confirmed phrases go to the shards they
   occur in and are compiled there, once, to Aho-Corasick automata of at most `automaton_bytes`
   of phrases each.  Every text of the shard streams through them, and what they report is all that is
   known of recurring text from here on: a window that holds no occurrence can't recur.
3. Windows.  Runs of windows that hold an occurrence are compared by their words: those that a shard
   repeats go at once, and the first ones travel as text, by their least phrase, to be compared
   between shards.  A hash only sorts them; no word goes unless its window's bytes were found equal.
4. The removed windows come back to their shard, where the kept words are joined.

Phrases, runs and verdicts move as packed arrays, a row for each shard and task.  The texts move
once: both passes over the shards read the same exchange.

Defined results: a null text has no words; a document is an id and a text, so rows that repeat both
count as one, and texts that share an id, or have none, are documents of their own in the order of the
text's hash; null ids count as the least id; a very long text is worked on by one task, which takes
about 60 bytes of memory for each of its bytes; ties can't occur, as places are distinct; an empty
table gives no rows; only the columns named are returned, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, Words, distinct, grams, minima, normalised, slices, words

_LEAST = -(1 << 63)


@dataclass(frozen=True)
class Substrings:
    window: int = 20
    phrase: int = 6
    chunk_bytes: int = 8 << 20  # text of a task that is folded before it moves
    bucket_bytes: int = 8 << 20  # text for each bucket of phrases or windows
    shard_bytes: int = 2 << 20  # text of a shard, whose automaton then stays in a processor's cache
    automaton_bytes: int = 1 << 20  # phrases of an automaton, which takes about 60 times as much


_TYPES = {"n": np.uint32, "shard": np.uint32, "doc": np.int64, "tag": np.int64, "at": np.uint32}
#: Packed rows: phrases by bucket; confirmed phrases by shard; runs of windows and verdicts; verdicts by shard.
_PHRASES = "bucket int, text binary, n binary, shard binary"
_KNOWN = "shard int, text binary"
_FOUND = "bucket int, kind int, text binary, shard binary, doc binary, tag binary, at binary"
_GONE = "shard int, doc binary, tag binary, at binary"
_RUN, _VERDICT = 0, 1


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))]))


def _pieces(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by group, and (group, begin, end) of each in it."""
    order = np.argsort(group, kind="stable")
    values, first = np.unique(group[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    return order, list(zip(values.tolist(), cut, cut[1:]))


def _unpack(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], _TYPES[name]) for r in rows]) if rows else np.zeros(0, _TYPES[name])


def _picked(w: Words, config: Substrings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place of its first word) of the phrases that winnowing picks."""
    h, first = grams(w, config.phrase)
    at = minima(h, first, config.window - config.phrase + 1)
    row = np.searchsorted(first, at, "right") - 1
    return h[at], row, at - first[row] + w.first[row]


def _phrases(left: DataFrame, config: Substrings, shards: int, buckets: int) -> DataFrame:
    """Packed texts of the recurring phrases, for each shard that holds them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", config.chunk_bytes):
            seen: dict[bytes, int] = {}
            nth, hashes, holders = [], [], []
            for part in slices(iter([piece]), "text"):
                w = words(part.column("text"), False)
                h, row, at = _picked(w, config)
                whole, begin = normalised(w)
                finish = np.append(begin[1:], len(whole))[at + config.phrase - 1] - 1
                raw = whole.tobytes()
                nth.append(np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(begin[at].tolist(), finish.tolist())], np.int64))
                hashes.append(h), holders.append(part.column("shard").to_numpy()[row])
            which, h, shard = np.concatenate(nth), np.concatenate(hashes), np.concatenate(holders).astype(np.int64)
            if not len(which):
                continue
            texts = list(seen)
            bucket = np.zeros(len(texts), np.int64)
            bucket[which] = (h >> U(20)).astype(np.int64) % buckets
            order, groups = _pieces(bucket)
            rank = np.empty(len(texts), np.int64)
            rank[order] = np.arange(len(texts))
            held = distinct(rank[which] * shards + shard)
            many = np.bincount(held // shards, minlength=len(texts))
            upto = np.concatenate(([0], np.cumsum(many)))
            # How many shards hold it, and whether it recurs within this chunk.
            n = (2 * many + (np.bincount(rank[which], minlength=len(texts)) > 1)).astype(np.uint32)
            holder = (held % shards).astype(np.uint32)
            rows = [{"bucket": b, "text": b"\n".join([texts[x] for x in order[i:j].tolist()]), "n": n[i:j].tobytes(), "shard": holder[upto[i] : upto[j]].tobytes()} for b, i, j in groups]
            yield from _table(rows, _PHRASES).to_batches()

    def confirm(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(t, len(seen)) for r in rows for t in r["text"].split(b"\n")], np.int64)
        n, shard = _unpack(rows, "n"), _unpack(rows, "shard").astype(np.int64)
        times = np.bincount(which, weights=1 + (n & 1))
        holder = np.repeat(which, n >> 1)
        pair = distinct((holder * shards + shard)[times[holder] > 1])
        texts = list(seen)
        order, groups = _pieces(pair % shards)
        phrase = (pair // shards)[order].tolist()
        return _table([{"shard": s, "text": b"\n".join([texts[x] for x in phrase[i:j]])} for s, i, j in groups], _KNOWN)

    return left.select("shard", "text").mapInArrow(send, _PHRASES).groupBy("bucket").applyInArrow(confirm, _KNOWN)


def compiled(phrases: list[bytes], most: int) -> Iterator:
    """Automata over the phrases, each of at most `most` bytes of them; what one reports is a phrase's length with the spaces around it."""
    import ahocorasick

    at = 0
    while at < len(phrases):
        automaton, held = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        while at < len(phrases) and (not held or held + len(phrases[at]) <= most):
            x = f" {phrases[at].decode('latin-1')} "  # a character a byte
            automaton.add_word(x, len(x))
            held += len(phrases[at])
            at += 1
        automaton.make_automaton()
        yield automaton


def occurrences(w: Words, phrases: list[bytes], config: Substrings) -> np.ndarray:
    """The places (sorted, of first words) at which the automata find a phrase in the texts."""
    raw, begin = normalised(w)
    text = raw.tobytes().decode("latin-1")
    finish = np.append(begin[1:], len(raw))
    rows = [(int(begin[a]) - 1, int(finish[b - 1])) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()) if b - a >= config.phrase]
    found = []
    for automaton in compiled(phrases, config.automaton_bytes):
        for i, j in rows:
            # A slice, as the automaton copies all of the string that it is given.
            found.append(np.array([i + end - size + 2 for end, size in automaton.iter(text[i:j])], np.int64))
    return np.searchsorted(begin, distinct(np.concatenate(found))) if found else np.zeros(0, np.int64)


def _windows(w: Words, place: np.ndarray, config: Substrings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word, least phrase) of the windows that hold an occurrence at one of the places."""
    big, first = grams(w, config.window)
    if not first[-1] or not len(place):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    # Those that hold one at p begin at p - (window - phrase) to p, within p's row.
    marks = np.zeros(len(w.hashes) + 1, np.int64)
    row = np.searchsorted(w.first, place, "right") - 1
    np.add.at(marks, np.maximum(place - (config.window - config.phrase), w.first[row]), 1)
    np.add.at(marks, place + 1, -1)
    held = np.cumsum(marks)[:-1] > 0
    count = np.diff(first)
    start = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])  # in words
    chosen = np.flatnonzero(held[start])
    row = np.repeat(np.arange(len(count)), count)[chosen]
    small, offset = grams(w, config.phrase)
    at = start[chosen] - w.first[row] + offset[row]
    low = small[at].copy()
    for j in range(1, config.window - config.phrase + 1):
        np.minimum(low, small[at + j], out=low)
    return big[chosen], row, start[chosen], low


def _same(w: Words, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows that begin at words a and b are equal. Where one goes on from another, only its last word is new."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
    same = w.same(x + window - 1, y + window - 1)
    if not same.all():
        new[:] = True
    for j in range(window - 1):
        same[new] &= w.same(x[new] + j, y[new] + j)
    out = np.empty(len(x), bool)
    out[order] = same
    return out


def repeats(w: Words, h: np.ndarray, start: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that are the first of equal windows, and those that come later (in document or place), by the words themselves."""
    sub = np.zeros(len(h), np.int64)
    while True:
        order = np.lexsort((at, tag, doc, sub, h))
        head = np.ones(len(h), bool)
        head[1:] = (h[order][1:] != h[order][:-1]) | (sub[order][1:] != sub[order][:-1])
        place = np.flatnonzero(head)
        lead = order[np.repeat(place, np.diff(np.append(place, len(h))))] if len(h) else order
        rest, of = order[~head], lead[~head]
        same = _same(w, start[rest], start[of], window)
        if same.all():
            break
        # Windows of one hash with different words: the text itself tells them apart.
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(h, h[rest[~same]])).tolist():
            x = b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(start[i], start[i] + window))
            sub[i] = seen.setdefault(x, len(seen))
    late = (doc[rest] != doc[of]) | (tag[rest] != tag[of]) | (at[rest] != at[of])
    return order[head], rest[late]


def _runs(w: Words, start: np.ndarray, row: np.ndarray, low: np.ndarray, columns: dict[str, np.ndarray], buckets: int, window: int) -> list[dict]:
    """Packed runs of windows: neighbours with one least phrase go as one text."""
    order = np.argsort(start)
    start, row, low = start[order], row[order], low[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    whole, begin = normalised(w)
    raw, finish = whole.tobytes(), np.append(begin[1:], len(whole)) - 1
    i, j = begin[start[first]], finish[start[last] + window - 1]
    by, groups = _pieces((low[first] >> U(20)).astype(np.int64) % buckets)
    ends = list(zip(i[by].tolist(), j[by].tolist()))
    held = {n: c[order][first][by].astype(_TYPES[n]) for n, c in columns.items()}
    return [{"bucket": b, "kind": _RUN, "text": b"\n".join([raw[x:y] for x, y in ends[s:t]]), **{n: c[s:t].tobytes() for n, c in held.items()}} for b, s, t in groups]


def removed_windows(left: DataFrame, phrases: DataFrame, config: Substrings, buckets: int) -> DataFrame:
    """Packed (doc, tag, at) of the windows to remove, by shard. left: (shard, doc, tag, text)."""

    def locate(texts: pa.Table, known: pa.Table) -> pa.Table:
        patterns = sorted({t for x in known.column("text").to_pylist() for t in x.split(b"\n")})
        if not patterns or not texts.num_rows:
            return _table([], _FOUND)
        own = int(texts.column("shard")[0].as_py())
        w = words(texts.column("text").combine_chunks(), False)
        h, row, start, low = _windows(w, occurrences(w, patterns, config), config)
        doc, tag = (texts.column(c).to_numpy()[row] for c in ("doc", "tag"))
        at = start - w.first[row]
        first, late = repeats(w, h, start, doc, tag, at, config.window)
        gone = np.sort(late)
        rows = _runs(w, start[first], row[first], low[first], {"shard": np.full(len(first), own), "doc": doc[first], "tag": tag[first], "at": at[first]}, buckets, config.window)
        if len(gone):
            rows.append({"bucket": own % buckets, "kind": _VERDICT, "shard": np.array([own], np.uint32).tobytes(), "doc": doc[gone].tobytes(), "tag": tag[gone].tobytes(), "at": at[gone].astype(np.uint32).tobytes()})
        return _table(rows, _FOUND)

    def settle(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [{"shard": int(np.frombuffer(r["shard"], np.uint32)[0]), "doc": r["doc"], "tag": r["tag"], "at": r["at"]} for r in rows if r["kind"] == _VERDICT]
        runs = [r for r in rows if r["kind"] == _RUN]
        if not runs:
            return _table(out, _GONE)
        w = words(pa.array([t for r in runs for t in r["text"].split(b"\n")], pa.large_binary()), False)
        h, first = grams(w, config.window)
        run = np.repeat(np.arange(len(first) - 1), np.diff(first))
        within = np.arange(len(h)) - first[run]
        doc, tag, shard = (_unpack(runs, n)[run] for n in ("doc", "tag", "shard"))
        at = _unpack(runs, "at")[run].astype(np.int64) + within
        _, late = repeats(w, h, w.first[run] + within, doc, tag, at, config.window)
        gone = np.sort(late)
        order, groups = _pieces(shard[gone])
        gone = gone[order]
        out += [{"shard": s, "doc": doc[gone[i:j]].tobytes(), "tag": tag[gone[i:j]].tobytes(), "at": at[gone[i:j]].astype(np.uint32).tobytes()} for s, i, j in groups]
        return _table(out, _GONE)

    found = left.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(locate, _FOUND)
    return found.groupBy("bucket").applyInArrow(settle, _GONE)


def _kept(w: Words, gone: list[np.ndarray | None], window: int) -> tuple[list[int], list[bytes]]:
    """How many words each row loses, and the others joined. gone: for each row, the windows to remove."""
    whole, begin = normalised(w)
    finish = np.append(begin[1:], len(whole)) - 1
    lost, texts = [], []
    for a, b, starts in zip(w.first[:-1].tolist(), w.first[1:].tolist(), gone):
        if starts is None:
            lost.append(0)
            texts.append(whole[begin[a] : finish[b - 1]].tobytes() if b > a else b"")
            continue
        cover = np.zeros(b - a + 1, np.int64)
        starts = distinct(starts)
        cover[starts] += 1
        cover[starts + window] -= 1
        keep = np.cumsum(cover)[:-1] == 0
        lost.append(b - a - int(keep.sum()))
        mask = np.repeat(keep, finish[a:b] - begin[a:b] + 1)
        texts.append(whole[begin[a] : finish[b - 1] + 1][mask].tobytes()[:-1])
    return lost, texts


def dedup(docs: DataFrame, config: Substrings = Substrings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): kept is the words left, joined by one space."""
    id_type = docs.schema[key].dataType.simpleString()
    body = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    size = body.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards, buckets = max(least, -(-size // config.shard_bytes)), max(least, -(-size // config.bucket_bytes))
    tagged = body.select("doc", F.xxhash64("text").alias("tag"), "text")
    placed = tagged.select(F.pmod(F.xxhash64("doc", "tag"), F.lit(shards)).cast("int").alias("shard"), "doc", "tag", "text")
    left = placed.repartition("shard")
    gone = removed_windows(left, _phrases(placed, config, shards, buckets), config, buckets)

    def rest(texts: pa.Table, packed: pa.Table) -> pa.Table:
        rows = packed.to_pylist()
        doc, tag, at = (_unpack(rows, n) for n in ("doc", "tag", "at"))
        order = np.lexsort((tag, doc))
        doc, tag, at = doc[order], tag[order], at[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))) if len(doc) else np.zeros(0, np.int64)
        held = {(d, t): at[i:j] for d, t, i, j in zip(doc[first].tolist(), tag[first].tolist(), first.tolist(), [*first[1:].tolist(), len(doc)])}
        out = []
        for piece in slices(iter(texts.combine_chunks().to_batches()), "text"):
            w = words(piece.column("text"), False)
            ids = piece.column("doc").to_pylist()
            lost, kept = _kept(w, [held.get(x) for x in zip(ids, piece.column("tag").to_pylist())], config.window)
            out.append(pa.table([pa.array(ids, pa.int64()), pa.array(np.diff(w.first)), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[key, "n_words", "n_removed", "kept"]))
        schema = pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    out = left.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(rest, f"`{key}` long, n_words long, n_removed long, kept string")
    return out.withColumn(key, F.when(F.col(key) != _LEAST, F.col(key)).cast(id_type))
