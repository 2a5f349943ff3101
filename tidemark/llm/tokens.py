"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens at places that no merge of the vocabulary can cross; the token counts
of the pieces add up to the text's.  Tier one is a table of the most frequent pre-tokens and their
counts, broadcast to the workers: at most `frequent` entries of at most `longest` characters, so its
size has a fixed bound.  Tier two is a cache in each worker, filled by encoding what tier one
misses and emptied when it is full.  No pre-token is shuffled: frequent ones are found by Misra-Gries
summaries, one a task, of which groups of `fan_in` are merged until one is left.  The table only
saves time; the counts are those of the library whatever it holds.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
columns of the input that clash with added ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .words import slices

ADDED = ("n_bytes", "n_tokens", "over_limit")
#: U+2581, which the library writes for a space.
_MARK = "▁"


@dataclass(frozen=True)
class TokenCounts:
    model: str  # path of a .model (sentencepiece) file, there on every executor
    limit: int = 4096
    frequent: int = 20_000
    longest: int = 64
    fan_in: int = 32
    cached: int = 200_000


@cache
def _tokenizer(model: str):
    """The encoder, the pattern of pre-tokens and what to put before a text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    crossing = any(_MARK in p.lstrip(_MARK) for p in pieces if not sp.is_control(sp.piece_to_id(p)))
    newline = any("\n" in p for p in pieces)
    plain = sp.encode("a  b") != sp.encode("a b") and sp.encode("Ａ") != sp.encode("A")
    if crossing or not plain:  # merges may cross any place: only whole texts are safe
        return sp, re.compile(r"(?s).+")
    # A cut falls before a run of spaces and, where no piece holds a newline, around each newline.
    if newline:
        return sp, re.compile(f"[ {_MARK}]*[^ {_MARK}]+|[ {_MARK}]+")
    return sp, re.compile(f"\n+|[ {_MARK}]*[^ {_MARK}\n]+|[ {_MARK}]+")


class _Counter:
    """Counts the tokens of texts with both tiers."""

    def __init__(self, config: TokenCounts, table: dict[str, int]):
        self.sp, self.pattern = _tokenizer(config.model)
        self.table, self.most, self.misses = table, config.cached, {}
        # The library puts a space before a text; pieces inside one must not get another.
        probe = "a"
        self.prefix = " " if self.sp.encode(probe, out_type=str)[0].startswith(_MARK) else ""
        self.head = len(self.sp.encode("\n" + probe)) - len(self.sp.encode(probe)) if self.prefix else 0

    def encoded(self, piece: str) -> int:
        if not self.prefix:
            return len(self.sp.encode(piece))
        if piece[0] in (" ", _MARK):
            return len(self.sp.encode(piece[1:])) if len(piece) > 1 else 1
        # A piece without a leading space: encode it after a newline, which no piece joins, and take that away.
        return len(self.sp.encode("\n" + piece)) - len(self.sp.encode("\n"))

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, table, misses = 0, self.table, self.misses
        for piece in self.pattern.findall(self.prefix + text):
            n = table.get(piece)
            if n is None:
                n = misses.get(piece)
                if n is None:
                    if len(misses) >= self.most:
                        misses.clear()
                    n = self.encoded(piece)
                    if len(piece) <= 256:
                        misses[piece] = n
            total += n
        return total


def _trim(counts: Counter, most: int) -> Counter:
    """Misra-Gries: takes the (most + 1)th count from all, keeps what is left above 0."""
    if len(counts) <= most:
        return counts
    cut = sorted(counts.values(), reverse=True)[most]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def frequent_pretokens(texts: DataFrame, config: TokenCounts) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens. texts: one column, text."""
    schema = "part int, summary binary"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _, pattern = _tokenizer(config.model)
        counts: Counter = Counter()
        for batch in slices(batches, "text", 1 << 20):
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(x for x in pattern.findall(" " + text) if len(x) <= config.longest)
            if len(counts) > 8 * config.frequent:
                counts = _trim(counts, config.frequent)
        out = pickle.dumps(dict(_trim(counts, config.frequent)))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "summary": pa.array([out], pa.binary())})

    def merge(pdf):
        import pandas as pd

        counts: Counter = Counter()
        for x in pdf["summary"]:
            counts.update(pickle.loads(x))
            counts = _trim(counts, config.frequent)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "summary": [pickle.dumps(dict(counts))]})

    summaries = written(texts.mapInArrow(summarise, schema), "pretokens")
    left = summaries.agg(F.max("part")).first()[0]
    while left:
        summaries = summaries.withColumn("part", F.floor(F.col("part") / config.fan_in).cast("int")).groupBy("part").applyInPandas(merge, schema)
        left //= config.fan_in
    found = summaries.first()  # the one summary that is left
    counter = _Counter(config, {})
    return {k: counter.encoded(k) for k in sorted(pickle.loads(found["summary"]))} if found else {}


def token_counts(docs: DataFrame, config: TokenCounts, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_pretokens(docs.select(F.col(text).alias("text")), config))
    kept = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(config, table.value)
        for batch in slices(batches, text, 4 << 20):
            texts = batch.column(text)
            tokens = [counter.count(x) if x else 0 for x in texts.to_pylist()]
            columns = [batch.column(n) for n in names]
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, n_bytes, pa.array(tokens, pa.int64()), pa.array([x > config.limit for x in tokens], pa.bool_())], names=[*names, *ADDED])

    import pyarrow.compute  # noqa: F401

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)
