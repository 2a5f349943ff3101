"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least (leftmost of equals) k-gram hashes of every `width`
consecutive ones, with their places.  A span of k + width - 1 = `window` words that a document shares
with an item has its fingerprint at the same place of the span in both, so joining fingerprints
finds every such span.  A hit is extended to all windows that hold it, and a window counts if its words, as
text, are those of one of the item's windows.  A place of a document meets an item once, and windows are
joined by their text, so texts and items that repeat one phrase over and over cost no more than others of their length.
An item with fewer words is one window; all m-grams of the documents are then joined too, for each such
length m that the items really have, in the same scan.

All of it is DataFrame expressions.  What is broadcast was measured and is at most `broadcast_bytes`.

Defined results: null texts and texts without words have no words, hits or items; null item ids
count as the empty string; items of equal id count once, by all their texts; repeated rows are judged each; a very
long text is one row's array of words, in one task; which of equal hashes winnowing keeps changes no result; empty tables
are fine on both sides; columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, let, written

#: What parts words, after A-Z are put in lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK_UNFOLDED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ADDED = ("n_words", "n_hit", "items")
_PLACES = 24  # bits of a packed fingerprint that hold the place


@dataclass(frozen=True)
class Winnow:
    window: int = 10
    k: int = 5
    broadcast_bytes: int = 32 << 20


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is. The cheaper function does where there is only ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    return F.array_remove(F.split(folded(text), BREAK), "")


def _hash(*grams: Column) -> Column:
    """40 bits, so that the hash and a place fit one long."""
    return F.shiftright(F.xxhash64(*grams), _PLACES)


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _gram(h: Column, i: Column, k: int) -> Column:
    """Hash of the k word hashes from place i on. Single elements are far cheaper to take than slices."""
    return _hash(*(F.get(h, i + j) for j in range(k)))


def _pack(h: Column, k: int) -> Column:
    """For each k-gram, its hash and place as one long. h: hashes of the words."""
    return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.shiftleft(_gram(h, i, k), _PLACES).bitwiseOR(i.cast("long")))


def _pairs(h: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.struct(_gram(h, i, k).alias("h"), i.alias("at")))


_PRINT = "array<struct<h:bigint,at:int>>"


def _winnowed(h: Column, config: Winnow) -> Column:
    """Array of (h, at) of the word hashes of a text with at least `window` words, else empty."""
    k, width = config.k, config.window - config.k + 1
    least = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - width), lambda i: F.least(*(F.get(g, i + j) for j in range(width))) if width > 1 else F.get(g, i)))
    opened = lambda c: F.transform(c, lambda x: F.struct(F.shiftright(x, _PLACES).alias("h"), x.bitwiseAND(F.lit((1 << _PLACES) - 1)).cast("int").alias("at")))
    long, short = let(_pairs(h, k), least), opened(let(_pack(h, k), least))
    return F.when(F.size(h) < config.window, F.array().cast(_PRINT)).when(F.size(h) < 1 << _PLACES, short).otherwise(long)


_SIZED = "array<struct<h:bigint,at:int,size:int>>"


def _sized(prints: Column, m: int) -> Column:
    """Fingerprints for windows of m words. The size is hashed too, so that lengths don't mix."""
    return F.transform(prints, lambda x: F.struct(F.xxhash64(x["h"], F.lit(m)).alias("h"), x["at"].cast("int").alias("at"), F.lit(m).alias("size"))).cast(_SIZED)


def fingerprints(text: Column, lengths: list[int], config: Winnow) -> Column:
    """Array of (h, at, size): a text's fingerprints, and for the lengths of short items all its m-grams."""

    def every(h: Column, m: int) -> Column:
        return F.when(F.size(h) < m, F.array().cast(_PRINT)).otherwise(_pairs(h, m))

    return let(_word_hashes(words(text)), lambda h: F.concat(_sized(_winnowed(h, config), config.window), *(_sized(every(h, m), m) for m in lengths)))


def _grams(w: Column, starts: Column, size: Column) -> Column:
    """Of each start the `size` words from there on, as text."""
    return F.transform(starts, lambda j: F.struct(j.alias("at"), F.array_join(F.slice(w, j + 1, size), " ").alias("gram")))


def _small(df: DataFrame, tag: str, size: Column, config: Winnow) -> DataFrame:
    """df, written, and marked for a broadcast if its rows' sizes add up to few bytes."""
    df = written(df, tag)
    held = df.agg(F.sum(size.cast("long") + 32)).first()[0] or 0
    return F.broadcast(df) if held <= config.broadcast_bytes else df


def _candidates(docs: DataFrame, items: DataFrame, key: str, text: str, lengths: list[int], config: Winnow) -> DataFrame:
    """(key, found): for each document with a fingerprint of some item, the item, its window's size and where a window may begin.

    One scan gives a document's fingerprints and, for the lengths of short items, all its m-grams.
    """
    body = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    opened = body.select("key", F.explode(fingerprints(F.col("text"), lengths, config)).alias("x")).select("key", "x.*")
    # A short item is its own only window and fingerprint.
    own = items.select(F.xxhash64("item").alias("name"), F.size("v").alias("n"), F.explode(fingerprints(F.col("text"), lengths, config)).alias("x"))
    own = own.where(F.col("x.size") == F.least("n", F.lit(config.window)))
    sought = _small(own.select("name", "x.h").distinct(), "item-prints", F.lit(16), config)
    # A place meets an item once, however often the item repeats the fingerprint.
    hits = opened.join(sought, "h").select("key", "name", "at", "size").distinct()
    first = F.when(F.col("size") == config.window, F.greatest(F.col("at") - (config.window - config.k), F.lit(0))).otherwise(F.col("at"))
    starts = F.array_distinct(F.flatten(F.collect_set(F.sequence(first, F.col("at")))))
    by_item = hits.groupBy("key", "name", "size").agg(starts.alias("starts"))
    return by_item.groupBy("key").agg(F.collect_list(F.struct("name", "size", "starts")).alias("found"))


def _hits(docs: DataFrame, items: DataFrame, key: str, text: str, lengths: list[int], config: Winnow) -> DataFrame:
    """(key, n_hit, items) of the documents with a hit: candidates extended to whole windows and compared as text."""
    found = written(_candidates(docs, items, key, text, lengths, config), "candidates")
    held = _small(found.select("key"), "candidate-keys", F.lit(8), config)
    # Only texts with a candidate move; equal rows are one.
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(held, "key", "left_semi").dropDuplicates(["key"])
    opened = let(words(F.col("text")), lambda w: F.flatten(F.transform("found", lambda x: F.transform(_grams(w, F.filter(x["starts"], lambda j: j + x["size"] <= F.size(w)), x["size"]), lambda g: F.struct(x["name"].alias("name"), x["size"].alias("size"), g["at"].alias("at"), g["gram"].alias("gram"))))))
    asked = texts.join(found, "key").select("key", F.explode(opened).alias("x")).select("key", "x.*")
    size = F.least(F.size("v"), F.lit(config.window))
    own = items.select("item", F.explode(let(F.col("v"), lambda v: _grams(v, F.sequence(F.lit(0), F.size(v) - size), size))).alias("x"))
    own = _small(own.select("item", F.xxhash64("item").alias("name"), "x.gram").distinct(), "item-windows", F.octet_length("gram") + F.octet_length("item"), config)
    hits = asked.join(own, ["name", "gram"]).groupBy("key").agg(F.collect_set(F.struct("at", "size")).alias("windows"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1))))
    return hits.select("key", F.size(covered).cast("long").alias("n_hit"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, config: Winnow = Winnow(), key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """docs with n_words, n_hit (words within an occurring window) and items (ids as sorted strings)."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED))
    own, hit, which = (free_name(docs, x) for x in ("key", "hit", "which"))
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"), words(F.col(text)).alias("v")).where(F.size("v") > 0)
    lengths = sorted(r[0] for r in items.where(F.size("v") < config.window).select(F.size("v")).distinct().collect())  # fewer than `window`
    keyed = docs.withColumn(own, F.xxhash64(key, text))
    found = _hits(keyed, items, own, text, lengths, config).select(F.col("key").alias(own), F.col("n_hit").alias(hit), F.col("items").alias(which))
    found = _small(found, "hits", F.aggregate(which, F.lit(8), lambda n, x: n + F.octet_length(x) + 8), config)
    # Words are counted before the join, so that a text moves only if it is asked for.
    counted = keyed.withColumn("n_words", F.coalesce(F.size(F.array_remove(F.split(text, BREAK_UNFOLDED), "")), F.lit(0)).cast("long"))
    out = counted.join(found, own, "left")
    return out.select(*docs.columns, "n_words", F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce(which, F.array().cast("array<string>")).alias("items"))
