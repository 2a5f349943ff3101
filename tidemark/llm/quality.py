"""Quality classifier from weak labels.

1. Heuristic labellers each vote good, bad or nothing on every document.
2. Expectation-maximisation over the counts of vote patterns, at most 3 ^ labellers rows from all
   documents, estimates each labeller's accuracy for both classes and the posterior of each pattern.
3. The posteriors of a bounded sample (`train_rows`, those of least id hash) train a linear scorer on
   hashed features; where labels are given, their toxic column trains a second one on as many rows.
4. One pass scores every document: keep means good quality and not toxic.

Defined results: null, empty and wordless texts get no votes, quality 0 and keep false; rows that
repeat are scored each; without labels, or with one kind of label only, toxicity is 0; labels of null, unknown or repeated ids are
harmless; an empty table gives no rows; columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U, Words, distinct, grams, mix, slices, spans, words

ADDED = ("quality", "toxicity", "keep")


@dataclass(frozen=True)
class Quality:
    train_rows: int = 12_000  # the bound on rows that either scorer learns from
    bits: int = 18  # of a feature's hash
    epochs: int = 12
    em_rounds: int = 60
    least: float = 0.5
    most_toxic: float = 0.6
    chunk_bytes: int = 1 << 20


#: Common short words of the languages, and bytes that prose seldom has.
COMMON = "the of and to in is it that for on with as der die und den das von zu ist nicht la le de et les des un une que el los en y su por con del se".split()
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*|!@^~<>{}[]\\=+_/"]] = True
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True

FEW = 30
#: Each labeller's statistic, and the ranges in which it votes good (1) or bad (0); else it abstains.
LABELLERS = (
    ("symbols", lambda x: x < 0.02, lambda x: x > 0.06),  # share of the bytes in words
    ("capitals", lambda x: x < 0.12, lambda x: x > 0.35),  # share of the ASCII letters
    ("distinct", lambda x: x > 0.45, lambda x: x < 0.3),  # words, all but one of a kind counted once
    ("common", lambda x: x > 0.08, lambda x: x < 0.03),  # share of the words
    ("length", lambda x: (x > 4) & (x < 6), lambda x: (x < 3.2) | (x > 7.5)),  # bytes a word
    ("again", lambda x: x < 0.03, lambda x: x > 0.15),  # share of words that repeat the word before
    ("pairs", lambda x: x > 0.6, lambda x: x < 0.45),  # distinct among pairs of neighbours
    ("stops", lambda x: (x > 0.02) & (x < 0.3), lambda x: x > 0.45),  # share of words that end a sentence
)


def _common() -> np.ndarray:
    return np.sort(words(pa.array([" ".join(COMMON)]), True).hashes)


def statistics(column: pa.Array) -> tuple[Words, np.ndarray]:
    """The words in lower case, and the labellers' statistics: a row each, NaN where there are no words."""
    w, raw = words(column, True), words(column, False)
    n, rows = np.diff(w.first), len(w.first) - 1
    size = w.end - w.start

    def total(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))[w.first])

    def inside(flag: np.ndarray) -> np.ndarray:
        """Bytes of each word with the flag."""
        sums = np.concatenate(([0], np.cumsum(flag)))
        return sums[w.end] - sums[w.start]

    upper = (raw.data >= 65) & (raw.data <= 90)
    letters = (w.data >= 97) & (w.data <= 122)
    with np.errstate(divide="ignore", invalid="ignore"):
        row = w.row_of()
        order = np.lexsort((w.hashes, row))
        h, r = w.hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        kinds = np.bincount(r[new], minlength=rows)
        two, offset = grams(w, 2)
        pair_row = np.repeat(np.arange(rows), np.diff(offset))
        pair = distinct((pair_row.astype(np.uint64) << U(44)) | (two >> U(20)))
        pairs = np.bincount((pair >> U(44)).astype(np.int64), minlength=rows)
        same = np.zeros(len(w.hashes))
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
        common = _common()
        at = np.searchsorted(common, w.hashes)
        at[at == len(common)] = 0
        stats = np.stack([
            total(inside(SYMBOLS[w.data])) / total(size),
            total(inside(upper)) / np.maximum(1, total(inside(letters))),
            kinds / n * np.minimum(1, 0.4 + n / 4000 + (n < 2000) * 0.6),
            total(common[at] == w.hashes) / n,
            total(size) / n,
            total(same) / n,
            np.where(n > 1, pairs / np.maximum(1, n - 1), 1.0) * np.minimum(1, 0.5 + n / 4000 + (n < 2000) * 0.5),
            total(STOPS[w.data[w.end - 1]] if len(w.end) else np.zeros(0)) / n,
        ])
    stats[:, n == 0] = np.nan
    # A few words say little of shares among words.
    stats[np.ix_([i for i, x in enumerate(LABELLERS) if x[0] in ("common", "length", "stops", "again")], n < FEW)] = np.nan
    return w, stats


def votes(stats: np.ndarray) -> np.ndarray:
    """(labeller, row): 1 good, 0 bad, 2 no vote."""
    out = np.full(stats.shape, 2, np.int64)
    with np.errstate(invalid="ignore"):
        for i, (_, good, bad) in enumerate(LABELLERS):
            out[i][good(stats[i])] = 1
            out[i][bad(stats[i])] = 0
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(len(v))[:, None]).sum(0)


def expectation_maximisation(counts: dict[int, int], rounds: int) -> dict[int, float]:
    """Posterior of good for each vote pattern. counts: rows by pattern."""
    if not counts:
        return {}
    code, n = np.array(list(counts)), np.array(list(counts.values()), float)
    v = np.stack([code // 3**i % 3 for i in range(len(LABELLERS))])
    cast = (v != 2).sum(0)
    good = np.where(cast > 0, ((v == 1).sum(0) + 0.5) / (cast + 1.0), 0.5)
    for _ in range(rounds):
        prior = float(np.clip((n * good).sum() / n.sum(), 0.01, 0.99))
        logs = np.log([[1 - prior], [prior]]) * np.ones(len(code))
        for i in range(len(v)):
            for c, weight in enumerate((n * (1 - good), n * good)):
                # The counts added beforehand say that a labeller is right more often than not.
                table = np.array([weight[v[i] == x].sum() for x in range(2)]) + (np.array([1.0, 4.0]) if c else np.array([4.0, 1.0]))
                # No vote is no evidence.
                logs[c] += np.append(np.log(table / table.sum()), 0.0)[v[i]]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return dict(zip(code.tolist(), good.tolist()))


def _distinct(row: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index)."""
    packed = distinct((row.astype(np.uint64) << U(bits)) | (feature >> U(64 - bits)))
    return (packed >> U(bits)).astype(np.int64), (packed & U((1 << bits) - 1)).astype(np.int64)


def quality_features(w: Words, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse (row, index, value): words and their last bytes, each kind once, and the labellers' votes."""
    row, rows = w.row_of(), len(w.first) - 1
    ends = spans(w.data, np.maximum(w.start, w.end - 1), w.end) if len(w.end) else w.hashes
    r, f = _distinct(np.concatenate([row, row]), np.concatenate([w.hashes, mix(ends ^ U(1))]), bits)
    share = 1 / np.sqrt(np.maximum(1, np.bincount(r, minlength=rows)))
    marks = mix(np.arange(len(v) * 3, dtype=np.uint64) + U(77)) >> U(64 - bits)
    of_votes = np.tile(np.arange(rows), len(v)), marks.astype(np.int64)[(np.arange(len(v))[:, None] * 3 + v).ravel()]
    return np.concatenate([r, of_votes[0]]), np.concatenate([f, of_votes[1]]), np.concatenate([share[r], np.ones(len(of_votes[0]))])


def toxic_features(w: Words, bits: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse (row, index, 1): words and their first bytes, each kind once; only those with a weight if weights are given."""
    row = w.row_of()
    rows, found = [], []
    for n in (0, 4, 5, 6, 7, 8):
        h = mix(spans(w.data, w.start, np.minimum(w.end, w.start + n)) ^ U(n)) if n else w.hashes
        held = slice(None) if weights is None else weights[(h >> U(64 - bits)).astype(np.int64)] != 0
        rows.append(row[held])
        found.append(h[held])
    r, f = _distinct(np.concatenate(rows), np.concatenate(found), bits)
    return r, f, np.ones(len(r))


def telling(at: list[np.ndarray], label: np.ndarray, bits: int, least: int = 3, z: float = 5.0) -> np.ndarray:
    """Which features far more of the labelled rows hold than chance would give them, and mostly these. at: a row's distinct features."""
    held, hit, share = np.zeros(1 << bits), np.zeros(1 << bits), label.mean() if len(label) else 0.0
    for index, y in zip(at, label):
        held[index] += 1
        hit[index] += y
    return (hit >= least) & (2 * hit > held) & (hit - held * share > z * np.sqrt(held * share * (1 - share) + 1e-9))


def train(row: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, bits: int, epochs: int) -> np.ndarray:
    """Weights, the last one the constant, of a logistic scorer by AdaGrad over small batches in a fixed order."""
    n, w = len(label), np.zeros((1 << bits) + 1)
    if not n:
        return w
    grown = np.full(len(w), 1e-2)
    order = np.argsort(row, kind="stable")
    row, index, value = row[order], index[order], value[order]
    first = np.searchsorted(row, np.arange(n + 1))
    # Both classes weigh the same, unless one is hardly there.
    positive = label.sum()
    heavy = lambda x: min(20.0, n / (2 * max(1e-9, x)))
    weight = label * heavy(positive) + (1 - label) * heavy(n - positive)
    shuffle = np.random.default_rng(7)
    for _ in range(epochs):
        places = shuffle.permutation(n)
        for b in range(0, n, 32):
            rows = places[b : b + 32]
            size = first[rows + 1] - first[rows]
            at = np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            local = np.repeat(np.arange(len(rows)), size)
            z = np.bincount(local, w[index[at]] * value[at], len(rows)) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) * weight[rows]
            used, inverse = np.unique(index[at], return_inverse=True)
            step = np.bincount(inverse, error[local] * value[at], len(used)) + 1e-4 * w[used]
            grown[used] += step**2
            w[used] -= 0.2 * step / np.sqrt(grown[used])
            bias = error.sum()
            grown[-1] += bias**2
            w[-1] -= 0.2 * bias / np.sqrt(grown[-1])
    return w


def score(w: np.ndarray, sparse: tuple, rows: int) -> np.ndarray:
    z = np.bincount(sparse[0], w[sparse[1]] * sparse[2], rows) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sampled(docs: DataFrame, ids: DataFrame, key: str, text: str, config: Quality) -> pa.Table:
    """(id, text) of at most train_rows documents, those among ids of least hash."""
    chosen = ids.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(config.train_rows)
    held = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    return held.join(F.broadcast(chosen), "id", "left_semi")


def _learn(sample: DataFrame, labels: DataFrame, which: int, config: Quality) -> np.ndarray:
    """Trains in one task on the bounded sample. labels: (id, label), or None for the posteriors in `label`."""
    bits, epochs, most = config.bits, config.epochs, 2 * config.train_rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", 1 << 20):
            w, stats = statistics(piece.column("text"))
            sparse = toxic_features(w, bits) if which else quality_features(w, votes(stats), bits)
            order = np.argsort(sparse[0], kind="stable")
            cut = np.searchsorted(sparse[0][order], np.arange(piece.num_rows + 1))
            index, value = sparse[1][order].astype("<i4"), sparse[2][order].astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array([index[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([b"" if which else value[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array(patterns(votes(stats)), pa.int64())],
                names=["id", "at", "value", "pattern"],
            )

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("pattern", "ascending")]).slice(0, most)
        at = [np.frombuffer(x, "<i4") for x in table.column("at").to_pylist()]
        label = table.column("label").to_numpy().astype(float)
        if which:  # every value is 1, and most features tell nothing
            kept = telling(at, label, bits)
            at = [x[kept[x]] for x in at]
            value = np.ones(sum(map(len, at)))
        else:
            value = np.concatenate([np.frombuffer(x, "<f4") for x in table.column("value").to_pylist()]).astype(float)
        row = np.repeat(np.arange(len(at)), [len(x) for x in at])
        w = train(row, np.concatenate(at).astype(np.int64), value, label, bits, epochs)
        if which and label.min() == label.max():  # nothing to tell apart: nothing is toxic
            w[:], w[-1] = 0, -30
        return pa.table({"weights": pa.array([w.astype("<f8").tobytes()], pa.binary())})

    id_type = sample.schema["id"].dataType.simpleString()
    coded = sample.mapInArrow(encode, f"id {id_type}, at binary, value binary, pattern long")
    joined = coded.join(F.broadcast(labels), "id" if "id" in labels.columns else "pattern").select("id", "at", "value", "pattern", F.col("label").cast("double").alias("label"))
    found = joined.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "weights binary").first()
    return np.frombuffer(found["weights"], "<f8") if found else np.zeros((1 << bits) + 1)


def posteriors(docs: DataFrame, text: str, config: Quality) -> dict[int, float]:
    """The posterior of good quality for each vote pattern, from all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", config.chunk_bytes):
            code, n = np.unique(patterns(votes(statistics(piece.column("text"))[1])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["pattern", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern long, n long")
    rows = counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3 ^ labellers
    return expectation_maximisation({r["pattern"]: r["n"] for r in sorted(rows)}, config.em_rounds)


def classify(docs: DataFrame, labels: DataFrame | None, config: Quality = Quality(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with quality and toxicity (0 to 1) and keep. labels: (key, toxic), or None."""
    spark = docs.sparkSession
    good = posteriors(docs, text, config)
    table = spark.createDataFrame(sorted(good.items()) or [(0, 0.5)], "pattern long, label double")
    # Each pattern's documents count as sure as its posterior is.
    weak = _learn(_sampled(docs, docs.select(F.col(key).alias("id")), key, text, config), table, 0, config)
    toxic = np.zeros(0)
    if labels is not None:
        known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max("toxic").alias("label"))
        chosen = known.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(config.train_rows)
        toxic = _learn(_sampled(docs, chosen.select("id"), key, text, config), chosen, 1, config)
    model = spark.sparkContext.broadcast((weak.astype(np.float32), toxic.astype(np.float32)))
    kept = [f for f in docs.schema.fields if f.name.lower() not in ADDED]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("quality", T.DoubleType()), T.StructField("toxicity", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, toxic = model.value
        for piece in slices(batches, text, config.chunk_bytes):
            w, stats = statistics(piece.column(piece.schema.get_field_index(text)))
            rows, some = piece.num_rows, np.diff(w.first) > 0
            q = np.where(some, np.round(score(weak, quality_features(w, votes(stats), config.bits), rows), 6), 0.0)
            t = np.where(some, np.round(score(toxic, toxic_features(w, config.bits, toxic), rows), 6), 0.0) if len(toxic) else np.zeros(rows)
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(names))), pa.array(q), pa.array(t), pa.array((q >= config.least) & (t < config.most_toxic))], names=[*names, *ADDED])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)
