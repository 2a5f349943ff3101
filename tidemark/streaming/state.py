"""What a run knows of its partitions, kept small: a mark for each partition and the records that hold it up.

A step (a micro-batch, a replay, a correction) takes the state before it and its own rows, and nothing
older, so its cost doesn't grow with the length of the run. A step that is run again replaces what its earlier
try left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["topic", "part"]
ROW = "topic string, part int, off long, k string, v string, bytes long, status string, resolution string, attempts int, last_error string"
COUNTERS = ("processed", "failed", "skipped", "retries", "dlq_ok", "dlq_failed", "partition_failures")
MARK = "topic string, part int, base long, committable long, highest long, " + ", ".join(f"{c} long" for c in COUNTERS)
_NAMES = [x.split()[0] for x in ROW.split(", ")]


def counted(rows: DataFrame, dead_letters: bool) -> DataFrame:
    """Each partition's counters over new outcome rows. With a dead-letter handler, a fallback means that it failed."""
    got = lambda *r: F.count_if(F.col("resolution").isin(*r))
    return rows.groupBy(*KEYS).agg(
        F.min("off").alias("first"), F.max("off").alias("last"), got("SUCCESS").alias("processed"), got("FAIL_PARTITION").alias("failed"), got("SKIP", "HOOK_SKIP").alias("skipped"),
        F.coalesce(F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(0)).cast("long").alias("retries"), got("DLQ_SUCCESS").alias("dlq_ok"),
        (got("SKIP", "FAIL_PARTITION") if dead_letters else F.lit(0)).cast("long").alias("dlq_failed"), got("FAIL_PARTITION").alias("partition_failures"),
    )


def advanced(marks: DataFrame, held: DataFrame, rows: DataFrame, dead_letters: bool, corrected: bool = False) -> tuple[DataFrame, DataFrame]:
    """The state (marks, held) after new rows. held: the records from each partition's first open one on.

    A correction isn't an outcome and leaves the counters alone.
    """
    tagged = held.select(*_NAMES, F.lit(0).alias("new")).unionByName(rows.select(*_NAMES, F.lit(1).alias("new")))
    latest = tagged.groupBy(*KEYS, "off").agg(F.max_by(F.struct(*_NAMES), "new").alias("x")).select("x.*")
    opened = latest.groupBy(*KEYS).agg(F.min(F.when(F.col("status") != "DONE", F.col("off"))).alias("first_open"))
    latest = latest.join(opened, KEYS)
    ahead = F.col("first_open").isNull() | (F.col("off") < F.col("first_open"))
    passed = latest.groupBy(*KEYS).agg((F.max(F.when(ahead, F.col("off"))) + 1).alias("passed"))
    left = latest.where(~ahead)
    left = left.withColumns({c: F.when(F.col("status") != "DONE", F.col(c)) for c in "kv"}).select(*_NAMES)
    new = counted(rows, dead_letters)
    if corrected:
        new = new.withColumns({c: F.lit(0).cast("long") for c in COUNTERS})
    both = marks.join(new.select(*KEYS, "first", "last", *(F.col(c).alias(f"new_{c}") for c in COUNTERS)), KEYS, "full").join(passed, KEYS, "left")
    out = both.select(
        *KEYS, F.coalesce("base", "first").alias("base"), F.coalesce("passed", "committable").alias("committable"), F.greatest("highest", "last").alias("highest"),
        *((F.coalesce(c, F.lit(0)) + F.coalesce(f"new_{c}", F.lit(0))).alias(c) for c in COUNTERS),
    )
    return out, left


class Store:
    """Numbered states under a folder; the last two are kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _steps(self) -> list[tuple[int, str]]:
        """(number, name) of the steps that were written whole."""
        if not self.files.exists(self.path):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self.path)]
        found = [(int(n.split(".", 1)[0]), n.split(".", 1)[1]) for n in names]
        return sorted(x for x in found if self.files.exists(self._at(*x, "marks/_SUCCESS")))

    def _at(self, number: int, name: str, child: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number:012d}.{name}/{child}".rstrip("/"))

    def _read(self, step: tuple[int, str] | None) -> tuple[DataFrame, DataFrame]:
        if step is None:
            return self.spark.createDataFrame([], MARK), self.spark.createDataFrame([], ROW)
        at = self._at(*step).toString()
        return self.spark.read.schema(MARK).parquet(f"{at}/marks"), self.spark.read.schema(ROW).parquet(f"{at}/held")

    def latest(self) -> tuple[DataFrame, DataFrame]:
        steps = self._steps()
        return self._read(steps[-1] if steps else None)

    def before(self, name: str) -> tuple[DataFrame, DataFrame]:
        """The state that the step of this name starts from."""
        steps = [x for x in self._steps() if x[1] != name]
        return self._read(steps[-1] if steps else None)

    def write(self, name: str, marks: DataFrame, held: DataFrame) -> None:
        steps = self._steps()
        number = next((n for n, x in steps if x == name), steps[-1][0] + 1 if steps else 0)
        at = self._at(number, name).toString()
        held.write.mode("overwrite").parquet(f"{at}/held")
        marks.write.mode("overwrite").parquet(f"{at}/marks")  # last: its success marks the step as whole
        for old in steps[:-2]:
            self.files.delete(self._at(*old), True)
