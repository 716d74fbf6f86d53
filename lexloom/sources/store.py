"""Tables that are written in batches and changed by key, without a server.

Batches: a row's batch follows from its key, so a key always meets the same batch. A batch is
one folder, which Spark's committer marks when it is whole; these marks are the log. A run
that is started again skips whole batches and writes the others anew, so no row is there
twice and no earlier row has to be looked up.

Versions: rows lie in buckets by key. A change writes the touched buckets' new rows beside the
old ones and then a manifest, which names the folder of each bucket. A manifest is made only
if it isn't there yet: of two writers one gets the version, and the other starts again from
the new state. Readers see one manifest, whole.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What messages of failures say that a later attempt may not meet.
TRANSIENT = ["database is locked", "resource temporarily unavailable", "connection reset", "temporarily unavailable", "timed out", "timeout", "i/o error", "io error"]
#: Attempts at a batch, and the longest wait between them in seconds.
ATTEMPTS, LONGEST_WAIT = 3, 20


def is_transient(error: BaseException) -> bool:
    return any(t in str(error).lower() for t in TRANSIENT)


def wait_before(attempt: int) -> int:
    """Seconds to wait after so many attempts."""
    return min(LONGEST_WAIT, 2**attempt)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


# ---- batches ----------------------------------------------------------------------


def batch_log(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the batches that are whole."""
    return sorted(int(n.removeprefix("batch=")) for n in _names(spark, table) if n.startswith("batch=") and exists(spark, f"{table}/{n}/_SUCCESS"))


def store_batches(rows: DataFrame, table: str, key: str, batches: int, *, write: Callable[[DataFrame, str], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> list[int]:
    """Writes rows, one for each key that isn't null, in so many batches, and returns the
    numbers of those that it wrote. Transient failures are tried again after a wait; any
    other ends the run, which may be started again. A table keeps its number of batches."""
    spark = rows.sparkSession
    write = write or (lambda df, path: df.write.mode("overwrite").parquet(path))
    done, wrote = set(batch_log(spark, table)), []
    numbered = rows.where(F.col(key).isNotNull()).withColumn("_batch", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches)))
    for n in (n for n in range(batches) if n not in done):
        own = numbered.where(F.col("_batch") == n).drop("_batch").dropDuplicates([key])
        for attempt in range(1, ATTEMPTS + 1):
            try:
                write(own, f"{table}/batch={n}")
                break
            except Exception as e:
                if not is_transient(e) or attempt == ATTEMPTS:
                    raise RuntimeError(f"batch {n} of {batches}: {e}") from e
                sleep(wait_before(attempt))
        wrote.append(n)
    return wrote


def stored(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of whole batches; None before the first."""
    done = batch_log(spark, table)
    return spark.read.parquet(*[f"{table}/batch={n}" for n in done]) if done else None


# ---- changes by key -----------------------------------------------------------------


def applied(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, version, sums, conflicts): state (key, version, value) after changes (key, base,
    delta). A change holds the version that it was made on and applies to that one only, as
    the next; one made on another version is a conflict and does nothing. So changes that
    come again do nothing, and a gap stops those behind it. Keys without a state begin at
    version 0 with 0. Of changes of one base the smallest delta counts, others are conflicts."""
    one = changes.where(F.col(key).isNotNull()).groupBy(key, "base").agg(F.min("delta").alias("delta"), F.count(F.lit(1)).alias("n"))
    x = one.join(state.select(key, "version"), key, "left").withColumn("version", F.coalesce("version", F.lit(0).cast("long")))
    x = x.withColumn("place", F.row_number().over(W.partitionBy(key, F.col("base") >= F.col("version")).orderBy("base")) - 1)
    good = (F.col("base") >= F.col("version")) & (F.col("base") == F.col("version") + F.col("place"))
    moved = x.groupBy(key).agg(F.count_if(good).alias("steps"), F.coalesce(F.sum(F.when(good, F.col("delta"))), F.lit(0)).alias("add"), (F.sum("n") - F.count_if(good)).alias("conflicts"))
    out = state.join(moved, key, "full")
    zero = F.lit(0).cast("long")
    return out.select(
        key, (F.coalesce("version", zero) + F.coalesce("steps", zero)).alias("version"), (F.coalesce("value", zero) + F.coalesce("add", zero)).alias("value"), F.coalesce("conflicts", zero).alias("conflicts")
    )


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Versions:
    """A table of (key, version, value) that is changed by key, with all its versions."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in _names(self.spark, f"{self.path}/_manifest") if n.endswith(".json") and n[0] != ".")

    def current(self) -> int:
        """The last version; 0 is the empty table."""
        return max(self._numbers(), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if version == 0:
            return {}
        rows = self.spark.read.option("wholetext", "true").text(f"{self.path}/_manifest/{version}.json").collect()
        return json.loads(rows[0]["value"])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        own = self._manifest(self.current() if version is None else version)
        schema = f"{self.key} STRING, version LONG, value LONG"
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in own.values()])

    def _commit(self, version: int, manifest: dict[str, str]) -> None:
        fs, p = _fs(self.spark, f"{self.path}/_manifest/{version}.json")
        hidden = p.getParent().suffix(f"/.{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        # A rename fails where the name is taken, so a manifest appears once and whole.
        if fs.exists(p) or not fs.rename(hidden, p):
            fs.delete(hidden, False)
            raise Conflict(f"version {version} is there already")

    def change(self, changes: DataFrame, *, attempts: int = 5) -> tuple[int, int]:
        """Applies changes (key, base, delta) and returns the version and the number of
        conflicts among the changes. Only buckets with a change are written again. Changes
        that change nothing make no version."""
        from lexloom.sources.tables import materialized

        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        own = materialized(changes.select(F.col(self.key).cast("string").alias(self.key), "base", "delta").withColumn("_b", bucket), "changes")
        touched = sorted(r["_b"] for r in own.select("_b").distinct().collect())
        for attempt in range(1, attempts + 1):
            at = self.current()
            manifest = self._manifest(at)
            old = [f"{self.path}/{manifest[str(b)]}" for b in touched if str(b) in manifest]
            schema = f"{self.key} STRING, version LONG, value LONG"
            state = self.spark.read.schema(schema).parquet(*old) if old else self.spark.createDataFrame([], schema)
            new = materialized(applied(state, own.drop("_b"), self.key), "state")
            conflicts = new.agg(F.sum("conflicts")).first()[0] or 0
            if conflicts == own.count():
                return at, conflicts
            folder = f"data/{at + 1}-{uuid.uuid4().hex}"
            new.drop("conflicts").withColumn("_b", bucket).repartition("_b").write.partitionBy("_b").parquet(f"{self.path}/{folder}")
            try:
                self._commit(at + 1, manifest | {str(b): f"{folder}/_b={b}" for b in touched})
                return at + 1, conflicts
            except Conflict:
                if attempt == attempts:
                    raise
        raise AssertionError("unreachable")
