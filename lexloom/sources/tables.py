"""Readers and writers: page files, JSON lines, CSV, tables, resumable and keyed writes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length) of files below a folder, none from archived folders; contents aren't
    read until they are selected."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.where(~F.col("path").rlike("(?i)/archived/"))


def checked_uploads(files: DataFrame, limit: int = 20 << 20) -> DataFrame:
    """path, checksum, and why a file is refused (null if it isn't)."""
    why = F.when(~F.lower("path").endswith(".pdf"), "suffix").when(F.col("length") > limit, "size").when(F.substring("content", 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), "magic")
    return files.select("path", F.sha2("content", 256).alias("checksum"), why.alias("refused"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines). Blank lines count as neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    broken = F.try_parse_json("value").isNull()
    return parsed.where(~broken).select("r.*"), parsed.where(broken).select("value")


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of .jsonl, .json (a list, or an object with rows), .csv or .parquet."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        return read_json_lines(spark, path, schema)[0]
    if kind == "json":
        whole = spark.read.option("wholetext", "true").text(path)
        one = spark.createDataFrame([], schema).schema.simpleString()
        is_list = F.regexp_like("value", F.lit(r"^\s*\["))
        rows = F.when(is_list, F.from_json("value", f"array<{one}>")).otherwise(F.from_json("value", f"struct<rows:array<{one}>>")["rows"])
        return whole.select(F.inline(rows))
    if kind == "csv":
        return spark.read.option("header", "true").schema(schema).csv(path)
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unsupported suffix: {path}")


def coalesced_key(*names: str) -> Column:
    """The first of several names of a key that a row has."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names])


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def pending(expected: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows still to be written."""
    return expected.join(existing.select(key), key, "left_anti")


def unexpected(expected: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Ids that stand in the store and weren't expected."""
    return existing.select(key).join(expected.select(key), key, "left_anti")


def write_partitioned(df: DataFrame, path: str, by: str, order: str, mode: str = "overwrite") -> None:
    """A table whose files hold one partition value each, sorted, so that filters on both
    columns prune files and row groups. Spark splits what a hot value gathers."""
    df.hint("rebalance", by).sortWithinPartitions(by, order).write.mode(mode).partitionBy(by).parquet(path)


def kept_rows(store: DataFrame, gone: Column) -> DataFrame:
    """The rows that a deletion by predicate leaves: those for which it is false or null."""
    return store.where(~F.coalesce(gone, F.lit(False)))


def repeats(store: DataFrame, key: list[Column | str], id_col: str = "id") -> DataFrame:
    """Ids of the rows whose key a row of a smaller id has: what deduplication deletes. Keys
    that occur once leave after the partial sums."""
    k = [F.struct(*key).alias("_key")]
    first = store.select(*k, id_col).groupBy("_key").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return store.select(*k, id_col).join(first.select("_key", "_first"), "_key").where(F.col(id_col) > F.col("_first")).select(id_col)


def delete_rows(spark: SparkSession, path: str, to: str, gone: Column) -> int:
    """Writes what a deletion leaves of the table at path to another path, which readers
    are pointed at once it is whole, and tells how many rows went."""
    store = spark.read.parquet(path)
    kept_rows(store, gone).write.parquet(to)
    return store.count() - spark.read.parquet(to).count()


def delete_repeats(spark: SparkSession, path: str, to: str, key: list[Column | str], id_col: str = "id") -> int:
    """The same for rows that repeat the key of an earlier one."""
    store = spark.read.parquet(path)
    store.join(repeats(store, key, id_col), id_col, "left_anti").write.parquet(to)
    return store.count() - spark.read.parquet(to).count()


def reset(df: DataFrame, path: str) -> int:
    """Drops and recreates the table at path with df's columns and no row, and tells how
    many rows it holds: 0, or the reset failed."""
    df.limit(0).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


#: Rows and bytes of an Arrow batch handed to Python, which holds it several times over.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for the rest of the session, as plans read the setting when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Tasks a core, at least, over which long rows are dealt.
DEALT = 4


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df over enough tasks of even size: files give few splits and uneven ones, as row groups
    aren't split. The key tells rows apart, so that none of its values gathers many."""
    n = max(DEALT * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(n, *key)


_written: dict[str, list[str]] = {}


@atexit.register
def _clean() -> None:
    """Deletes what materialized() wrote, while its session is there."""
    spark = SparkSession.getActiveSession()
    for path in _written.pop(spark.sparkContext.applicationId, []) if spark is not None else ():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may already be gone
            return


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that all executors share, and read back: what several parts
    of a plan need is computed once, and survives the loss of an executor."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/lexloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)
