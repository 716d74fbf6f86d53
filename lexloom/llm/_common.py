"""Helpers shared by the corpus operators: shared storage, row keys, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python: both sides hold a batch outside the
#: heap, and long texts make large batches.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20

_written: dict[str, list[str]] = {}


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for the rest of the session: plans read the setting when they
    run, which is after an operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which spark.checkpoint.dir names; in local mode a
    temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/") + "/lexloom"


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back, so later
    stages don't depend on shuffle files of lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables made by written() that no plan reads any more."""
    for df in frames:
        path = getattr(df, "_lexloom_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[df.sparkSession.sparkContext.applicationId].remove(path)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _written.pop(spark.sparkContext.applicationId, []):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone
            return


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Name a row by what it holds, not by where it lies: recomputed tasks give the same
    keys. Two hashes, as one of 64 bits isn't unique in ten billion rows. Repeated rows
    get the same keys and therefore the same result each."""
    return F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))


def parallel(spark: SparkSession) -> int:
    """Partitions for a keyed exchange."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (vectorised)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def add_columns(docs: DataFrame, inputs: list[str], fn, outputs: dict[str, str], without: tuple[str, ...] = ()) -> DataFrame:
    """docs with columns made by fn, an Arrow batch at a time. fn gets the input columns
    as lists and returns one list for each output. An output replaces a column of docs
    with the same name, whatever its case; all others but those of ``without`` pass
    through as they are."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = {c.lower() for c in (*outputs, *without)}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema = StructType(kept + _parse_datatype_string(", ".join(f"{c} {t}" for c, t in outputs.items())).fields)
    names, n_kept = [f.name for f in kept], len(kept)

    def run(batches):
        target = to_arrow_schema(schema)
        for b in batches:
            made = fn(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs])
            old = [b.column(b.schema.get_field_index(c)) for c in names]
            fields = [pa.field(c, x.type) for c, x in zip(names, old, strict=True)] + list(target)[n_kept:]
            old += [pa.array(x, type=f.type) for x, f in zip(made, list(target)[n_kept:], strict=True)]
            yield pa.RecordBatch.from_arrays(old, schema=pa.schema(fields))
        # Workers stay for later tasks; what batches took must not stay with them.
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def column_of(docs: DataFrame, name: str) -> str:
    """The column's name as docs spell it."""
    return next(c for c in docs.columns if c.lower() == name.lower())


def hash_below(text: Column, share: Column) -> Column:
    """Whether a text's hash lies in the lowest share of all hashes: the same texts in any
    partitioning, chosen without bringing rows together."""
    return F.xxhash64(text) / F.lit(2.0**64) + 0.5 < share


def share_for(least: int, distinct: int) -> float:
    """Share of all hashes that holds about four times ``least`` of so many distinct texts;
    the 60 more keep it from holding fewer where ``least`` is small."""
    return (4.0 * least + 60) / max(1, distinct)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents table, over as many tasks as there are cores if its files
    have fewer splits."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a key that one task of spread_join takes.
KEY_ROWS = 1 << 16


def spread_join(big: DataFrame, small: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """big joined with small, which has each key once and in ``n`` how many rows of big it
    meets. Keys of many rows are dealt to several tasks, to which small's row is copied.
    total: rows of big; at most KEY_ROWS keys are heavy, so their list can be broadcast."""
    key = [key] if isinstance(key, str) else key
    each = max(KEY_ROWS, total // KEY_ROWS)
    heavy = small.where(F.col("n") > each).select(*key, F.ceil(F.col("n") / each).cast("int").alias("_parts"))
    dealt = big.join(F.broadcast(heavy), key, "left").withColumn("_part", F.pmod(F.xxhash64(*big.columns), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / each).cast("int") - 1))))
    return dealt.join(copies, [*key, "_part"]).drop("_part", "n")
