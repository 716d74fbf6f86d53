"""Exact dedup with a split for heavy hitters, of DataFrame expressions alone.

1. Each row becomes its id and a 256-bit digest of its text; texts never travel.
2. Misra-Gries counters (Spark's frequent-items sketch, which is of that family) run over
   64 bits of the digests of each task; the sketches are merged in two steps, as there may be
   many tasks. A sketch of TRACKED items errs by at most 3.5 / (2 * TRACKED) of the rows, which
   is less than 1 / HEAVY_SHARE: no digest of that share is missed.
3. The candidates are counted exactly by their whole digests, which also gives their winners.
   Those that hold at least 1 / HEAVY_SHARE of the rows are broadcast (HEAVY_SHARE rows at
   most, by that share) and decide their copies where these lie, without a shuffle.
4. The remaining digests, whose groups are therefore small against the whole, are shuffled.

Of equal texts the row of the largest id stays; one without an id only where no row of the
group has one. Rows alike in id and text too are told apart by their place in the written
digests, so that exactly one row of each group stays. Defined cases: null counts as an
empty text; ids may have any type with an order; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm._common import column_of, documents, written

#: Counters of a sketch, and the share of all rows from which a digest is heavy.
TRACKED, HEAVY_SHARE = 1 << 14, 1 << 12
#: Sketches are merged by so many tasks first.
MERGES = 256


def normalised(text: Column) -> Column:
    """A-Z as a-z, nothing else; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, text: Column, id_col: str, *more: Column) -> DataFrame:
    """(id, place, digest) and more columns, written: the place of a row doesn't change then."""
    rows = docs.select(F.col(column_of(docs, id_col)).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), *more)
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "digests")


def _heavy(rows: DataFrame) -> DataFrame:
    """(digest, first_id, last, n) of digests of at least 1 / HEAVY_SHARE of all rows."""
    part, item = F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part"), F.xxhash64("digest").alias("item")
    own = rows.select(part, item).groupBy("part").agg(F.expr(f"approx_top_k_accumulate(item, {TRACKED})").alias("s"))
    # By a constant: an empty table has no sketch then.
    top = own.groupBy(F.lit("all")).agg(F.expr("approx_top_k_combine(s)").alias("s")).select(F.expr(f"inline(approx_top_k_estimate(s, {TRACKED}))"))
    # At most TRACKED rows.
    candidates = F.broadcast(top.select("item"))
    counted = ends(rows.withColumn("item", F.xxhash64("digest")).join(candidates, "item", "left_semi"))
    return counted.where((F.col("n") > 1) & (F.col("n") * HEAVY_SHARE >= rows.count()))


def ends(rows: DataFrame) -> DataFrame:
    """(digest, first_id, last, n): smallest id, the row that stays, and size of each group."""
    return rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.max(F.struct("id", "place")).alias("last"), F.count(F.lit(1)).alias("n"))


def copies(rows: DataFrame) -> DataFrame:
    """rows of digests() with first_id, last (id and place of the row that stays) and n of
    their group."""
    heavy = written(_heavy(rows), "heavy")
    # Its number of rows has a bound whatever the input: each holds 1 / HEAVY_SHARE of it.
    split = rows.join(F.broadcast(heavy), "digest", "left")
    light = W.partitionBy("digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    rest = rest.withColumns({"first_id": F.min("id").over(light), "last": F.max(F.struct("id", "place")).over(light), "n": F.count(F.lit(1)).over(light)})
    return split.where("n IS NOT NULL").unionByName(rest)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, keep_id, group_size, kept): one row for each row of docs."""
    rows = digests(docs, normalised(F.col(column_of(docs, text_col))), id_col)
    out = copies(rows)
    kept = F.col("place") == F.col("last.place")
    return out.select("id", "digest", F.col("last.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. A row is known by its id and its
    digest; of rows alike in both, which are few or none, one is taken where they meet."""
    own = {"_lexloom_id": F.col(column_of(docs, id_col)), "_lexloom_digest": F.unhex(F.sha2(normalised(F.col(column_of(docs, text_col))), 256))}
    groups = written(exact_groups(docs, id_col=id_col, text_col=text_col), "groups")
    keyed = groups.select(F.col("id").alias("_lexloom_id"), F.col("digest").alias("_lexloom_digest"), "kept", F.col("id").eqNullSafe(F.col("keep_id")).alias("_same"))
    stay = keyed.where("kept").select("_lexloom_id", "_lexloom_digest")
    both = lambda other: [F.col(f"d.{c}").eqNullSafe(other[c]) for c in own]
    kept = docs.withColumns(own).alias("d").join(stay, both(stay), "left_semi")
    again = keyed.where("_same").groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*own)
    once = kept.alias("d").join(again, both(again), "left_anti")
    twice = kept.alias("d").join(again, both(again), "left_semi")
    return once.unionByName(twice.dropDuplicates([*own])).select(*docs.columns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = exact_groups(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
