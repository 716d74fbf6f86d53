"""Values carried along an order within keys, however many rows a key has.

A window by key sorts all rows of a key in one task. Here rows are dealt to ranges of the
order, each value is carried within its range, and what a range hands on is one row for it
and key: windows run over these rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.sources.tables import materialized


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df written in ranges of the order, with each row's range. Written, so that the ranges,
    whose bounds are sampled, stay the same for all that reads them. Rows equal in the order
    share a range."""
    return materialized(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _window(key: list[str], order: list[str], ahead: bool):
    return W.partitionBy(*key).orderBy(*[F.desc(c) if ahead else F.asc(c) for c in order])


def carried(x: DataFrame, key: list[str], order: list[str], columns: dict[str, str], *, ahead: bool = False, own: bool = False) -> DataFrame:
    """x, which is ranged(), with new columns: the last value that isn't null of the rows
    before in the key (after, if ahead), the row's own included if own. columns: new -> old.
    Keys must not be null and the order must tell a key's rows apart."""
    near = _window(["_range", *key], order, ahead).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    far = _window(key, ["_range"], ahead).rowsBetween(W.unboundedPreceding, -1)
    pick, place = F.min_by if ahead else F.max_by, F.struct(*order)
    last = x.groupBy("_range", *key).agg(*[pick(old, F.when(F.col(old).isNotNull(), place)).alias(new) for new, old in columns.items()])
    heads = last.select("_range", *key, *[F.last(new, ignorenulls=True).over(far).alias(f"_{new}") for new in columns])
    local = x.withColumns({new: F.last(old, ignorenulls=True).over(near) for new, old in columns.items()})
    both = local.join(heads, ["_range", *key])
    return both.withColumns({new: F.coalesce(new, f"_{new}") for new in columns}).drop(*[f"_{new}" for new in columns])


def totals(x: DataFrame, key: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """x, which is ranged(), with new columns: the sum of the old one over the rows before in
    the key. columns: new -> old; a null counts as 0."""
    near = _window(["_range", *key], order, False).rowsBetween(W.unboundedPreceding, -1)
    far = _window(key, ["_range"], False).rowsBetween(W.unboundedPreceding, -1)
    sums = x.groupBy("_range", *key).agg(*[F.sum(old).alias(new) for new, old in columns.items()])
    heads = sums.select("_range", *key, *[F.sum(new).over(far).alias(f"_{new}") for new in columns])
    local = x.withColumns({new: F.sum(old).over(near) for new, old in columns.items()})
    both = local.join(heads, ["_range", *key])
    zero = F.lit(0).cast("long")
    return both.withColumns({new: F.coalesce(new, zero) + F.coalesce(f"_{new}", zero) for new in columns}).drop(*[f"_{new}" for new in columns])


def places(x: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """x, which is ranged(), with each row's place in its key from 1."""
    return totals(x.withColumn("_one", F.lit(1).cast("long")), key, order, {name: "_one"}).withColumn(name, F.col(name) + 1).drop("_one")
