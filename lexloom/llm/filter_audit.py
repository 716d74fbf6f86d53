"""Filter interaction audit: what each filter removes, in every order of the filters.

1. Each document becomes a mask, a bit for each filter that it fails.
2. Documents of one part and mask are one cell with three counts (all, good, toxic): no more
   cells than 2^filters a part, whatever the number of documents.
3. Cells are unpivoted against the steps of all orders. Along an order a running bit-or of the
   cell's failures, up to the step before, tells whether an earlier filter has removed it.
4. Conditional sums by part, order and step give a step's counts; windows over a part's rows
   of one filter add up what it removes over all orders.

Defined cases: null texts are empty, null parts are the empty string; rows without an id
have no labels, and no text counts as an earlier copy of theirs nor theirs as one of
others; rows alike in id and text aren't copies of each other; several labels of an id
count as good or toxic if one of them says so; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm._common import column_of, documents
from lexloom.llm.exact_dedup import copies, digests

#: The text filters of the contract; the fifth, E, needs the other texts.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a non-null text."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    # The words are made once a text: both conditions read one struct.
    sizes = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    return {
        "words": sizes,
        "A": F.col("words.n") < LEAST_WORDS,
        "B": 100 * F.col("words.d") < DISTINCT_PERCENT * F.col("words.n"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        "D": F.rlike(text, F.lit(MARKS)),
    }


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A to E): which filters each document fails."""
    text = F.coalesce(F.col(column_of(docs, text_col)), F.lit(""))
    part = F.coalesce(F.col(column_of(docs, part_col)).cast("string"), F.lit(""))
    made = text_failures(F.col("_t"))
    own = docs.select(F.col(column_of(docs, id_col)).alias("_id"), part.alias("part"), text.alias("_t")).withColumn("words", made.pop("words"))
    rows = digests(own, F.col("_t"), "_id", "part", *[c.alias(k) for k, c in made.items()])
    return copies(rows).select("id", "part", *made, F.coalesce(F.col("first_id") < F.col("id"), F.lit(False)).alias("E"))


def audit(failed: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, counts): failed has id, part and a boolean column for each
    filter; labels has doc_id, quality and toxic."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    mask = sum((F.when(F.col(f), b).otherwise(0) for f, b in bit.items()), F.lit(0))
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).cast("long").alias(c) for c in ("quality", "toxic")])
    # Documents before their labels: most have none, so counts are made apart and added up.
    masked = failed.select("id", "part", mask.alias("mask"))
    labelled = masked.join(flags, "id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad"))
    every = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))
    cells = every.unionByName(labelled).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    long = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("i", "filter"))
    long = long.withColumn("step", F.col("i") + 1).withColumn("fails", F.col("mask").bitwiseAND(F.element_at(F.create_map(*[F.lit(x) for kv in bit.items() for x in kv]), F.col("filter"))))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    here, gone = (F.col("fails") > 0) & (F.col("earlier") == 0), F.col("earlier") > 0

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), F.lit(0)).cast("long")

    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total("n", ~gone & (F.col("fails") == 0)).alias("kept"), total("n", here).alias("removed"), total("n", gone & (F.col("fails") > 0)).alias("redundant"),
        total("n", (F.col("fails") > 0) & (F.col("mask") == F.col("fails"))).alias("unique_fails"), total("good", here).alias("good_lost"), total("bad", here).alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter"))).drop("filter")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit(failures(docs), labels)


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
         regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(string_split('ABCDE', '')) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, filter_order[step] AS filter, list_transform(string_split(filter_order[1 : step - 1], ''), lambda c: ascii(c) - 64) AS earlier
      FROM o, range(1, 6) r(step)),
m AS (
  SELECT part, filter_order, step, filter, n, good, toxic, fails[ascii(filter) - 64] AS own, len(list_filter(fails, lambda y: y)) AS many,
         step > 1 AND len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone FROM d, s),
g AS (
  SELECT part, filter_order, step, any_value(filter) AS filter, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g
"""
