"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. Defined cases are those of the operators. Ids and other columns may have any
type. Stages that drop rows know a row by its id and its text, so rows without an id are
judged like others, and rows that share an id each for itself. Of rows alike in both
near-dedup keeps one, as of any group that it links; those without words it doesn't link
and keeps, as it keeps rows alike only in the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from lexloom.llm._common import written

#: The stages hold models, signatures and alignments: SQL can't express them.
ORACLE_SQL = None


def _row(docs: DataFrame) -> Column:
    """A row's id and text as bytes in the order of the ids; rows without an id come last.
    Whole numbers become 8 bytes in their order, other ids the bytes of their text."""
    c, kind = F.col("doc_id"), docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        # The sign's bit turned, so that negative numbers come first.
        own = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        own = F.concat(F.hex(F.encode(c.cast("string"), "UTF-8")), F.lit("00"))
    text = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))]
    return F.unhex(F.concat(F.when(c.isNull(), "FF").otherwise(F.concat(F.lit("01"), own)), *text))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score_quality(docs, quality.fit(docs))
    return scored.where("quality_kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text."""
    cut = line_dedup.drop_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies."""
    keyed = docs.withColumn("_lexloom_row", _row(docs))
    groups = near_dedup.near_groups(keyed, id_col="_lexloom_row").groupBy(F.col("id").alias("_lexloom_row"))
    rows = groups.agg(F.bool_or(~F.col("kept")).alias("_lexloom_gone"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("k"))
    # Only these matter: rows that go, and those that come more than once.
    marked = keyed.join(rows.where("_lexloom_gone OR (n > 1 AND k > 0)").drop("n", "k"), "_lexloom_row", "left")
    once = marked.where("_lexloom_gone IS NULL")
    again = marked.where("NOT _lexloom_gone").dropDuplicates(["_lexloom_row"])
    return once.unionByName(again).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    keyed = docs.withColumn("_lexloom_row", F.hex(_row(docs)))
    leaks = decontaminate.find_leaks(keyed, items, id_col="_lexloom_row").select(F.col("doc_id").alias("_lexloom_row")).distinct()
    return keyed.join(leaks, "_lexloom_row", "left_anti").select(*docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): token ids, and whether they decode to the text."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # Written between, so that no more than two of these steps' workers are alive at a time.
    ids = written(bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN), "ids")
    coded = bpe.decode(ids, ranks)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "ids", "n_tokens", same.alias("round_trip"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", decontaminated),
    ("bpe", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
