"""Retrieval metrics: per sample, means, percentiles; trace events; predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases by which an answer says that a provision wasn't found.
REJECTIONS = [
    "not found", "does not exist", "doesn't exist", "no provision", "not contain", "not retrieved", "could not find", "unable to find",
    "was not retrieved", "no such section", "no such article",
]


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def resolve_predictions(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """samples (sample_key, sample_id, raw_id) with the prediction of the first of these
    keys that has one; predictions (key, answer), one a key."""
    out = samples
    for i, k in enumerate(("sample_key", "sample_id", "raw_id")):
        p = predictions.select(F.col("key").alias(k), F.col("answer").alias(f"_a{i}"))
        out = out.join(p, k, "left")
    return out.withColumn("answer", F.coalesce("_a0", "_a1", "_a2")).drop("_a0", "_a1", "_a2")


def sample_metrics(retrieved: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """retrieved (sample, pos, unit), expected (sample, units array) -> one row a sample.
    Ranks are over distinct units in order; with nothing expected, hit is true and recall 0."""
    firsts = retrieved.groupBy("sample", "unit").agg(F.min("pos").alias("pos"))
    own = retrieved.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("distinct"))
    units = firsts.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"]).alias("got"))
    x = expected.join(units, "sample", "left").join(own, "sample", "left")
    got, want = F.coalesce("got", F.array().cast("array<string>")), F.col("units")
    top = F.slice(got, 1, k)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    place = F.array_min(F.filter(F.transform(want, lambda u: F.array_position(got, u)), lambda p: p > 0))
    return x.select(
        "sample",
        F.round(share(F.size(F.array_intersect(got, want)), F.size(got)), 6).alias("precision"),
        F.round(share(F.size(F.array_intersect(got, want)), F.size(want)), 6).alias("recall"),
        F.round(share(F.size(F.array_intersect(top, want)), F.size(want)), 6).alias("recall_at_k"),
        F.round(F.coalesce(1.0 / place, F.lit(0.0)), 6).alias("reciprocal_rank"),
        (F.size(F.array_except(want, top)) == 0).alias("hit_at_k"),
        F.round(F.when(F.col("n") > 0, 1 - F.col("distinct") / F.col("n")).otherwise(0.0), 6).alias("duplicate_rate"),
    )


def answer_metrics(contexts: DataFrame, samples: DataFrame) -> DataFrame:
    """contexts (sample, document, kind, number), samples (sample, document, kind, numbers
    array, response) -> one row a sample: whether the expected document was retrieved, all
    expected numbers of it, and whether the answer cites a source. Without an expected
    document or number the first two are false; a null kind stands for any."""
    want = samples.withColumn("numbers", F.array_distinct(F.transform("numbers", F.upper)))
    hit = contexts.join(want.select("sample", F.col("document").alias("d"), F.col("kind").alias("k"), "numbers"), "sample")
    here = F.coalesce(F.col("document") == F.col("d"), F.col("d").isNull())
    number = F.when(here & F.coalesce(F.col("kind") == F.col("k"), F.col("k").isNull()) & F.expr("array_contains(numbers, upper(number))"), F.upper("number"))
    own = hit.groupBy("sample").agg(F.max(F.coalesce(F.col("document") == F.col("d"), F.lit(False))).alias("doc"), F.count_distinct(number).alias("n"))
    x = want.join(own, "sample", "left")
    return x.select("sample", F.coalesce("doc", F.lit(False)).alias("document_accuracy"), ((F.size("numbers") > 0) & (F.coalesce("n", F.lit(0)) == F.size("numbers"))).alias("provision_accuracy"), F.coalesce(F.col("response").rlike(r"\[Source\s+\d+\]"), F.lit(False)).alias("citation_presence"))


def summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Means without NaN, exact linear percentiles, counts: one row a metric."""
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.nanvl(F.col(n).cast("double"), F.lit(None)).alias("value")) for n in names])).alias("m")).select("m.*")
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.count("value").alias("n"))


def channel_metrics(events: DataFrame) -> DataFrame:
    """events (channel, status, latency, accepted) -> one row a channel; blank is unknown."""
    name = F.coalesce(F.nullif(F.trim("channel"), F.lit("")), F.lit("unknown"))
    return events.groupBy(name.alias("channel")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") != "success").alias("failures"), F.round(F.sum("latency"), 3).alias("latency"), F.sum("accepted").cast("long").alias("accepted"))


#: What of a trace's events is read.
EVENT = "array<struct<channel: string, status: string, latency_ms: double, accepted_count: long, raw_count: long, query_index: int>>"


def trace_events(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, malformed): traces (id, trace) hold a retrieval's trace as JSON each, read as a
    variant; its events are one row each, (id, pos, channel, status, latency, accepted, raw,
    query_index). A trace that isn't JSON, or whose events aren't a list, is malformed, as is
    a null one; one without events has none, and a value of another type counts as absent."""
    v = traces.select("id", F.try_parse_json("trace").alias("v"))
    own = v.select("id", F.col("v").isNull().alias("broken"), F.try_variant_get("v", "$.retrieval.events", "variant").alias("raw"), F.try_variant_get("v", "$.retrieval.events", EVENT).alias("events"))
    own = own.withColumn("bad", F.col("broken") | (F.col("raw").isNotNull() & ~F.is_variant_null("raw") & F.col("events").isNull()))
    e = own.where("NOT bad").select("id", F.posexplode("events").alias("pos", "e"))
    events = e.select("id", "pos", "e.channel", "e.status", F.col("e.latency_ms").alias("latency"), F.col("e.accepted_count").alias("accepted"), F.col("e.raw_count").alias("raw"), "e.query_index")
    return events, own.where("bad").select("id")


def trace_metrics(events: DataFrame) -> DataFrame:
    """One row a channel of trace_events; absent numbers count as 0, blank channels as unknown."""
    name, zero = F.coalesce(F.nullif(F.trim("channel"), F.lit("")), F.lit("unknown")), lambda c: F.coalesce(c, F.lit(0))
    return events.groupBy(name.alias("channel")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(~F.col("status").eqNullSafe("success")).alias("failures"), F.round(F.sum(zero("latency")), 3).alias("latency"),
        F.sum(zero("accepted")).cast("long").alias("accepted"), F.sum(zero("raw")).cast("long").alias("raw"),
    )


def rejected(answer: Column) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in REJECTIONS]), lambda p: F.lower(answer).contains(p))


def truncated(contexts: Column, n: int, chars: int) -> Column:
    """The first n contexts, cut, without trailing blanks; empty ones drop out."""
    return F.filter(F.transform(F.slice(contexts, 1, n), lambda c: F.rtrim(F.substring(c, 1, chars))), lambda c: c != "")


def parsed_contexts(answers: DataFrame) -> DataFrame:
    """(id, pos, label, number): headings of merged contexts."""
    p = r"(?m)^([A-Za-z]+) \| (?:Section|Article) (\d+[A-Z]*)"
    g = lambda i: F.regexp_extract_all("context", F.lit(p), F.lit(i))
    return answers.select("id", F.posexplode(F.arrays_zip(g(1).alias("label"), g(2).alias("number"))).alias("pos", "m")).select("id", "pos", "m.label", "m.number")
