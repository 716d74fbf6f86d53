"""Rules that chunk metadata must meet: row by row, over a collection, before an ingest.

Chunks have the columns of ``FIELDS``; a null is an absent value. Rules are expressions on
one row, so the row check needs no exchange; the collection check groups by chunk id, by
provision and by sequence, which partial aggregation keeps small before each exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import ordered

TEXTS = ["document_id", "document_name", "document_title", "document_short_name", "document_type", "chunk_id"]
COUNTS = ["chunk_number", "document_chunk_number", "page_start", "page_end", "provision_part_number", "provision_part_count"]
LABELS = ["subsection_path_key", "component_type", "component_label"]
#: Columns of a chunk and their types.
FIELDS = (
    dict.fromkeys([*TEXTS, "provision_type", "provision_number", "base_provision_number", "provision_identity", "section_number", "article_number", "section_identity", "article_identity", *LABELS], "string")
    | dict.fromkeys([*COUNTS, "provision_ordinal"], "long") | {"source_pages": "array<long>", "subsection_path": "array<string>", "is_unsectioned_chunk": "boolean"}
    | dict.fromkeys(["previous_provision_identity", "next_provision_identity", "previous_provision_number", "next_provision_number"], "string")
)
MISSING, TYPE, CONSISTENCY = "missing_required_field", "type_error", "consistency_error"
_CHUNK_ID = r"^([^:]+)::(section|article)::([^:]+)::part-(\d+)::chunk-(\d+)$"
ISSUE = "struct<category:string,field:string,rule:string>"


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _blank(name: str) -> Column:
    return _text(name) == ""


def _positive(name: str) -> Column:
    return F.coalesce(F.col(name) > 0, F.lit(False))


def _rules(*rules: tuple[Column, str, str, str]) -> Column:
    """Array of the issues whose condition holds."""
    made = [F.when(cond, F.struct(F.lit(c).alias("category"), F.lit(f).alias("field"), F.lit(r).alias("rule"))) for cond, c, f, r in rules]
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(f"array<{ISSUE}>")


def _when(*steps: tuple[Column | None, Column]) -> Column:
    """Issues of the steps up to and with the first whose stop condition holds."""
    stop, issues = steps[0]
    rest = _when(*steps[1:]) if len(steps) > 1 else None
    return issues if rest is None else F.concat(issues, F.when(stop, F.array().cast(f"array<{ISSUE}>")).otherwise(rest))


def issues() -> Column:
    """Array of (category, field, rule) that a chunk's row breaks. Nothing more is checked
    of a row without a document or an id, of an unknown type, of an unsectioned row beyond
    its own rules, or of one without a number."""
    c = F.col
    loose = F.coalesce(c("is_unsectioned_chunk"), F.lit(False))
    kind, number, base, identity = F.lower(_text("provision_type")), _text("provision_number"), _text("base_provision_number"), _text("provision_identity")
    names = _rules(*[(_blank(f), MISSING, f, "blank") for f in TEXTS])
    common = _rules(
        (F.size("subsection_path") == 0, CONSISTENCY, "subsection_path", "empty"),
        *[(c(f).isNotNull() & _blank(f), TYPE, f, "blank") for f in LABELS],
        *[(~_positive(f), TYPE, f, "positive") for f in COUNTS],
        (~loose & ~_positive("provision_ordinal"), TYPE, "provision_ordinal", "positive"),
        (~F.coalesce((F.size("source_pages") > 0) & F.forall("source_pages", lambda p: F.coalesce(p > 0, F.lit(False))), F.lit(False)), TYPE, "source_pages", "positive"),
        (_positive("page_start") & _positive("page_end") & (c("page_start") > c("page_end")), CONSISTENCY, "page_start", "order"),
        (_positive("provision_part_number") & _positive("provision_part_count") & (c("provision_part_number") > c("provision_part_count")), CONSISTENCY, "provision_part_number", "order"),
        (~kind.isin("section", "article"), TYPE, "provision_type", "known"),
    )
    unsectioned = _rules(
        (identity != F.concat_ws("::", _text("document_id"), kind, F.lit("unsectioned")), CONSISTENCY, "provision_identity", "unsectioned"),
        *[(~_blank(f), CONSISTENCY, f, "unsectioned") for f in ("provision_number", "base_provision_number")],
        (c("provision_ordinal").isNotNull(), CONSISTENCY, "provision_ordinal", "unsectioned"),
    )
    path = F.coalesce(c("subsection_path"), F.array().cast("array<string>"))
    child, deep = F.size(path) > 0, F.size(path)
    mirrors = []
    for own, other in (("section", "article"), ("article", "section")):
        mirrors += [
            ((kind == own) & ~c(f"{own}_number").eqNullSafe(number), CONSISTENCY, f"{own}_number", "mirror"), ((kind == own) & c(f"{other}_number").isNotNull(), CONSISTENCY, f"{other}_number", "other type"),
            ((kind == own) & F.coalesce(c(f"{own}_identity") != identity, F.lit(False)), CONSISTENCY, f"{own}_identity", "mirror"), ((kind == own) & c(f"{other}_identity").isNotNull(), CONSISTENCY, f"{other}_identity", "other type"),
        ]
    part = lambda i: F.regexp_extract(_text("chunk_id"), _CHUNK_ID, i)
    named = _text("chunk_id").rlike(_CHUNK_ID)
    same = lambda i, f: named & _positive(f) & (F.try_to_number(part(i), F.lit("9" * 18)).cast("long") != c(f))
    sectioned = _rules(
        (~T.canonical_number(number).eqNullSafe(number), CONSISTENCY, "provision_number", "canonical"),
        (identity == "", MISSING, "provision_identity", "blank"),
        ((identity != "") & (identity != F.concat_ws("::", _text("document_id"), kind, F.when(base != "", base).otherwise(number))), CONSISTENCY, "provision_identity", "parent"),
        (base == "", MISSING, "base_provision_number", "blank"), ((base != "") & (base != number), CONSISTENCY, "base_provision_number", "mirror"),
        *mirrors,
        (c("provision_ordinal").isNotNull() & ~_positive("provision_ordinal"), TYPE, "provision_ordinal", "stored"),
        (child & (base == ""), CONSISTENCY, "base_provision_number", "child"),
        (child & ~c("subsection_path_key").eqNullSafe(F.array_join(path, ".")), CONSISTENCY, "subsection_path_key", "join"),
        (child & ~c("component_type").eqNullSafe(F.when(deep == 1, "subsection").when(deep == 2, "clause").otherwise("paragraph")), CONSISTENCY, "component_type", "depth"),
        (child & ~c("component_label").eqNullSafe(F.concat(F.lit("("), F.get(path, deep - 1), F.lit(")"))), CONSISTENCY, "component_label", "last"),
        (~named, CONSISTENCY, "chunk_id", "form"),
        (named & (part(1) != _text("document_id")), CONSISTENCY, "chunk_id", "document"), (named & (part(2) != kind), CONSISTENCY, "chunk_id", "type"),
        (named & (part(3) != number), CONSISTENCY, "chunk_id", "number"),
        (same(4, "provision_part_number"), CONSISTENCY, "chunk_id", "part"), (same(5, "document_chunk_number"), CONSISTENCY, "chunk_id", "chunk"),
    )
    return _when(
        (_blank("document_id") | _blank("chunk_id"), names),
        (~kind.isin("section", "article"), common),
        (loose, F.when(loose, unsectioned).otherwise(F.array().cast(f"array<{ISSUE}>"))),
        (number == "", _rules((number == "", MISSING, "provision_number", "blank"))),
        (None, sectioned),
    )


def row_issues(chunks: DataFrame) -> DataFrame:
    """(id, category, field, rule) that each row breaks. An inner inline would have all rules
    evaluated once more, by an inferred filter."""
    return chunks.select("id", issues().alias("x")).select("id", F.inline_outer("x")).where("category IS NOT NULL")


def collection_issues(chunks: DataFrame) -> DataFrame:
    """(id, category, field, rule): what rows break among each other. A chunk id's first
    row (by id) is right, others repeat it. A provision has one ordinal, which no other of
    its document and type has; ordinals run from 1 without a gap; in a sequence where they
    do, rows name the provisions before and after theirs. Unsectioned rows take no part
    but in the first rule."""
    kind = F.lower(_text("provision_type"))
    named = chunks.select("id", _text("chunk_id").alias("chunk")).where("chunk <> ''")
    first = named.groupBy("chunk").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = named.join(first, "chunk").where("id > first").select("id", F.lit("chunk_id").alias("field"), F.lit("unique").alias("rule"))
    links = ["previous_provision_identity", "next_provision_identity", "previous_provision_number", "next_provision_number"]
    rows = chunks.where(~F.coalesce("is_unsectioned_chunk", F.lit(False))).select("id", _text("document_id").alias("doc"), kind.alias("kind"), _text("provision_identity").alias("own"), F.when(F.col("provision_ordinal") > 0, F.col("provision_ordinal")).alias("ordinal"), "provision_number", *links)
    rows = rows.where((F.col("doc") != "") & F.col("kind").isin("section", "article") & (F.col("own") != ""))
    key = ["doc", "kind", "own"]
    groups = rows.groupBy(*key).agg(F.min("ordinal").alias("o"), F.max("ordinal").alias("high"), F.min_by("provision_number", "id").alias("num"))
    one = groups.withColumn("one", F.coalesce(F.col("o") == F.col("high"), F.lit(False)))
    pair, order = ["doc", "kind"], ["o", "own"]
    placed = ordered.ranged(one.where("one").withColumn("it", F.struct("own", "num")), *pair, *order)
    placed = ordered.carried(ordered.carried(ordered.places(placed, pair, order, "at"), pair, order, {"before": "it"}), pair, order, {"after": "it"}, ahead=True)
    placed = placed.withColumns({"p": F.col("before.own"), "pn": F.col("before.num"), "n": F.col("after.own"), "nn": F.col("after.num")})
    # Of a document and type: how many share an ordinal, and whether any place is wrong.
    shared = placed.groupBy(*pair, "o").agg(F.count(F.lit(1)).alias("same"))
    gaps = placed.groupBy(*pair).agg(F.bool_or(F.col("at") != F.col("o")).alias("gap"))
    placed = placed.join(shared, [*pair, "o"]).join(gaps, pair)
    state = placed.select(*key, F.lit(True).alias("one"), "same", "gap", "p", "n", "pn", "nn").unionByName(one.where("NOT one").select(*key, "one"), allowMissingColumns=True)
    c = F.col
    fine = c("one") & ~c("gap")
    wrong = lambda f, want: fine & ~c(f).eqNullSafe(c(want))
    found = [
        (~c("one"), "provision_ordinal", "one"), (c("one") & (c("same") > 1), "provision_ordinal", "shared"), (c("one") & c("gap"), "provision_ordinal", "consecutive"),
        *[(wrong(f, want), f, "order") for f, want in zip(links, ("p", "n", "pn", "nn"), strict=True)],
        (fine & c("p").isNull() & c(links[0]).isNotNull(), links[0], "first"), (fine & c("n").isNull() & c(links[1]).isNotNull(), links[1], "last"),
    ]
    array = F.filter(F.array(*[F.when(cond, F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"))) for cond, f, r in found]), lambda x: x.isNotNull())
    within = rows.join(state, key).select("id", array.alias("x")).select("id", F.inline("x"))
    return again.unionByName(within).select("id", F.lit(CONSISTENCY).alias("category"), "field", "rule")


def audit(chunks: DataFrame) -> DataFrame:
    """Every issue of a collection."""
    return row_issues(chunks).unionByName(collection_issues(chunks))


def audit_summary(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """One row: points, points with an issue, others, issues by category."""
    by = [F.count_if(F.col("category") == k).alias(k) for k in (MISSING, TYPE, CONSISTENCY)]
    total = chunks.agg(F.count(F.lit(1)).alias("total_points"))
    bad = found.agg(F.count_distinct("id").alias("invalid_points"), *by)
    return total.crossJoin(bad).withColumn("valid_points", F.col("total_points") - F.col("invalid_points"))


def ingest_gate(found: DataFrame, most: int = 25) -> DataFrame:
    """(place, error): the first errors that stop an ingest, and how many more there are.
    An empty result lets it pass."""
    head = found.orderBy("id", "category", "field", "rule").limit(most).select(F.row_number().over(W.orderBy("id", "category", "field", "rule")).alias("place"), F.concat_ws(" ", F.concat(F.lit("- Chunk "), "id", F.lit(":")), "category", "field", "rule").alias("error"))
    rest = found.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit(most + 1).alias("place"), F.concat(F.lit("- ...and "), F.col("n") - most, F.lit(" more validation errors")).alias("error"))
    return head.unionByName(rest)


def compatibility(vectors: DataFrame, chunks: DataFrame, found: DataFrame, *, dimension: int, metric: str, stored_metric: str, vec_col: str = "embedding") -> DataFrame:
    """One row: whether stored vectors have the dimension, whether the metric is the same,
    and, if both hold, whether the collection's metadata is free of issues."""
    v = vectors.agg(F.count_if(~F.coalesce(F.size(vec_col) == dimension, F.lit(False))).alias("other_dimension"))
    metric_ok = metric.strip().lower() == stored_metric.strip().lower()
    x = v.crossJoin(found.agg(F.count_distinct("id").alias("invalid_points")))
    fits = (F.col("other_dimension") == 0) & F.lit(metric_ok)
    return x.select("other_dimension", F.lit(metric_ok).alias("metric_matches"), F.when(fits, F.col("invalid_points")).alias("invalid_points"), (fits & (F.col("invalid_points") == 0)).alias("compatible"))
