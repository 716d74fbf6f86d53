"""Fusion, features, final scores, near-duplicates, context selection, confidence."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.plans import dims

RRF_K = 60


def clamp(c: Column) -> Column:
    """Into 0..1; NaN and infinities count as 0, null stays null."""
    x = F.nanvl(c, F.lit(0.0))
    return F.when(c.isNull(), None).when(F.abs(x) == float("inf"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def rrf_fusion(candidates: DataFrame) -> DataFrame:
    """candidates (qid, id, method, query_index, score or null, retrieval_rank) ->
    (qid, id, fusion, semantic, matched, methods). Ranks are places in the route, with
    scored rows first; a duplicate takes up its rank, and the first counts."""
    route = W.partitionBy("qid", "method", "query_index").orderBy(F.col("score").isNull(), F.desc("score"), "retrieval_rank", "id")
    ranked = candidates.withColumn("r", F.row_number().over(route))
    firsts = ranked.groupBy("qid", "id", "method", "query_index").agg(F.min("r").alias("r"), F.max(F.when(F.col("method") == "vector", clamp(F.col("score")))).alias("v"))
    return firsts.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (RRF_K + F.col("r"))), 9).alias("fusion"), F.max("v").alias("semantic"), F.count(F.lit(1)).alias("matched"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods")
    )


def keyword_overlap(question: Column, *parts: Column) -> Column:
    """Share of the question's tokens found in the parts."""
    q = T.tokens(question)
    both = F.size(F.array_intersect(q, T.tokens(F.concat_ws(" ", *parts))))
    return F.when(F.size(q) > 0, both / F.size(q)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    x, y = T.tokens(a), T.tokens(b)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def concept_overlap(concepts: Column, title: Column, content: Column, number: Column, document: Column) -> Column:
    """Largest over the concepts of weighted keyword, provision and document matches."""
    text = F.lower(F.concat_ws(" ", title, F.substring(content, 1, 1800)))

    def one(c: tuple) -> Column:
        _, _, _, docs, sections, words = c
        kw = reduce(lambda a, b: a + b, [text.contains(w).cast("double") for w in words]) / float(len(words))
        prov = F.upper(number).isin(sections).cast("double") if sections else F.lit(0.0)
        score = 0.55 * kw + 0.25 * prov + 0.20 * document.isin(docs).cast("double") if docs else 0.65 * kw + 0.35 * prov
        return F.when(F.array_contains(concepts, c[0]), F.coalesce(score, F.lit(0.0))).otherwise(0.0)

    return F.round(F.greatest(*[one(c) for c in dims.CONCEPTS]), 6)


def match_boost(kind: Column, number: Column, title: Column, document: Column, question: Column, sections: Column, articles: Column, concepts: Column) -> Column:
    """1 for the first section or article that the question cites, in a provision of that
    kind; .9 for the title in the question, .65 for enough shared tokens, .75 for a provision
    that a concept prefers, in a document that it prefers if it does any; the first that holds."""
    n, t, own = T.normalize(question), T.normalize(title), F.upper(F.trim(number))
    shared = F.size(F.array_intersect(T.tokens(question), T.tokens(title)))
    first = lambda c: F.coalesce(own == F.upper(F.get(c, F.lit(0))), F.lit(False))
    liked = F.lit(False)
    for name, _, _, docs, numbers, _ in dims.CONCEPTS:
        if numbers:
            liked = liked | (F.array_contains(concepts, name) & own.isin(numbers) & (document.isin(docs) if docs else F.lit(True)))
    return (
        F.when((kind == "section") & first(sections), 1.0).when((kind == "article") & first(articles), 1.0).when((t != "") & n.contains(t), 0.9)
        .when((F.size(T.tokens(title)) > 0) & (shared >= F.least(F.lit(2), F.size(T.tokens(title)))), 0.65)
        .when(F.coalesce(liked, F.lit(False)), 0.75).otherwise(0.0)
    )


def special_penalty(number: Column, document: Column, question: Column) -> Column:
    """.4 if a provision needs one of some words and the question has none."""
    n, out = T.normalize(question), F.lit(0.0)
    for section, words in dims.REQUIREMENTS.items():
        some = reduce(lambda a, b: a | b, [n.contains(w) for w in words])
        out = F.when((F.upper(number) == section) & (document == "ppc_1860") & ~some, 0.4).otherwise(out)
    return out


def final_score(semantic: Column, boost: Column, keyword: Column, concept: Column, fusion: Column, penalty: Column, suspicious: Column, heading: Column) -> Column:
    raw = 0.55 * F.coalesce(semantic, F.lit(0.0)) + 0.20 * boost + 0.15 * keyword + 0.10 * concept + F.least(F.lit(0.08), 2 * fusion)
    raw = raw - penalty - F.when(suspicious, 0.05).otherwise(0.0) - F.when(heading, 0.25).otherwise(0.0)
    return F.round(clamp(raw), 6)


def by_score() -> list[Column]:
    """The order of scored candidates: best score, most queries, best similarity, first
    part, last key."""
    return [F.desc("final"), F.desc("matched"), F.coalesce("semantic", F.lit(0.0)).desc(), F.asc("part"), F.desc("key")]


def concept_coverage(concepts: Column, document: Column, number: Column) -> Column:
    """Array of the concepts that a row covers: its document and number are among those the
    concept prefers, where it prefers any."""
    own = []
    for name, _, _, docs, sections, _ in dims.CONCEPTS:
        fits = (document.isin(docs) if docs else F.lit(True)) & (number.isin(sections) if sections else F.lit(True))
        own.append(F.when(F.array_contains(concepts, name) & fits, name))
    return F.array_compact(F.array(*own))


def near_dup_pairs(ranked: DataFrame, threshold: float = 0.94) -> DataFrame:
    """Pairs of rows of one provision and part whose tokens overlap enough; groups of a
    provision are its parts in one answer, so pairs stay few."""
    a, b = ranked.alias("a"), ranked.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("qid", "provision", "part")]
    pairs = a.join(b, [*on, F.col("a.rank") < F.col("b.rank")])
    return pairs.withColumn("similarity", F.round(jaccard(F.col("a.content"), F.col("b.content")), 6)).where(F.col("similarity") >= threshold).select("a.qid", F.col("a.id").alias("kept"), F.col("b.id").alias("dup"), "similarity")


def near_dup_greedy(ranked: DataFrame, threshold: float = 0.94) -> DataFrame:
    """ranked without rows that a kept, better ranked row of their provision and part
    duplicates. What is kept depends on what was kept before, hence a grouped function;
    a group is one provision's part in one answer."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, chosen, out = pdf.sort_values("rank"), [], []
        for i, toks in enumerate(pdf["toks"]):
            own = set(toks)
            if not any(own and len(own & k) / len(own | k) >= threshold for k in chosen):
                chosen.append(own)
                out.append(i)
        return pdf.iloc[out].drop(columns="toks")

    rows = ranked.withColumn("toks", T.tokens(F.col("content")))
    return rows.groupBy("qid", "provision", "part").applyInPandas(keep, ranked.schema)


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of a provision as one text, in order, distinct contents once."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "chunk", "content")))
    return parts.groupBy("qid", "provision").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["content"])), "\n\n").alias("content"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def select_context(ranked: DataFrame, provisions: int, rows: int) -> DataFrame:
    """Whole groups of the best provisions, by their best final score, then their best
    similarity, until enough rows are taken; then cut, each group in the order of its parts."""
    g = ranked.groupBy("qid", "provision").agg(F.max("final").alias("best"), F.max(F.coalesce("semantic", F.lit(0.0))).alias("near"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("qid").orderBy(F.desc("best"), F.desc("near"), "provision")
    g = g.withColumn("g", F.row_number().over(w)).withColumn("before", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)))
    g = g.where((F.col("g") <= provisions) & (F.coalesce("before", F.lit(0)) < rows))
    place = W.partitionBy("qid").orderBy("g", "part", "rank", "id")
    return ranked.join(g.select("qid", "provision", "g"), ["qid", "provision"]).withColumn("place", F.row_number().over(place)).where(F.col("place") <= rows)


def provision_label(kind: Column, number: Column, title: Column) -> Column:
    """``Section 7: a dash and its title``, the title alone, or that there is neither."""
    named = (F.coalesce(kind, F.lit("")) != "") & (F.coalesce(number, F.lit("")) != "")
    tail = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" — "), title)).otherwise("")
    return F.when(named, F.concat(F.initcap(kind), F.lit(" "), number, tail)).when(F.coalesce(title, F.lit("")) != "", title).otherwise("Unsectioned material")


def page_range(first: Column, last: Column, page: Column) -> Column:
    one = F.when(last.isNull() | (first == last), first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    return F.when(first.isNull(), F.coalesce(page.cast("string"), F.lit("Unknown"))).otherwise(one)


def quality_status(status: Column, suspicious: Column) -> Column:
    return F.when(F.trim(F.coalesce(status, F.lit(""))) != "", F.trim(status)).when(F.coalesce(suspicious, F.lit(False)), "suspicious").otherwise("acceptable")


def sources(selected: DataFrame) -> DataFrame:
    """selected (qid, place, document_id, document_title, document_short_name, document_type,
    provision_type, provision_number, provision_title, page_start, page_end, page_number,
    chunk_numbers, merged, page_quality_status, suspicious, content) with the parts of its
    source record: label, pages, quality and the block that is cited. A row's number is its
    place, which rows without content take up too; they have no record."""
    c = F.col
    title = F.coalesce("document_title", "document_id", F.lit("Unknown"))
    short = F.coalesce("document_short_name", F.lit(""))
    line = F.when((short != "") & ~F.contains(F.lower(title), F.lower(short)), F.concat(title, F.lit(" ("), short, F.lit(")"))).otherwise(title)
    x = selected.where(F.coalesce(T.stripped(c("content")), F.lit("")) != "")
    x = x.withColumns({"label": provision_label(c("provision_type"), c("provision_number"), c("provision_title")), "pages": page_range(c("page_start"), c("page_end"), c("page_number")), "quality": quality_status(c("page_quality_status"), c("suspicious"))})
    say = lambda name, v: F.concat(F.lit(name + ": "), v)
    chunks = F.concat(F.lit("["), F.array_join(c("chunk_numbers").cast("array<string>"), ", "), F.lit("]"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("[Source "), "place", F.lit("]")), say("Document", line), say("Document ID", F.coalesce("document_id", F.lit("Unknown"))), say("Document type", F.coalesce("document_type", F.lit("legal_document"))),
        say("Provision", c("label")), say("Pages", c("pages")), say("Merged provision parts", F.when(F.coalesce("merged", F.lit(False)), "True").otherwise("False")), say("Source chunks", chunks), say("Quality", c("quality")), F.lit(""), T.stripped(c("content")),
    )
    return x.withColumn("block", block)


def context(records: DataFrame) -> DataFrame:
    """(qid, context): the blocks of each question's sources, in their order."""
    own = F.array_sort(F.collect_list(F.struct("place", "block")))
    return records.groupBy("qid").agg(F.array_join(F.transform(own, lambda v: v["block"]), "\n\n---\n\n").alias("context"))


def prompt(kind: Column, label: Column, context_: Column, question: Column) -> Column:
    """The instructions for an answer from the context alone; null without question or context."""
    tasks = F.create_map(*[F.lit(x) for kv in dims.TASKS.items() for x in kv])
    value = {"type": kind, "label": label, "task": F.coalesce(F.element_at(tasks, kind), F.lit(dims.TASKS["general"])), "context": context_, "question": question}
    # Text and names of values by turns.
    parts = re.split(r"\{(\w+)\}", dims.PROMPT)
    whole = F.concat(*[value[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])
    return F.when((T.stripped(context_) != "") & (T.stripped(question) != ""), whole)


def confidence(ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """(qid, score, label, coverage): from the similarities of the ten best rows, the
    provisions of the selected ones, and the share of the question's concepts that some
    selected row covers (all, if it has none; or if a concept prefers nothing). ranked:
    (qid, rank, semantic); selected: (qid, provision, document, number, concepts)."""
    ten = ranked.where("rank <= 10").groupBy("qid").agg(F.max("semantic").alias("top"), F.avg("semantic").alias("mean"))
    free = [c[0] for c in dims.CONCEPTS if not c[3] and not c[4]]
    own = selected.withColumn("covered", F.array_union(concept_coverage(F.col("concepts"), F.col("document"), F.col("number")), F.array_intersect("concepts", F.array(*map(F.lit, free)))))
    own = own.groupBy("qid").agg(F.count_distinct("provision").alias("provisions"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("k"), F.max(F.size("concepts")).alias("n"))
    x = ten.join(own, "qid", "left")
    coverage = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("k") / F.col("n")).otherwise(1.0)
    s = 0.45 * F.coalesce("top", F.lit(0.0)) + 0.30 * F.coalesce("mean", F.lit(0.0)) + 0.15 * F.least(F.lit(1.0), F.coalesce("provisions", F.lit(0)) / 3) + 0.10 * coverage
    return x.select("qid", F.round(s, 3).alias("score"), F.when(s >= 0.72, "High").when(s >= 0.48, "Medium").otherwise("Low").alias("label"), F.round(coverage, 3).alias("coverage"))
