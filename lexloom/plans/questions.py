"""Questions -> query plans, one row each, by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.plans import dims

#: Small tables of rules are broadcast: their size is that of the lists in dims.


def detect_documents(questions: DataFrame) -> DataFrame:
    """(qid, document_ids): documents whose alias a question holds, in table order."""
    q = questions.select("qid", T.normalize(F.col("question")).alias("n"))
    r = dims.routes(questions.sparkSession).withColumn("alias", T.normalize(F.col("alias")))
    hit = q.join(F.broadcast(r), T.has_phrase(F.col("n"), F.col("alias")))
    own = hit.groupBy("qid").agg(F.transform(F.array_sort(F.collect_set(F.struct("route", "document_id"))), lambda x: x["document_id"]).alias("document_ids"))
    return _all(questions, own, "document_ids")


def detect_concepts(questions: DataFrame) -> DataFrame:
    q = questions.select("qid", T.normalize(F.col("question")).alias("n"))
    m = dims.concept_markers(questions.sparkSession).withColumn("marker", T.normalize(F.col("marker")))
    hit = q.join(F.broadcast(m), T.has_phrase(F.col("n"), F.col("marker")))
    own = hit.groupBy("qid").agg(F.transform(F.array_sort(F.collect_set(F.struct("concept_order", "concept"))), lambda x: x["concept"]).alias("concepts"))
    return _all(questions, own, "concepts")


def _all(questions: DataFrame, own: DataFrame, name: str) -> DataFrame:
    return questions.select("qid").join(own, "qid", "left").select("qid", F.coalesce(name, F.array().cast("array<string>")).alias(name))


def scenario_score(questions: DataFrame) -> DataFrame:
    q = questions.select("qid", T.normalize(F.col("question")).alias("n"))
    m = dims.scenario_markers(questions.sparkSession).withColumn("marker", T.normalize(F.col("marker")))
    hit = q.join(F.broadcast(m), T.has_phrase(F.col("n"), F.col("marker")), "left")
    return hit.groupBy("qid").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("scenario_score"))


def question_type(n: Column, score: Column, concepts: Column, articles: Column, sections: Column) -> Column:
    """Type of a normalized question; the first rule that holds counts."""
    some = lambda *p: F.expr("false") if not p else n.rlike("|".join(p))
    scenario = (score >= 3) | ((F.size(F.split(n, " ")) >= 18) & (F.size(concepts) > 0))
    return (
        F.when(some("difference between", "compare", "comparison", "distinguish between", r"\b(?:vs|versus)\b"), "comparison")
        .when(scenario, "fact_scenario").when(F.size(articles) > 0, "article_lookup").when(F.size(sections) > 0, "section_lookup")
        .when(some("punishment", "penalty", "sentence", "imprisonment", "fine", "punishable"), "punishment")
        .when(some("definition", "define", "meaning of", "legal meaning", "what is", "what constitutes", "elements of"), "definition")
        .when(some("right to", "fundamental right", "constitutional right"), "constitutional_right").otherwise("general")
    )


def lookup(table: dict[str, int], key: Column, default: int) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def query_plan(questions: DataFrame, top_k: int = 6) -> DataFrame:
    """One row a question: documents, citations, concepts, type, depth and provision type."""
    q = questions.select("qid", "question", T.normalize(F.col("question")).alias("n"), T.citations(F.col("question"), dims.SECTION_PREFIX).alias("sections"), T.citations(F.col("question"), dims.ARTICLE_PREFIX).alias("articles"))
    q = q.join(detect_documents(questions), "qid").join(detect_concepts(questions), "qid").join(scenario_score(questions), "qid")
    q = q.withColumn("question_type", question_type(F.col("n"), F.col("scenario_score"), F.col("concepts"), F.col("articles"), F.col("sections")))
    only = F.size("document_ids") == 1
    kinds = F.create_map(*[F.lit(x) for d in dims.ROUTES for x in (d[0], d[3])])
    kind = F.when((F.size("articles") > 0) & (F.size("sections") == 0), "article").when((F.size("sections") > 0) & (F.size("articles") == 0), "section").when((F.size("articles") == 0) & only, F.element_at(kinds, F.get("document_ids", F.lit(0))))
    k = F.greatest(lookup(dims.RETRIEVAL_K, F.col("question_type"), 0), F.lit(top_k))
    return q.withColumn("provision_type", kind).withColumn("retrieval_k", k).withColumn("final_k", lookup(dims.FINAL_K, F.col("question_type"), dims.FINAL_K_ELSE)).drop("n")


def concept_hints(plan: DataFrame) -> DataFrame:
    """(qid, document_hints, section_hints, numbers): what the detected concepts prefer, in
    their order, and the cited numbers, to which a scenario of theft adds its sections."""
    own = lambda i: F.create_map(*[x for c in dims.CONCEPTS for x in (F.lit(c[0]), F.array(*map(F.lit, c[i])).cast("array<string>"))])
    hints = lambda i: F.array_distinct(F.flatten(F.transform("concepts", lambda c: F.element_at(own(i), c))))
    sections = F.transform(hints(4), F.upper)
    theft = (F.col("question_type") == "fact_scenario") & F.array_contains("concepts", "theft")
    cited = F.concat("sections", "articles")
    return plan.select("qid", hints(3).alias("document_hints"), sections.alias("section_hints"), F.array_distinct(F.when(theft, F.concat(cited, F.array_sort(sections))).otherwise(cited)).alias("numbers"))


def concept_routes(plan: DataFrame) -> DataFrame:
    """(qid, scope, number): the sections that detected concepts prefer, each in the documents
    that both question and concept allow (null: any). A concept whose documents are none of
    the question's has no route; equal routes of several concepts are one."""
    own = lambda i: F.create_map(*[x for c in dims.CONCEPTS for x in (F.lit(c[0]), F.array(*map(F.lit, c[i])).cast("array<string>"))])
    x = plan.select("qid", F.array_distinct("document_ids").alias("asked"), F.explode("concepts").alias("c"))
    x = x.select("qid", "asked", F.element_at(own(3), F.col("c")).alias("preferred"), F.explode(F.element_at(own(4), F.col("c"))).alias("number"))
    both = F.when(F.size("asked") == 0, F.col("preferred")).when(F.size("preferred") == 0, F.col("asked")).otherwise(F.array_intersect("asked", "preferred"))
    x = x.withColumn("scope", F.array_sort(both))
    apart = (F.size("asked") > 0) & (F.size("scope") == 0)
    return x.where(~apart).select("qid", F.when(F.size("scope") > 0, F.col("scope")).alias("scope"), F.upper("number").alias("number")).distinct()


def expand_queries(plan: DataFrame) -> DataFrame:
    """(qid, query_index, query): the question, one expansion by type, concept queries."""
    names = F.create_map(*[F.lit(x) for d in dims.ROUTES for x in (d[0], d[2])])
    docs = F.array_join(F.transform("document_ids", lambda d: F.element_at(names, d)), " ")
    o, t = F.trim("question"), F.col("question_type")
    ctx = lambda default: F.when(docs == "", default).otherwise(docs)
    say = lambda *parts: F.trim(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    sections = F.transform("sections", lambda s: say(docs, " Section ", s, " exact statutory text heading subsections explanation illustration conditions exceptions and punishment"))
    articles = F.transform("articles", lambda s: say(ctx("Constitution of Pakistan"), " Article ", s, " exact constitutional text right scope limitation exception and remedy"))
    by_type = (
        F.when((t == "section_lookup") & (F.size("sections") > 0), sections).when((t == "article_lookup") & (F.size("articles") > 0), articles)
        .when(t == "punishment", F.array(say(docs, " ", o, " exact punishment imprisonment term fine conditions offence elements and applicable statutory provision")))
        .when(t == "definition", F.array(say(docs, " ", o, " exact statutory definition legal elements conditions exceptions explanations and illustrations")))
        .when(t == "constitutional_right", F.array(say(ctx("Constitution of Pakistan"), " ", o, " relevant constitutional article right scope safeguard limitation and enforcement")))
        .when(t == "comparison", F.array(say(docs, " ", o, " compare statutory definitions legal elements scope conditions exceptions and punishments")))
        .when(t == "fact_scenario", F.array(say(ctx("Pakistan criminal laws"), " legal provisions directly applicable to this factual scenario: ", o)))
        .otherwise(F.array(say(ctx("Pakistan laws"), " relevant legal provisions for: ", o)))
    )
    own = F.create_map(*[x for c in dims.CONCEPTS for x in (F.lit(c[0]), F.array(*[F.lit(q) for q in c[2]]))])
    every = T.distinct_strings(F.concat(F.array(o), by_type, F.flatten(F.transform("concepts", lambda c: F.element_at(own, c)))))
    return plan.select("qid", F.posexplode(every).alias("query_index", "query"))


def references(questions: DataFrame) -> DataFrame:
    """(qid, provision_type, base_number, path, component_type): citations with child paths."""
    base = r"\d+(?:(?:\s*-\s*[A-Za-z]+)|[A-Za-z]+)?"
    pattern = rf"(?i)\b((?:{dims.SECTION_PREFIX}|{dims.ARTICLE_PREFIX}))\s*({base})((?:\s*\(\s*[A-Za-z0-9-]+\s*\))*)"
    all_ = lambda i: F.regexp_extract_all("question", F.lit(pattern), F.lit(i))
    x = questions.select("qid", F.posexplode(F.arrays_zip(all_(1).alias("prefix"), all_(2).alias("base"), all_(3).alias("children"))).alias("pos", "m"))
    path = F.transform(F.regexp_extract_all("m.children", F.lit(r"\(\s*([A-Za-z0-9-]+)\s*\)"), F.lit(1)), F.lower)
    x = x.select("qid", "pos", F.when(F.lower("m.prefix").startswith("art"), "article").otherwise("section").alias("provision_type"), T.canonical_number(F.col("m.base")).alias("base_number"), path.alias("p"))
    depth = F.element_at(F.array(*[F.lit(k) for k in ("subsection", "clause", "paragraph", "subparagraph")]), F.least(F.size("p"), F.lit(4)))
    kind = F.when(F.size("p") == 0, None).when(F.size("p") > 4, "component").otherwise(F.when(F.size("p") > 0, depth))
    x = x.where("base_number IS NOT NULL").select("qid", "pos", "provision_type", "base_number", F.array_join("p", "/").alias("path"), kind.alias("component_type"))
    return x.groupBy("qid", "provision_type", "base_number", "path", "component_type").agg(F.min("pos").cast("long").alias("pos"))
