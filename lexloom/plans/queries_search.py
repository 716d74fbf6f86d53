"""Queries of the filter, search, fusion, ranking and selection operators."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import rank as R
from lexloom.operators import search as S
from lexloom.plans import dims
from lexloom.plans import questions as Q
from lexloom.plans import queries_text as QT
from lexloom.plans.queries_text import picked, table
from lexloom.plans.sqltext import cited, frame, lit, norm, phrase, toks, values
from lexloom.sources.tables import materialized

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents seen as chunks of numbered provisions.
_CHUNKS = """(SELECT doc_id AS id, 'c' || doc_id AS chunk_id, source AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'article' ELSE 'section' END AS provision_type,
  CAST(doc_id % 40 AS VARCHAR) AS provision_number, CAST(doc_id % 40 AS VARCHAR) AS base_provision_number, CASE doc_id % 3 WHEN 1 THEN '1' WHEN 2 THEN '1/b' ELSE '' END AS subsection_path_key,
  CASE doc_id % 3 WHEN 1 THEN 'subsection' WHEN 2 THEN 'clause' END AS component_type, doc_id % 11 = 0 AS heading_only_chunk,
  CASE doc_id % 13 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS provision_body_present, CAST(doc_id % 2 + 1 AS INT) AS part, CAST(doc_id % 9 + 1 AS INT) AS page,
  CAST(floor(doc_id / 20) AS INT) AS ordinal, text AS page_content FROM documents)"""


def chunks(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_as_chunks")
    return spark.sql("SELECT * FROM " + _CHUNKS.replace("FROM documents)", "FROM documents_as_chunks)").replace("VARCHAR", "STRING"))


_USABLE = "trim(coalesce(page_content, '')) <> '' AND NOT coalesce(heading_only_chunk, false) AND coalesce(provision_body_present, true)"


@query(f"SELECT id, document_id FROM {_CHUNKS} WHERE document_id IN ('src0', 'src3') AND NOT heading_only_chunk")
def filtered_scan(spark, sf_dir):
    return chunks(spark, sf_dir).where(F.col("document_id").isin("src0", "src3") & ~F.col("heading_only_chunk")).select("id", "document_id")


@query(f"SELECT id FROM {_CHUNKS} WHERE {_USABLE}")
def usable(spark, sf_dir):
    return chunks(spark, sf_dir).where(S.usable()).select("id")


@query(f"SELECT id FROM {_CHUNKS} WHERE provision_number IN ('3', '14') AND NOT heading_only_chunk AND provision_type = 'section' AND document_id IN ('src3', 'src14')")
def provision_filter(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.where(F.col("provision_number").isin("3", "14") & ~F.col("heading_only_chunk") & (F.col("provision_type") == "section") & F.col("document_id").isin("src3", "src14")).select("id")


@query(f"SELECT id FROM {_CHUNKS} WHERE provision_type = 'section' AND base_provision_number = '4' AND subsection_path_key = '1' AND NOT heading_only_chunk AND component_type = 'subsection'")
def child_filter(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.where((F.col("provision_type") == "section") & (F.col("base_provision_number") == "4") & (F.col("subsection_path_key") == "1") & ~F.col("heading_only_chunk") & (F.col("component_type") == "subsection")).select("id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'rights reserved')")
def text_search(spark, sf_dir):
    x = F.lower("text")
    return table(spark, sf_dir, "documents").where(x.contains("license") | x.contains("rights reserved")).select("doc_id")


@query("SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN quality = 1 THEN NULL ELSE toxic * 0.5::DOUBLE END AS score FROM labels) WHERE score IS NULL OR score >= 0.3")
def min_relevance(spark, sf_dir):
    s = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") != 1, F.col("toxic") * 0.5).alias("score"))
    return s.where(F.col("score").isNull() | (F.col("score") >= 0.3))


_TERMS = f"(SELECT doc_id AS id, source, text AS t, {toks('text')} AS terms FROM documents)"


@query(f"SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS n, round((SELECT avg(len(terms)) FROM {_TERMS}), 6) AS avgdl FROM (SELECT unnest(terms) AS term FROM {_TERMS}) GROUP BY term")
def bm25_stats(spark, sf_dir):
    s = S.bm25_stats(S.postings(table(spark, sf_dir, "documents")))
    return s.select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(keep: str, k: int, queries: str = "(SELECT item_id AS qid, text FROM benchmark)") -> str:
    return f"""
WITH d AS MATERIALIZED {_TERMS}, s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM d), q AS MATERIALIZED (SELECT qid, {norm('text')} AS q, {toks('text')} AS ts FROM {queries}),
p AS (SELECT id, source, len(terms) AS size, unnest(terms) AS term FROM d), qt AS (SELECT qid, unnest(ts) AS term FROM q), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
h AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * size / avgdl))) AS s FROM qt JOIN p USING (term) JOIN f USING (term), s WHERE {keep} GROUP BY qid, id),
b AS (SELECT qid, id, round(s + CASE WHEN q <> '' AND contains({norm('d.t')}, q) THEN least(0.5, 0.05 * greatest(1, len(ts))) ELSE 0 END, 6) AS score FROM h JOIN q USING (qid) JOIN d USING (id))
SELECT * FROM (SELECT qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM b WHERE score > 0) WHERE rank <= {k}"""


@query(_bm25("true", 5))
def bm25_topk(spark, sf_dir):
    return S.bm25_topk(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5)


@query(_bm25("true", 5))
def bm25_blocks(spark, sf_dir):
    """bm25_topk over blocks of postings, of which those that can't matter aren't read."""
    return S.bm25_blocks(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5)[0]


@query(_bm25("source IN ('src1', 'src2')", 5))
def bm25_topk_filtered(spark, sf_dir):
    return S.bm25_topk(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 5, keep=F.col("source").isin("src1", "src2"))


def _vec(keep: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM (
  SELECT b.item_id AS qid, v.vec_id AS id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v WHERE {keep})) WHERE rank <= {k}"""


def vector_questions(spark, sf_dir):
    """Each benchmark item with the stored vector of its number, standing in for a model."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(S.maybe_broadcast(b), "vec_id").select(F.col("vec_id").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))


@query(_vec("true", 5))
def vector_topk(spark, sf_dir):
    return S.vector_topk(vector_questions(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5)


@query(_vec("v.label = 3", 5))
def vector_topk_filtered(spark, sf_dir):
    return S.vector_topk(vector_questions(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5, where=F.col("label") == 3)


_WANTED = [(1, 1, "section", "3", "src3"), (1, 2, "section", "3", None), (2, 1, "article", "999", None), (2, 2, "article", "7", None), (3, 1, "section", "998", None)]
_WT = values("w", "qid, priority, provision_type, provision_number, document_id", _WANTED)


@query(f"SELECT DISTINCT qid, chunk_id FROM (SELECT w.qid, w.priority, c.chunk_id, min(w.priority) OVER (PARTITION BY w.qid) AS p FROM {_WT} JOIN {_CHUNKS} c ON w.provision_type = c.provision_type AND w.provision_number = c.provision_number AND coalesce(w.document_id = c.document_id, true)) WHERE priority = p")
def exact_lookup(spark, sf_dir):
    w = frame(spark, "qid LONG, priority INT, provision_type STRING, provision_number STRING, document_id STRING", _WANTED)
    return S.exact_lookup(w, chunks(spark, sf_dir))


_REFS = [(1, "section", "4", "1"), (2, "section", "5", "9/z"), (3, "article", "7", "1/b")]


@query(f"""SELECT ref, chunk_id, "any" AS exact FROM (SELECT *, max(child) OVER (PARTITION BY ref) AS "any" FROM (
  SELECT r.ref, c.chunk_id, coalesce(c.subsection_path_key = r.path, false) AS child, coalesce(c.subsection_path_key, '') = '' AND c.component_type IS NULL AS parent
  FROM {values('r', 'ref, provision_type, base_number, path', _REFS)} JOIN {_CHUNKS} c ON r.base_number = c.base_provision_number AND r.provision_type = c.provision_type)) WHERE CASE WHEN "any" THEN child ELSE parent END""")
def child_or_parent(spark, sf_dir):
    r = frame(spark, "ref LONG, provision_type STRING, base_number STRING, path STRING", _REFS)
    return S.child_or_parent(F.broadcast(r), chunks(spark, sf_dir))


@query(f"SELECT p.id AS probe, c.id, c.ordinal - p.ordinal AS \"offset\" FROM {_CHUNKS} p JOIN {_CHUNKS} c ON p.document_id = c.document_id AND p.provision_type = c.provision_type AND abs(p.ordinal - c.ordinal) <= 2 WHERE p.provision_number = '5'")
def neighbors(spark, sf_dir):
    c = chunks(spark, sf_dir)
    probes = c.where("provision_number = '5'").select(F.col("id").alias("probe"), "document_id", "provision_type", "ordinal")
    return S.neighbors(probes, c, 2)


#: Documents as the provisions of laws: some of the penal code, numbers from 300 on that go
#: on with the corpus, the text's beginning as title.
_LAW = """(SELECT doc_id AS id, text, CASE WHEN doc_id % 20 < 5 THEN 'ppc_1860' ELSE source END AS document_id, CASE WHEN doc_id % 7 = 0 THEN 'article' ELSE 'section' END AS provision_type,
  CAST(300 + CAST(floor(doc_id / 20) AS INT) AS VARCHAR) AS provision_number, CAST(floor(doc_id / 20) AS INT) AS ordinal, source, substring(text, 1, 40) AS title, text AS content,
  CAST(doc_id % 2 + 1 AS INT) AS part, 'c' || CAST(doc_id AS VARCHAR) AS key, doc_id % 17 = 0 AS suspicious, doc_id % 11 = 0 AS heading, CAST(doc_id % 9 + 1 AS INT) AS page FROM documents)"""


def law(spark, sf_dir):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_as_chunks")
    return spark.sql("SELECT * FROM " + _LAW.replace("FROM documents)", "FROM documents_as_chunks)").replace("VARCHAR", "STRING"))


#: Benchmark items as what is asked, each after one of the questions.
_BQ = f"(SELECT item_id AS qid, {lit([q for _, q in QT.QUESTIONS])}[item_id % {len(QT.QUESTIONS)} + 1] || ' ' || text AS question FROM benchmark) AS q"
_of_items = lambda sql: sql.replace(QT._QS, _BQ)
_DOCS_B, _CONCEPTS_B, _QUERIES_B = map(_of_items, (QT._DOCS_SQL, QT._CONCEPTS_SQL, QT._EXPANDED))


def item_questions(spark, sf_dir):
    question = F.concat(picked([q for _, q in QT.QUESTIONS], F.col("item_id")), F.lit(" "), "text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), question.alias("question"))


_PREFER = values("k", "concept, number, docs", [(c[0], n, c[3]) for c in dims.CONCEPTS for n in c[4]])


def _routes(docs: str, concepts: str) -> str:
    return f"""SELECT DISTINCT qid, scope, number FROM (SELECT qid, number, CASE WHEN own = [] AND docs = [] THEN NULL WHEN own = [] THEN list_sort(docs) WHEN docs = [] THEN list_sort(own) ELSE list_sort(list_intersect(own, docs)) END AS scope FROM (
  SELECT c.qid, k.number, k.docs::VARCHAR[] AS docs, CASE WHEN d.documents = '' THEN []::VARCHAR[] ELSE string_split(d.documents, ',') END AS own
  FROM (SELECT qid, unnest(string_split(concepts, ',')) AS concept FROM ({concepts})) c JOIN {_PREFER} ON k.concept = c.concept JOIN ({docs}) d ON d.qid = c.qid)) WHERE scope IS NULL OR scope <> []"""


@query(f"SELECT qid, coalesce(array_to_string(scope, ','), '') AS docs, number FROM ({_routes(QT._DOCS_SQL, QT._CONCEPTS_SQL)})")
def neighbor_routes(spark, sf_dir):
    """Where each user turn's concepts send the neighbour channel: their sections in the
    documents that question and concept allow; disjoint ones are skipped, equal routes are one."""
    r = Q.concept_routes(Q.query_plan(QT.asked(spark, sf_dir)))
    return r.select("qid", F.coalesce(F.array_join("scope", ","), F.lit("")).alias("docs"), "number")


_EXACT = f"""SELECT DISTINCT qid, id FROM (SELECT *, min(priority) OVER (PARTITION BY qid) AS p FROM (
  SELECT w.qid, c.id, CASE WHEN list_contains(string_split(d.documents, ','), c.document_id) THEN 1 ELSE 2 END AS priority FROM (
    SELECT qid, 'section' AS kind, unnest({QT._SEC}) AS number FROM {_BQ} UNION SELECT qid, 'article', unnest({QT._ARTS}) FROM {_BQ}) w
  JOIN {_LAW} c ON c.provision_type = w.kind AND c.provision_number = w.number JOIN ({_DOCS_B}) d ON d.qid = w.qid)) WHERE priority = p"""
_NEAR = f"""SELECT qid, scope, number, id, min(away) AS away FROM (SELECT r.*, c.id, abs(c.ordinal - p.ordinal) AS away FROM ({_routes(_DOCS_B, _CONCEPTS_B)}) r
  JOIN {_LAW} p ON p.provision_type = 'section' AND p.provision_number = r.number AND (r.scope IS NULL OR list_contains(r.scope, p.document_id))
  JOIN {_LAW} c ON c.document_id = p.document_id AND c.provision_type = p.provision_type AND abs(c.ordinal - p.ordinal) <= 1) GROUP BY ALL"""
#: A query's vector: the stored one of the item's number and the query's.
_QVEC = f"(SELECT x.qid * 100 + x.query_index AS qid, e.embedding FROM ({_QUERIES_B}) x JOIN embeddings e ON e.vec_id = x.qid + x.query_index)"
_CAND = f"""SELECT (qid // 100)::BIGINT AS qid, id, 'lexical' AS method, (qid % 100)::INT AS query_index, score, rank FROM ({_bm25('true', 20, f'(SELECT qid * 100 + query_index AS qid, query AS text FROM ({_QUERIES_B}))')})
UNION ALL SELECT (qid // 100)::BIGINT, id, 'vector', (qid % 100)::INT, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id))::INT AS rank FROM (
  SELECT q.qid, v.vec_id AS id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM {_QVEC} q, embeddings v)) WHERE rank <= 20
UNION ALL SELECT qid, id, 'exact', 0, NULL, (row_number() OVER (PARTITION BY qid ORDER BY id))::INT FROM ({_EXACT})
UNION ALL SELECT n.qid, id, 'neighbor', k, NULL, (row_number() OVER (PARTITION BY n.qid, scope, number ORDER BY away, id))::INT FROM ({_NEAR}) n JOIN (SELECT qid, (max(query_index) + 1)::INT AS k FROM ({_QUERIES_B}) GROUP BY qid) USING (qid)"""


def _planned(spark, sf_dir):
    return materialized(Q.query_plan(item_questions(spark, sf_dir)), "plan")


def _candidates(spark, sf_dir, plan=None):
    """All four channels for each item and its expanded queries."""
    plan = _planned(spark, sf_dir) if plan is None else plan
    queries = materialized(Q.expand_queries(plan), "expanded")
    e = table(spark, sf_dir, "embeddings")
    own = queries.select("qid", "query_index", (F.col("qid") + F.col("query_index")).alias("vec_id"))
    vectors = e.join(S.maybe_broadcast(own), "vec_id").select("qid", "query_index", F.col("embedding").alias("q"))
    return S.fetch_candidates(plan, queries, vectors, e, law(spark, sf_dir), Q.concept_routes(plan), 20)


@query(_CAND)
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


#: Events as candidates: of a user's question by three channels, two queries each, with
#: duplicates, ties and channels without scores.
_EVENTS = """(SELECT user_id AS qid, event_id % 50 AS id, CASE event_id % 4 WHEN 0 THEN 'neighbor' WHEN 1 THEN 'lexical' ELSE 'vector' END AS method, CAST(event_id % 3 AS INT) AS query_index,
  CASE WHEN event_id % 4 <> 0 AND event_id % 7 <> 0 THEN CAST(round(value / 100, 1) AS DOUBLE) END AS score, CAST(event_id % 20 + 1 AS INT) AS rank FROM events)"""


def _rrf(source: str) -> str:
    return f"""SELECT qid, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS fusion, max(v) AS semantic, count(*) AS matched, array_to_string(list_sort(list_distinct(list(method))), ',') AS methods FROM (
  SELECT qid, id, method, query_index, min(r) AS r, max(CASE WHEN method = 'vector' AND score IS NOT NULL THEN greatest(0.0, least(1.0, score)) END)::DOUBLE AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY qid, method, query_index ORDER BY score IS NULL, score DESC, rank, id) AS r FROM {source}) GROUP BY ALL) GROUP BY qid, id"""


_CV = _EVENTS


def _events(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events_as_candidates")
    return spark.sql("SELECT * FROM " + _EVENTS.replace("FROM events)", "FROM events_as_candidates)"))


@query(_rrf(_CV))
def rrf_fusion(spark, sf_dir):
    return R.rrf_fusion(_events(spark, sf_dir).withColumnRenamed("rank", "retrieval_rank"))


@query(f"SELECT qid, id, array_to_string(list_sort(list_distinct(list(method))), ',') AS methods, array_to_string(list_sort(list_distinct(list(query_index))), ',') AS indices, count(DISTINCT method || query_index) AS matched_queries FROM {_CV} GROUP BY qid, id")
def provenance(spark, sf_dir):
    c = _events(spark, sf_dir)
    return c.groupBy("qid", "id").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.array_join(F.array_sort(F.collect_set("query_index")).cast("array<string>"), ",").alias("indices"), F.count_distinct("method", "query_index").alias("matched_queries"))


_OVER = f"CASE WHEN len({{q}}) > 0 THEN len(list_intersect({{q}}, {{d}}))::DOUBLE / len({{q}}) ELSE 0 END"


@query(f"SELECT c.qid, c.id, round({_OVER.format(q=toks('b.text'), d=toks('d.source || chr(32) || substring(d.text, 1, 1600)'))}, 6) AS overlap FROM ({_bm25('true', 5)}) c JOIN benchmark b ON b.item_id = c.qid JOIN documents d ON d.doc_id = c.id")
def keyword_overlap(spark, sf_dir):
    c = materialized(bm25_topk(spark, sf_dir), "best")  # so that its size is known
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return S.maybe_broadcast(c).join(d, "id").join(S.maybe_broadcast(b), "qid").select("qid", "id", F.round(R.keyword_overlap(F.col("q"), F.col("source"), F.substring("text", 1, 1600)), 6).alias("overlap"))


_FEAT = [
    (1, "What is the punishment for theft", "Theft", "theft punishment movable property", "378", "ppc_1860", "theft"), (2, "Who is an agent entrusted with dominion", "Criminal breach of trust", "entrusted clerk servant agent", "405", "ppc_1860", "breach_of_trust"),
    (3, "section 302", "Punishment of murder", "death", "302", "ppc_1860", "murder"), (4, "inheritance dispute", "Heir", "wali", "317", "ppc_1860", ""), (5, "fair trial", "Safeguards as to arrest", "right", "10A", "constitution_1973", ""), (6, "acts of terrorism", "Terrorism", "act of terrorism section 6", "6", "ata_1997", "terrorism"),
]
#: Documents in these roles, each with its own text behind what is given.
_FCOL = ["question", "title", "content", "number", "document", "concepts"]
_FV = "(SELECT doc_id AS i, " + ", ".join(f"{lit([f[k + 1] for f in _FEAT])}[doc_id % {len(_FEAT)} + 1]" + (" || ' ' || text" if c in ("question", "content") else "") + f" AS {c}" for k, c in enumerate(_FCOL)) + ", CASE WHEN doc_id % 7 = 0 THEN 'article' ELSE 'section' END AS kind FROM documents)"


def _feats(spark, sf_dir):
    own = lambda k, c: picked([f[k + 1] for f in _FEAT], F.col("doc_id"))
    cols = [(F.concat(own(k, c), F.lit(" "), "text") if c in ("question", "content") else own(k, c)).alias(c) for k, c in enumerate(_FCOL)]
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), *cols, F.when(F.col("doc_id") % 7 == 0, "article").otherwise("section").alias("kind"))


def _concept_sql(c: tuple) -> str:
    name, _, _, docs, sections, words = c
    text = "lower(title || ' ' || substring(content, 1, 1800))"
    kw = "(" + " + ".join(f"contains({text}, {lit(w)})::INT" for w in words) + f") / {float(len(words))}"
    prov = f"(upper(number) IN ({', '.join(map(lit, sections))}))::INT" if sections else "0"
    score = f"0.55 * {kw} + 0.25 * {prov} + 0.20 * (document IN ({', '.join(map(lit, docs))}))::INT" if docs else f"0.65 * {kw} + 0.35 * {prov}"
    return f"CASE WHEN concepts = '{name}' THEN {score} ELSE 0 END"


@query(f"SELECT i, round(greatest({', '.join(map(_concept_sql, dims.CONCEPTS))}), 6) AS overlap FROM {_FV}")
def concept_overlap(spark, sf_dir):
    return _feats(spark, sf_dir).select("i", R.concept_overlap(F.split("concepts", ","), F.col("title"), F.col("content"), F.col("number"), F.col("document")).alias("overlap"))


def _boost(q: str, has, document: str, kind: str) -> str:
    """q: prefix of the question's columns question, n and qt; has: condition of a concept."""
    first = lambda c: f"coalesce(upper(trim(number)) = upper(({c})[1]), false)"
    liked = " OR ".join(f"({has(c)} AND upper(number) IN ({', '.join(map(lit, c[4]))})" + (f" AND {document} IN ({', '.join(map(lit, c[3]))})" if c[3] else "") + ")" for c in dims.CONCEPTS if c[4])
    sections, articles = cited(q + "question", dims.SECTION_PREFIX), cited(q + "question", dims.ARTICLE_PREFIX)
    return f"""CASE WHEN {kind} = 'section' AND {first(sections)} THEN 1.0 WHEN {kind} = 'article' AND {first(articles)} THEN 1.0 WHEN {norm('title')} <> '' AND contains({q}n, {norm('title')}) THEN 0.9
  WHEN len({toks('title')}) > 0 AND len(list_intersect({q}qt, {toks('title')})) >= least(2, len({toks('title')})) THEN 0.65 WHEN {liked} THEN 0.75 ELSE 0.0 END"""


@query(f"SELECT i, ({_boost('', lambda c: f'concepts = {lit(c[0])}', 'document', 'kind')})::DOUBLE AS boost FROM (SELECT *, {norm('question')} AS n, {toks('question')} AS qt FROM {_FV})")
def match_boost(spark, sf_dir):
    c = F.col
    s, a = (T.citations(c("question"), p) for p in (dims.SECTION_PREFIX, dims.ARTICLE_PREFIX))
    return _feats(spark, sf_dir).select("i", R.match_boost(c("kind"), c("number"), c("title"), c("document"), c("question"), s, a, F.split("concepts", ",")).alias("boost"))


_PEN = " ".join(f"WHEN upper(number) = '{s}' AND document = 'ppc_1860' AND NOT ({' OR '.join(f'contains({norm("question")}, {lit(w)})' for w in ws)}) THEN 0.4" for s, ws in dims.REQUIREMENTS.items())


@query(f"SELECT i, (CASE {_PEN} ELSE 0.0 END)::DOUBLE AS penalty FROM {_FV}")
def special_penalty(spark, sf_dir):
    return _feats(spark, sf_dir).select("i", R.special_penalty(F.col("number"), F.col("document"), F.col("question")).alias("penalty"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, 0.55 * coalesce(CASE WHEN value < 50 THEN value / 100 END, 0) + 0.20 * (user_id % 3) / 2 + 0.15 * (event_id % 7) / 7 + 0.10 * (event_id % 5) / 5 + least(0.08, 2.0 / (60 + event_id % 40)) - CASE WHEN event_id % 9 = 0 THEN 0.4 ELSE 0.0 END - CASE WHEN event_id % 13 = 0 THEN 0.05 ELSE 0.0 END - CASE WHEN event_id % 11 = 0 THEN 0.25 ELSE 0.0 END)), 6)::DOUBLE AS final FROM events")
def final_score(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    s = R.final_score(F.when(F.col("value") < 50, F.col("value") / 100), (F.col("user_id") % 3) / 2, (i % 7) / 7, (i % 5) / 5, 1.0 / (60 + i % 40), F.when(i % 9 == 0, 0.4).otherwise(0.0), i % 13 == 0, i % 11 == 0)
    return e.select("event_id", s.alias("final"))


def _plain(x: str) -> str:
    """A marker as questions are normalized."""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\-\s]", " ", x.lower())).strip()


def _has(c: tuple) -> str:
    return "(" + " OR ".join(phrase(norm("b.text"), lit(re.escape(_plain(m)).replace("\\ ", " ").replace("\\-", "-"))) for m in c[1]) + ")"


_Q = f"(SELECT b.qid, b.text AS question, {norm('b.text')} AS n, {toks('b.text')} AS qt, " + ", ".join(f"{_has(c)} AS has_{c[0]}" for c in dims.CONCEPTS) + f" FROM (SELECT qid, question AS text FROM {_BQ}) b)"
_CONCEPT = "greatest(" + ", ".join(_concept_sql(c).replace(f"concepts = '{c[0]}'", f"has_{c[0]}").replace("number", "provision_number").replace("(document ", "(document_id ") for c in dims.CONCEPTS) + ")"
_BOOST = _boost("", lambda c: f"has_{c[0]}", "document_id", "provision_type").replace("trim(number)", "trim(provision_number)").replace("upper(number)", "upper(provision_number)")
_PEN_LAW = _PEN.replace("upper(number)", "upper(provision_number)").replace("document =", "document_id =")
_SCORED = f"""(SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY final DESC, matched DESC, coalesce(semantic, 0) DESC, part, key DESC))::INT AS rank FROM (
  SELECT f.*, d.* EXCLUDE (id), q.* EXCLUDE (qid), round(greatest(0.0, least(1.0, 0.55 * coalesce(semantic, 0) + 0.20 * {_BOOST} + 0.15 * {_OVER.format(q='qt', d=toks('d.source || chr(32) || substring(d.content, 1, 1600)'))} + 0.10 * round({_CONCEPT}, 6)
    + least(0.08, 2 * fusion) - (CASE {_PEN_LAW} ELSE 0.0 END) - CASE WHEN suspicious THEN 0.05 ELSE 0.0 END - CASE WHEN heading THEN 0.25 ELSE 0.0 END)), 6)::DOUBLE AS final
  FROM ({_rrf('(' + _CAND + ')')}) f JOIN {_Q} q ON q.qid = f.qid JOIN {_LAW} d ON d.id = f.id))"""
_HYBRID = f"SELECT qid, id, methods, final, rank FROM {_SCORED} WHERE rank <= 5"


def ranked(spark, sf_dir):
    """Fused and scored candidates of each item, all features in. Texts aren't carried on."""
    c, plan = F.col, _planned(spark, sf_dir)
    fused = R.rrf_fusion(_candidates(spark, sf_dir, plan).withColumnRenamed("rank", "retrieval_rank"))
    # Written, so that its size is known: texts stay where they are if it is small.
    x = S.maybe_broadcast(materialized(fused, "fused")).join(law(spark, sf_dir).drop("text"), "id").join(S.maybe_broadcast(plan.select("qid", "question", "sections", "articles", "concepts")), "qid")
    boost = R.match_boost(c("provision_type"), c("provision_number"), c("title"), c("document_id"), c("question"), c("sections"), c("articles"), c("concepts"))
    final = R.final_score(
        c("semantic"), boost, R.keyword_overlap(c("question"), c("source"), F.substring("content", 1, 1600)), R.concept_overlap(c("concepts"), c("title"), c("content"), c("provision_number"), c("document_id")),
        c("fusion"), R.special_penalty(c("provision_number"), c("document_id"), c("question")), c("suspicious"), c("heading"),
    )
    x = x.withColumn("final", final).drop("content", "question", "title")
    return x.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*R.by_score())))


@query(_HYBRID)
def hybrid_rank(spark, sf_dir):
    return ranked(spark, sf_dir).where("rank <= 5").select("qid", "id", "methods", "final", "rank")


#: The ten best rows of each item, as parts of three provisions.
_BEST = f"(SELECT qid, id, (id % 3)::VARCHAR AS provision, part, content, rank, final, page, title, provision_type, provision_number, document_id FROM {_SCORED} WHERE rank <= 10)"
_DV = _BEST + " AS d"


def _dups(spark, sf_dir):
    """With their whole texts, which only the chosen rows are joined with."""
    r = ranked(spark, sf_dir).where("rank <= 10").select("qid", "id", (F.col("id") % 3).cast("string").alias("provision"), "part", "rank", "final", "page", "provision_type", "provision_number", "document_id")
    return materialized(S.maybe_broadcast(materialized(r, "rows")).join(law(spark, sf_dir).select("id", "content", "title"), "id"), "best")


_JAC = "len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b})))"


@query(f"SELECT * FROM (SELECT a.qid, a.id AS kept, b.id AS dup, round({_JAC.format(a=toks('a.content'), b=toks('b.content'))}, 6) AS similarity FROM {_BEST} AS a JOIN {_BEST} AS b ON a.qid = b.qid AND a.provision = b.provision AND a.part = b.part AND a.rank < b.rank) WHERE similarity >= 0.1")
def near_dup_pairs(spark, sf_dir):
    return R.near_dup_pairs(_dups(spark, sf_dir), 0.1)


@query()
def near_dup_greedy(spark, sf_dir):
    return R.near_dup_greedy(_dups(spark, sf_dir), 0.94).select("qid", "id")


@query(f"SELECT a.item_id AS a, b.item_id AS b, round({_JAC.format(a=toks('a.text'), b=toks('b.text'))}, 6) AS jaccard FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id WHERE len(list_intersect({toks('a.text')}, {toks('b.text')})) > 0")
def jaccard_pairs(spark, sf_dir):
    """Token Jaccard of benchmark items that share a token: an equi-join on tokens."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("w"))
    n = t.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    both = t.alias("a").join(t.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.item_id") < F.col("b.item_id"))).groupBy(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    x = both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return x.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("jaccard"))


@query(f"SELECT qid, id, max(score) AS score FROM {_CV} WHERE score IS NOT NULL GROUP BY qid, id")
def dedup_best(spark, sf_dir):
    return _events(spark, sf_dir).where("score IS NOT NULL").groupBy("qid", "id").agg(F.max("score").alias("score"))


@query(f"SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY pinned, rank, id))::INT AS place FROM (SELECT qid, id, min(pinned) AS pinned, min(rank) AS rank FROM (SELECT qid, id, 1 AS pinned, rank FROM {_DV} UNION ALL SELECT 1, 5, 0, 0) GROUP BY qid, id)")
def exact_pinning(spark, sf_dir):
    pins = frame(spark, "qid LONG, id LONG, pinned INT, rank INT", [(1, 5, 0, 0)])
    x = _dups(spark, sf_dir).select("qid", "id", F.lit(1).alias("pinned"), "rank").unionByName(pins).groupBy("qid", "id").agg(F.min("pinned").alias("pinned"), F.min("rank").alias("rank"))
    return x.select("qid", "id", F.row_number().over(W.partitionBy("qid").orderBy("pinned", "rank", "id")).alias("place"))


@query(f"SELECT qid, provision, string_agg(content, chr(10) || chr(10) ORDER BY first) AS content, min(p0)::INT AS page_start, max(p1)::INT AS page_end FROM (SELECT qid, provision, content, min({{'part': part, 'rank': rank}}) AS first, min(page) AS p0, max(page) AS p1 FROM {_DV} GROUP BY qid, provision, content) GROUP BY qid, provision")
def merge_parts(spark, sf_dir):
    return R.merge_parts(_dups(spark, sf_dir).withColumnRenamed("rank", "chunk"))


@query(f"""WITH r AS (SELECT qid, id, final, semantic, part, rank, (id % 3)::VARCHAR AS provision FROM {_SCORED} WHERE rank <= 5), g AS (SELECT *, row_number() OVER w AS g, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY best DESC, near DESC, provision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT qid, provision, max(final) AS best, max(coalesce(semantic, 0)) AS near, count(*) AS n FROM r GROUP BY ALL) WINDOW w AS (PARTITION BY qid ORDER BY best DESC, near DESC, provision))
SELECT * FROM (SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY g, part, rank, id))::INT AS place FROM r JOIN g USING (qid, provision) WHERE g <= 2 AND before < 3) WHERE place <= 3""")
def select_context(spark, sf_dir):
    r = ranked(spark, sf_dir).where("rank <= 5").withColumn("provision", (F.col("id") % 3).cast("string"))
    return R.select_context(r, 2, 3).select("qid", "id", "place")


def _covered(c: tuple) -> str:
    fits = [f"document_id IN ({', '.join(map(lit, c[3]))})"] * bool(c[3]) + [f"provision_number IN ({', '.join(map(lit, c[4]))})"] * bool(c[4])
    return f"max((has_{c[0]} AND {' AND '.join(fits) or 'true'})::INT) FILTER (rank <= 5)"


@query(f"""SELECT qid, round(s, 3) AS score, CASE WHEN s >= 0.72 THEN 'High' WHEN s >= 0.48 THEN 'Medium' ELSE 'Low' END AS label, round(coverage, 3) AS coverage FROM (
  SELECT qid, coverage, 0.45 * top + 0.30 * mean + 0.15 * least(1.0, provisions / 3.0::DOUBLE) + 0.10 * coverage AS s FROM (
    SELECT qid, coalesce(max(semantic), 0) AS top, coalesce(avg(semantic), 0) AS mean, count(DISTINCT document_id || provision_number) FILTER (rank <= 5) AS provisions,
      CASE WHEN any_value({' + '.join(f'has_{c[0]}::INT' for c in dims.CONCEPTS)}) = 0 THEN 1.0::DOUBLE ELSE ({' + '.join(map(_covered, dims.CONCEPTS))})::DOUBLE / any_value({' + '.join(f'has_{c[0]}::INT' for c in dims.CONCEPTS)}) END AS coverage
    FROM {_SCORED} WHERE rank <= 10 GROUP BY qid))""")
def confidence(spark, sf_dir):
    r = materialized(ranked(spark, sf_dir).where("rank <= 10").select("qid", "rank", "semantic", F.col("document_id").alias("document"), F.col("provision_number").alias("number"), "concepts"), "ranked")
    return R.confidence(r, r.where("rank <= 5").withColumn("provision", F.concat("document", "number")))


#: The best rows as sources: every fifth without content, titles of some missing.
_SRC = f"""(SELECT *, upper(document_id) AS short, 'The Act of ' || document_id AS doc_title, CASE WHEN id % 3 <> 0 THEN title END AS t, CASE WHEN id % 4 <> 0 THEN page END AS p0, page + id % 2 AS p1, id % 17 = 0 AS suspicious FROM {_BEST} b WHERE id % 5 <> 0)"""
_LABEL = "upper(provision_type[1]) || provision_type[2:] || ' ' || provision_number || CASE WHEN coalesce(t, '') <> '' THEN ' — ' || t ELSE '' END"
_BLOCK = f"""'[Source ' || rank || ']' || chr(10) || 'Document: ' || doc_title || CASE WHEN contains(lower(doc_title), lower(short)) THEN '' ELSE ' (' || short || ')' END || chr(10) || 'Document ID: ' || document_id || chr(10) || 'Document type: legal_document' || chr(10)
  || 'Provision: ' || {_LABEL} || chr(10) || 'Pages: ' || CASE WHEN p0 IS NULL THEN page::VARCHAR WHEN p0 = p1 THEN p0::VARCHAR ELSE p0 || '-' || p1 END || chr(10) || 'Merged provision parts: ' || CASE WHEN part = 2 THEN 'True' ELSE 'False' END || chr(10)
  || 'Source chunks: [' || id || ', ' || id + 1 || ']' || chr(10) || 'Quality: ' || CASE WHEN suspicious THEN 'suspicious' ELSE 'acceptable' END || chr(10) || chr(10) || {QT.stripped_sql('content')}"""
_CONTEXTS = f"SELECT qid, string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM {_SRC} WHERE {QT.stripped_sql('content')} <> '' GROUP BY qid"


def _records(spark, sf_dir):
    c, none = F.col, F.lit(None).cast("string")
    x = _dups(spark, sf_dir).withColumns({
        "place": c("rank"), "document_title": F.concat(F.lit("The Act of "), "document_id"), "document_short_name": F.upper("document_id"), "document_type": none, "provision_title": F.when(c("id") % 3 != 0, c("title")),
        "page_start": F.when(c("id") % 4 != 0, c("page")), "page_end": (c("page") + c("id") % 2).cast("int"), "page_number": c("page"), "chunk_numbers": F.array("id", c("id") + 1), "merged": c("part") == 2, "page_quality_status": none,
        "suspicious": c("id") % 17 == 0, "content": F.when(c("id") % 5 != 0, c("content")),
    })
    return R.sources(x)


@query(_CONTEXTS)
def format_context(spark, sf_dir):
    """Each item's context from the records of its best rows."""
    return R.context(_records(spark, sf_dir))


@query(f"SELECT qid, rank AS place, {_LABEL} AS label, CASE WHEN suspicious THEN 'suspicious' ELSE 'acceptable' END AS quality FROM {_SRC} WHERE {QT.stripped_sql('content')} <> ''")
def source_records(spark, sf_dir):
    return _records(spark, sf_dir).select("qid", "place", "label", "quality")


_TASK = "CASE question_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in dims.TASKS.items()) + f" ELSE {lit(dims.TASKS['general'])} END"
_PROMPT = lit(dims.PROMPT)
for _k, _v in (("type", "question_type"), ("label", "'Medium'"), ("task", _TASK), ("context", "context"), ("question", "question")):
    _PROMPT = f"replace({_PROMPT}, '{{{_k}}}', {_v})"


@query(f"SELECT qid, md5({_PROMPT}) AS h FROM ({_CONTEXTS}) JOIN {_BQ} USING (qid) JOIN ({_of_items(QT._TYPE_SQL)}) USING (qid)")
def grounded_prompt(spark, sf_dir):
    p = _planned(spark, sf_dir).select("qid", "question", "question_type")
    x = format_context(spark, sf_dir).join(p, "qid")
    return x.select("qid", F.md5(R.prompt(F.col("question_type"), F.lit("Medium"), F.col("context"), F.col("question"))).alias("h"))


#: What items are answered with: forms of citing, around the item's text.
ANSWERS = ["See [Source 2] and [source 4]. {}", "{} No citation.", "[Source 1] {} [Source 9]"]
_ANS = f"(SELECT item_id AS qid, replace({lit(ANSWERS)}[item_id % 3 + 1], '{{}}', text) AS answer FROM benchmark)"


@query(f"""SELECT d.qid, d.id FROM {_DV} JOIN (SELECT qid, list_transform(regexp_extract_all(answer, '(?i)\\[source (\\d+)\\]', 1), lambda x: x::INT) AS cited FROM {_ANS}) a USING (qid) WHERE len(cited) = 0 OR list_contains(cited, d.rank)""")
def cited_sources(spark, sf_dir):
    answer = F.replace(picked(ANSWERS, F.col("item_id")), F.lit("{}"), F.col("text"))
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.regexp_extract_all(answer, F.lit(r"(?i)\[source (\d+)\]"), F.lit(1)).cast("array<int>").alias("cited"))
    return _dups(spark, sf_dir).join(S.maybe_broadcast(a), "qid").where((F.size("cited") == 0) | F.expr("array_contains(cited, rank)")).select("qid", "id")


_CITES = f"(SELECT qid, unnest({QT._SEC}) AS number, 'section' AS kind FROM {_BQ} UNION SELECT qid, unnest({QT._ARTS}), 'article' FROM {_BQ})"


@query(f"SELECT qid, kind, number, NOT EXISTS (SELECT 1 FROM {_LAW} c WHERE c.provision_number = q.number AND c.provision_type = q.kind) AS no_match FROM {_CITES} q")
def explicit_gate(spark, sf_dir):
    """Citations of the items' questions that no provision answers."""
    p = _planned(spark, sf_dir)
    q = p.select("qid", F.explode("sections").alias("number"), F.lit("section").alias("kind")).unionByName(p.select("qid", F.explode("articles").alias("number"), F.lit("article").alias("kind")))
    have = law(spark, sf_dir).select(F.col("provision_number").alias("number"), F.col("provision_type").alias("kind")).distinct().withColumn("there", F.lit(True))
    return q.join(have, ["number", "kind"], "left").select("qid", "kind", "number", F.col("there").isNull().alias("no_match"))
