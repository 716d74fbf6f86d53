"""Queries of the text, identity, planning and filter operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.plans import dims, questions as Q
from lexloom.plans.sqltext import canon, cited, frame, lit, norm, phrase, sql_replace, toks, values

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUESTIONS = [
    (1, "What is Section 302 of the Pakistan Penal Code?"), (2, "Compare theft and robbery under PPC sections 378, 390 and 392-A"),
    (3, "An accountant embezzled company funds entrusted to him, which sections apply?"), (4, "What is the punishment for murder?"),
    (5, "Define terrorism under the Anti-Terrorism Act"), (6, "Article 19 and Article 25A of the Constitution"), (7, "Do I have a right to a fair trial?"),
    (8, "Section 6(2)(b) of ATA and art. 10"), (9, "How long does an appeal take"), (10, "money laundering act section 3 or 4"),
    (11, "A mob started a riot and a stampede caused death of two persons in the market on a busy day"), (12, "Is kidnapping covered by sec 365-A(1)?"),
    (13, "   "), (14, "What constitutes abetment versus conspiracy"), (15, "She found a lost wallet on the road and later decided to keep it"),
]
#: What users say in conversations, each turn after one of the questions: planning has as
#: many questions as there are turns.
_QS = f"(SELECT conv_id * 1000 + turn AS qid, {lit([q for _, q in QUESTIONS])}[(conv_id + turn) % {len(QUESTIONS)} + 1] || ' ' || coalesce(text, '') AS question FROM conversations WHERE role = 'user') AS q"


def picked(values_: list[str], index) -> Column:
    """The value at a row's index, which goes round."""
    return F.element_at(F.array(*map(F.lit, values_)), (F.pmod(index, F.lit(len(values_))) + 1).cast("int"))


def asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    question = F.concat(picked([q for _, q in QUESTIONS], F.col("conv_id") + F.col("turn")), F.lit(" "), F.coalesce("text", F.lit("")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), question.alias("question"))


#: White space and word characters of all scripts for an engine whose classes are ASCII, and
#: the substitutions of dims without look-arounds, which it lacks. A place that shares a
#: neighbour with the one before is found by a second pass.
_SP, _W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", r"[\pL\pN_]"
_NW = r"[^\pL\pN_]"
SPLIT_WORDS = [(rf"([A-Za-z])-{_SP}*\n{_SP}*([a-z])", r"\1\2"), (rf"\b(\d+)-{_SP}*\n{_SP}*([A-Z])\.", r"\1-\2.")]
JOINED_WORDS = [
    dims.JOINED_WORDS[0], (re.sub(r"\(\?=\(\?:(.*)\)\\b\)$", r"((?:\1)\\b)", dims.JOINED_WORDS[1][0]), r"\1 \2"), (r"([A-Za-z])(\d{2,4})\b", r"\1 \2"),
]
CITATION_MARKS = [
    dims.CITATION_MARKS[0], (rf"({_W})\d+\[([A-Za-z(\"'])", r"\1 \2"), (rf"\]{_SP}*\d+([;,.:\s]|$)", r"\1"), (rf"(^|{_NW})\d+\[\]({_NW}|$)", r"\1\2"),
    *[(rf"(^|{_NW})\d+\[({_NW}|$)", r"\1\2")] * 2, *[(rf"(^|{_NW})\[\d+\]({_NW}|$)", r"\1\2")] * 2, (rf"(^|{_NW})\]([;,.:\s]|$)", r"\1\2"),
    (rf"(?i)({_W})\d+({_SP}+(?:but|provided|except|and)\b)", r"\1\2"), (rf"{_SP}{{2,}}", " "),
]
SPACING = [(rf"{_SP}+([,.;:?!])", r"\1"), (r"([,.;:?!])([A-Za-z])", r"\1 \2"), (rf"\({_SP}+", "("), (rf"{_SP}+\)", ")"), (r"([A-Za-z])(\d{2,4})\b", r"\1 \2"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")]


def stripped_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


_DOC = "SELECT doc_id, md5({x}) AS h, length({x}) AS n FROM documents"


def _hashed(df, c):
    return df.select("doc_id", F.md5(c).alias("h"), F.length(c).cast("long").alias("n"))


@query(_DOC.format(x="replace(replace(regexp_replace(replace(text, ' ', ' '), '[­​‌‍⁠﻿]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"))
def clean_whitespace(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), T.clean_whitespace(F.col("text")))


@query(_DOC.format(x=sql_replace("text", *SPLIT_WORDS)))
def dehyphenate(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents"), T.dehyphenate(F.col("text")))


_OCR = [(r"(?i)" + w.replace(",", "[,]"), r) for w, r in dims.OCR_REPAIRS.items()]
_OCR += JOINED_WORDS


#: Over benchmark items, whose letters are ASCII: word boundaries beside other letters differ
#: between the engines.
@query(f"SELECT item_id AS doc_id, md5(x) AS h, length(x) AS n FROM (SELECT item_id, {sql_replace('text', *_OCR)} AS x FROM benchmark)")
def ocr_repair(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return _hashed(b.withColumn("x", T.ocr_repair(F.col("text"))), F.col("x"))


#: Forms of lines of a legal text, around the lines of documents.
LINES = [
    "12[ (1) {}", "personal law115[but shall not {}] 115; more", "a [12] {}", "12[]", "]  14", "page 12", "Pakistan Penal Code (Act XLV of 1860)", "***", "302. Punishment of {}: Whoever commits", "CHAPTER XVI",
    "OF OFFENCES AFFECTING THE HUMAN BODY", "IV", "OF HURT", "1 Inserted by {}", "by Act of {}", "Whoever causes {}", "2 Substituted by Ordinance", "for the words {}", "", "Explanation 1 for {}",
    "See section 34 , and Sec. 35-A of {} ( note )", "7A. {}", "a 1[ 2[ {} and 2019 but", "{}",
]
_LN = f"""(SELECT doc_id AS doc, pos, replace({lit(LINES)}[(doc_id + pos) % {len(LINES)} + 1], '{{}}', line) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)) AS l"""


def lines(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return x.select("doc", F.col("pos").cast("long").alias("pos"), F.replace(picked(LINES, F.col("doc") + F.col("pos")), F.lit("{}"), F.col("line")).alias("line"))


@query(f"SELECT doc, pos, {stripped_sql(sql_replace('line', *CITATION_MARKS))} AS line FROM {_LN}")
def strip_citation_marks(spark, sf_dir):
    return lines(spark, sf_dir).select("doc", "pos", T.strip_citation_marks(F.col("line")).alias("line"))


@query(f"SELECT doc_id, md5(x) AS h, length(x) AS n FROM (SELECT doc_id, {stripped_sql(sql_replace('text', *SPACING))} AS x FROM documents)")
def punct_spacing(spark, sf_dir):
    return _hashed(table(spark, sf_dir, "documents").withColumn("x", T.punct_spacing(F.col("text"))), F.col("x"))


_ART = " OR ".join([f"regexp_matches(line, {lit('(?i)^(?:' + p + ')$')})" for p in [*dims.HEADER_PATTERNS, dims.FOOTER_PATTERN]] + [f"regexp_matches(line, {lit('^(?:' + p + ')$')})" for p in dims.ARTIFACT_PATTERNS])


@query(f"SELECT doc, pos, line FROM {_LN} WHERE NOT ({_ART})")
def drop_artifacts(spark, sf_dir):
    return lines(spark, sf_dir).where(~T.is_artifact(F.col("line"))).select("doc", "pos", "line")


_CUT = lit(rf'(?is)^(.+?):{_SP}*(["(\[\'\s]*{dims.BODY_STARTER}.*)$')
_FORM = lit("(?is)" + dims.SECTION_LINE.replace(r"\s", _SP))


@query(rf"""SELECT doc, pos, number, CASE WHEN body = '' THEN rest ELSE regexp_replace({stripped_sql('before')}, '[ ,;.\-]+$', '') END AS title, body FROM (
  SELECT *, regexp_extract(rest, {_CUT}, 1) AS before, regexp_extract(rest, {_CUT}, 2) AS body FROM (
    SELECT doc, pos, regexp_extract(line, {_FORM}, 1) AS number, regexp_extract(line, {_FORM}, 2) AS rest FROM {_LN}) WHERE rest <> '')""")
def section_headings(spark, sf_dir):
    """Number, title and what of the body stands in the heading's line."""
    from lexloom.operators.cleaning import section_heading

    return lines(spark, sf_dir).select("doc", "pos", section_heading(F.col("line")).alias("s")).where("s IS NOT NULL").select("doc", "pos", "s.*")


@query(rf"SELECT doc_id, array_to_string(list_distinct_keep, ',') AS refs FROM (SELECT qid AS doc_id, list_transform(list_filter(list_transform(range(1, len(r) + 1), lambda i: struct_pack(i := i, v := r[i])), lambda s: list_position(r, s.v) = s.i), lambda s: s.v) AS list_distinct_keep FROM (SELECT qid, list_transform(regexp_extract_all(question, '(?i){dims.LEGAL_REFERENCE}', 1), lambda x: upper(x)) AS r FROM {_QS}))")
def legal_refs(spark, sf_dir):
    found = F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit("(?i)" + dims.LEGAL_REFERENCE), F.lit(1)), F.upper))
    return asked(spark, sf_dir).select(F.col("qid").alias("doc_id"), F.array_join(found, ",").alias("refs"))


_TERM = ", ".join(f"CASE WHEN regexp_matches(t, {lit(r'(^|[^\pL\pN_])' + k + r'($|[^\pL\pN_])')}) THEN {lit(k)} END" for k in dims.LEGAL_TERMS)


@query(f"SELECT doc_id, array_to_string(list_slice(list_filter([{_TERM}], lambda k: k IS NOT NULL), 1, {dims.MOST_KEYWORDS}), ',') AS keywords FROM (SELECT doc_id, lower(text || ' ' || {lit(dims.LEGAL_TERMS)}[doc_id % {len(dims.LEGAL_TERMS)} + 1]) AS t FROM documents)")
def keywords(spark, sf_dir):
    """The legal terms of documents, each with one of the terms put at its end."""
    from lexloom.operators.cleaning import keywords as terms

    x = F.concat("text", F.lit(" "), picked(dims.LEGAL_TERMS, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(terms(x), ",").alias("keywords"))


@query(f"SELECT doc_id, md5({norm('text')}) AS normalized, len({toks('text')})::BIGINT AS n, md5(array_to_string({toks('text')}, ' ')) AS tokens FROM documents")
def tokenize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("x"), T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("x").alias("normalized"), F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("tokens"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS n_tokens, length(text)::BIGINT AS n_chars FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).cast("long").alias("n_tokens"), F.length("text").cast("long").alias("n_chars"))


#: Forms of citations, around the numbers of documents.
NUMBERS = ["{}-A", "{}A", "Section {}EE(2)(b)", "art. {}", "{}", " {} - A ", "sec. {};", "junk", "", "{}abcd", "{}(1)", "S. {}", "Articles {}a."]


@query(f"SELECT doc_id, {canon('raw')} AS number FROM (SELECT doc_id, replace({lit(NUMBERS)}[doc_id % {len(NUMBERS)} + 1], '{{}}', n_chars::VARCHAR) AS raw FROM documents)")
def canonical_number(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.canonical_number(F.replace(picked(NUMBERS, F.col("doc_id")), F.lit("{}"), F.col("n_chars").cast("string"))).alias("number"))


@query("SELECT doc_id, sha256(concat_ws('|', doc_id, lang, source, n_chars)) AS digest FROM documents")
def deterministic_id_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("doc_id", "lang", "source", "n_chars")]), 256).alias("digest"))


@query("""SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substring('89ab', (('0x' || h[17])::INT % 4) + 1, 1) || h[18:20], h[21:32]) AS point_id
  FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(concat_ws('|', doc_id, lang, source, n_chars)))) AS h FROM documents)""")
def deterministic_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.deterministic_id(*[F.col(c) for c in ("doc_id", "lang", "source", "n_chars")]).alias("point_id"))


@query("SELECT md5(text) AS id, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT vec_id, len(embedding) = 64 AS fits, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def vector_dim_check(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("fits"), F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)), 4).alias("norm"))


#: Names of files, of which each document is one.
FILES = ["Pakistan_Penal_Code-{}.pdf", "anti-terrorism-act-1997 {}.pdf", "The CONSTITUTION of Pakistan (1973) {}.pdf", "anti money laundering act 2010.{}.pdf", "{}.pdf"]
_FILES = f"(SELECT doc_id AS i, replace({lit(FILES)}[doc_id % 5 + 1], '{{}}', source) AS name FROM documents) AS f"
_FN = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\.[a-z0-9]+$', ''), '[_\-]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_ALIAS = [(i, d, a) for i, (d, own) in enumerate(dims.FILE_ALIASES) for a in own]


@query(f"SELECT f.i, arg_min(a.document_id, a.r) AS document_id FROM {_FILES} JOIN {values('a', 'r, document_id, alias', _ALIAS)} ON contains({_FN('f.name')}, {_FN('a.alias')}) GROUP BY f.i")
def resolve_document(spark, sf_dir):
    def plain(c):
        x = F.regexp_replace(F.lower(c), r"\.[a-z0-9]+$", "")
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[_\-]+", " "), "[^a-z0-9 ]+", " "), r"\s+", " "))

    name = F.replace(picked(FILES, F.col("doc_id")), F.lit("{}"), F.col("source"))
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), name.alias("name")).withColumn("n", plain(F.col("name")))
    a = frame(spark, "r INT, document_id STRING, alias STRING", _ALIAS).withColumn("a", plain(F.col("alias")))
    return f.join(F.broadcast(a), F.col("n").contains(F.col("a"))).groupBy("i").agg(F.min_by("document_id", "r").alias("document_id"))


#: Categories, of which each part is one, by its kind.
CATEGORIES = ["PPC Penal code", "CONST Constitution law", "TAX Tax matters", "AMLA Money laundering"]
_CATS = f"(SELECT p_partkey AS code, {lit(CATEGORIES)}[p_partkey % 4 + 1] || ' ' || p_type AS name FROM part) AS c"
_RT = [(d[0], f"{d[1]} {d[2]} {' '.join(d[4])}") for d in dims.ROUTES]


@query(f"SELECT c.code, r.document_id FROM {_CATS} JOIN {values('r', 'document_id, words', _RT)} ON len(list_intersect({toks('c.name')}, {toks('r.words')})) > 0")
def category_routes(spark, sf_dir):
    name = F.concat(picked(CATEGORIES, F.col("p_partkey")), F.lit(" "), "p_type")
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), T.tokens(name).alias("t"))
    r = frame(spark, "document_id STRING, words STRING", _RT).withColumn("u", T.tokens(F.col("words")))
    return c.join(F.broadcast(r), F.arrays_overlap("t", "u")).select("code", "document_id")


# ---- planning ------------------------------------------------------------------

_AL = [(i, d[0], a.replace("'", " ")) for i, d in enumerate(dims.ROUTES) for a in d[4]]
_CM = [(i, c[0], m.replace("'", " ")) for i, c in enumerate(dims.CONCEPTS) for m in c[1]]
_SM = [(m.replace("'", " "), w) for m, w in dims.SCENARIO_MARKERS.items()]
_HITS = "SELECT qid, coalesce(array_to_string(list_transform(list_sort(list_distinct(list_filter(list(CASE WHEN hit THEN lpad(r::VARCHAR, 3, '0') || name END), lambda x: x IS NOT NULL))), lambda x: x[4:]), ','), '') AS {out} FROM (SELECT q.qid, m.r, m.name, {on} AS hit FROM {qs} CROSS JOIN {ms}) GROUP BY qid"
_DOCS_SQL = _HITS.format(out="documents", on=phrase(norm("q.question"), "m.marker"), qs=_QS, ms=values("m", "r, name, marker", _AL))
_CONCEPTS_SQL = _HITS.format(out="concepts", on=phrase(norm("q.question"), "m.marker"), qs=_QS, ms=values("m", "r, name, marker", _CM))
_SCORE_SQL = f"SELECT q.qid, coalesce(sum(CASE WHEN {phrase(norm('q.question'), 'm.marker')} THEN m.w ELSE 0 END), 0)::BIGINT AS scenario_score FROM {_QS} CROSS JOIN {values('m', 'marker, w', _SM)} GROUP BY q.qid"


@query(_DOCS_SQL)
def detect_documents(spark, sf_dir):
    return Q.detect_documents(asked(spark, sf_dir)).select("qid", F.array_join("document_ids", ",").alias("documents"))


@query(_CONCEPTS_SQL)
def detect_concepts(spark, sf_dir):
    return Q.detect_concepts(asked(spark, sf_dir)).select("qid", F.array_join("concepts", ",").alias("concepts"))


@query(_SCORE_SQL)
def scenario_score(spark, sf_dir):
    return Q.scenario_score(asked(spark, sf_dir))


_DIST = lambda x: f"array_to_string(list_filter({x}, lambda v, i: list_position({x}, v) = i), ',')"
_SEC, _ARTS = cited("question", dims.SECTION_PREFIX), cited("question", dims.ARTICLE_PREFIX)


@query(f"SELECT qid, {_DIST(_SEC)} AS sections, {_DIST(_ARTS)} AS articles FROM {_QS}")
def extract_sections(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(T.citations(F.col("question"), dims.SECTION_PREFIX), ",").alias("sections"), F.array_join(T.citations(F.col("question"), dims.ARTICLE_PREFIX), ",").alias("articles"))


_SOME = lambda *p: " OR ".join(f"contains(n, '{x}')" for x in p)
_TYPE_SQL = f"""
SELECT qid, CASE WHEN {_SOME('difference between', 'compare', 'comparison', 'distinguish between')} OR regexp_matches(n, '\\b(?:vs|versus)\\b') THEN 'comparison'
  WHEN scenario_score >= 3 OR (len(string_split(n, ' ')) >= 18 AND concepts <> '') THEN 'fact_scenario'
  WHEN len(a) > 0 THEN 'article_lookup' WHEN len(s) > 0 THEN 'section_lookup'
  WHEN {_SOME('punishment', 'penalty', 'sentence', 'imprisonment', 'fine', 'punishable')} THEN 'punishment'
  WHEN {_SOME('definition', 'define', 'meaning of', 'legal meaning', 'what is', 'what constitutes', 'elements of')} THEN 'definition'
  WHEN {_SOME('right to', 'fundamental right', 'constitutional right')} THEN 'constitutional_right' ELSE 'general' END AS question_type
FROM (SELECT qid, {norm('question')} AS n, {_SEC} AS s, {_ARTS} AS a FROM {_QS}) JOIN ({_SCORE_SQL}) USING (qid) JOIN ({_CONCEPTS_SQL}) USING (qid)"""


@query(_TYPE_SQL)
def classify_question(spark, sf_dir):
    return Q.query_plan(asked(spark, sf_dir)).select("qid", "question_type")


_K = "CASE question_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.RETRIEVAL_K.items()) + " ELSE 0 END"
_F = "CASE question_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.FINAL_K.items()) + f" ELSE {dims.FINAL_K_ELSE} END"


@query(f"SELECT qid, greatest({_K}, 6)::INT AS retrieval_k, ({_F})::INT AS final_k FROM ({_TYPE_SQL})")
def retrieval_k(spark, sf_dir):
    return Q.query_plan(asked(spark, sf_dir)).select("qid", F.col("retrieval_k").cast("int"), F.col("final_k").cast("int"))


_KIND = "CASE WHEN articles <> '' AND sections = '' THEN 'article' WHEN sections <> '' AND articles = '' THEN 'section' WHEN articles = '' AND documents <> '' AND NOT contains(documents, ',') THEN CASE documents WHEN 'constitution_1973' THEN 'article' ELSE 'section' END END"


@query(f"SELECT qid, question_type, documents, concepts, sections, articles, {_KIND} AS provision_type FROM ({_TYPE_SQL}) JOIN ({_DOCS_SQL}) USING (qid) JOIN ({_CONCEPTS_SQL}) USING (qid) JOIN ({SQL['extract_sections']}) USING (qid)")
def query_plan(spark, sf_dir):
    p = Q.query_plan(asked(spark, sf_dir))
    j = lambda c, a: F.array_join(c, ",").alias(a)
    return p.select("qid", "question_type", j("document_ids", "documents"), j("concepts", "concepts"), j("sections", "sections"), j("articles", "articles"), "provision_type")


_NAME = "CASE d " + " ".join(f"WHEN {lit(d[0])} THEN {lit(d[2])}" for d in dims.ROUTES) + " END"
_DIST_LIST = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_CTX = lambda default: f"CASE WHEN ctx = '' THEN {lit(default)} ELSE ctx END"
_ON = "CASE c " + " ".join(f"WHEN {lit(c[0])} THEN {lit(c[2])}" for c in dims.CONCEPTS) + " END"
_EXPANDED = f"""
WITH p AS (SELECT q.qid, trim(question) AS o, question_type AS t, {_DIST_LIST(_SEC)} AS s, {_DIST_LIST(_ARTS)} AS a, array_to_string(list_transform(CASE WHEN documents = '' THEN []::VARCHAR[] ELSE string_split(documents, ',') END, lambda d: {_NAME}), ' ') AS ctx,
    CASE WHEN concepts = '' THEN []::VARCHAR[] ELSE string_split(concepts, ',') END AS cs
  FROM {_QS} JOIN ({_TYPE_SQL}) USING (qid) JOIN ({_DOCS_SQL}) USING (qid) JOIN ({_CONCEPTS_SQL}) USING (qid)),
e AS (SELECT qid, list_concat(list_concat([o], CASE
    WHEN t = 'section_lookup' AND len(s) > 0 THEN list_transform(s, lambda x: trim(ctx || ' Section ' || x || ' exact statutory text heading subsections explanation illustration conditions exceptions and punishment'))
    WHEN t = 'article_lookup' AND len(a) > 0 THEN list_transform(a, lambda x: trim({_CTX('Constitution of Pakistan')} || ' Article ' || x || ' exact constitutional text right scope limitation exception and remedy'))
    WHEN t = 'punishment' THEN [trim(ctx || ' ' || o || ' exact punishment imprisonment term fine conditions offence elements and applicable statutory provision')]
    WHEN t = 'definition' THEN [trim(ctx || ' ' || o || ' exact statutory definition legal elements conditions exceptions explanations and illustrations')]
    WHEN t = 'constitutional_right' THEN [trim({_CTX('Constitution of Pakistan')} || ' ' || o || ' relevant constitutional article right scope safeguard limitation and enforcement')]
    WHEN t = 'comparison' THEN [trim(ctx || ' ' || o || ' compare statutory definitions legal elements scope conditions exceptions and punishments')]
    WHEN t = 'fact_scenario' THEN [trim({_CTX('Pakistan criminal laws')} || ' legal provisions directly applicable to this factual scenario: ' || o)]
    ELSE [trim({_CTX('Pakistan laws')} || ' relevant legal provisions for: ' || o)] END), flatten(list_transform(cs, lambda c: {_ON}))) AS l FROM p),
u AS (SELECT qid, list_filter({_DIST_LIST('l')}, lambda v: v <> '') AS l FROM e)
SELECT qid, (unnest(range(1, len(l) + 1)) - 1)::INT AS query_index, unnest(l) AS query FROM u"""


@query(_EXPANDED)
def expand_queries(spark, sf_dir):
    return Q.expand_queries(Q.query_plan(asked(spark, sf_dir)))


_REF = rf"(?i)\b((?:{dims.SECTION_PREFIX}|{dims.ARTICLE_PREFIX}))\s*(\d+(?:(?:\s*-\s*[A-Za-z]+)|[A-Za-z]+)?)((?:\s*\(\s*[A-Za-z0-9-]+\s*\))*)"
_RX = lambda i: f"unnest(regexp_extract_all(question, {lit(_REF)}, {i}))"


@query(f"""SELECT qid, provision_type, base_number, path, component_type, min(pos) AS pos FROM (
  SELECT qid, pos, CASE WHEN lower(prefix) LIKE 'art%' THEN 'article' ELSE 'section' END AS provision_type, {canon('base')} AS base_number, array_to_string(p, '/') AS path,
    CASE len(p) WHEN 0 THEN NULL WHEN 1 THEN 'subsection' WHEN 2 THEN 'clause' WHEN 3 THEN 'paragraph' WHEN 4 THEN 'subparagraph' ELSE 'component' END AS component_type
  FROM (SELECT qid, prefix, base, pos - 1 AS pos, list_transform(regexp_extract_all(children, '\\(\\s*([A-Za-z0-9-]+)\\s*\\)', 1), lambda x: lower(x)) AS p FROM (
    SELECT qid, {_RX(1)} AS prefix, {_RX(2)} AS base, {_RX(3)} AS children, generate_subscripts(regexp_extract_all(question, {lit(_REF)}, 1), 1) AS pos FROM {_QS})))
  WHERE base_number IS NOT NULL GROUP BY ALL""")
def extract_references(spark, sf_dir):
    return Q.references(asked(spark, sf_dir))


_DH = "CASE c " + " ".join(f"WHEN {lit(c[0])} THEN {lit(c[3]) if c[3] else '[]::VARCHAR[]'}" for c in dims.CONCEPTS) + " END"
_SH = "CASE c " + " ".join(f"WHEN {lit(c[0])} THEN {lit(c[4]) if c[4] else '[]::VARCHAR[]'}" for c in dims.CONCEPTS) + " END"


@query(f"""WITH p AS (SELECT q.qid, question_type AS t, list_concat({_DIST_LIST(_SEC)}, {_DIST_LIST(_ARTS)}) AS n, CASE WHEN concepts = '' THEN []::VARCHAR[] ELSE string_split(concepts, ',') END AS cs
  FROM {_QS} JOIN ({_TYPE_SQL}) USING (qid) JOIN ({_CONCEPTS_SQL}) USING (qid)),
h AS (SELECT *, coalesce(flatten(list_transform(cs, lambda c: {_DH})), []) AS d, coalesce(flatten(list_transform(cs, lambda c: {_SH})), []) AS s FROM p),
u AS (SELECT *, {_DIST_LIST('s')} AS su, CASE WHEN t = 'fact_scenario' AND list_contains(cs, 'theft') THEN list_concat(n, list_sort(list_distinct(s))) ELSE n END AS nn FROM h)
SELECT qid, array_to_string({_DIST_LIST('d')}, ',') AS document_hints, array_to_string(su, ',') AS section_hints, array_to_string({_DIST_LIST('nn')}, ',') AS numbers FROM u""")
def concept_hints(spark, sf_dir):
    h = Q.concept_hints(Q.query_plan(asked(spark, sf_dir)))
    return h.select("qid", *[F.array_join(c, ",").alias(c) for c in ("document_hints", "section_hints", "numbers")])
