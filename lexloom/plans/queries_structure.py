"""Queries of the page, chunk and audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import cleaning as C
from lexloom.operators import ordered
from lexloom.operators import provisions as P
from lexloom.operators import structure as S
from lexloom.functions import text as T
from lexloom.plans import dims
from lexloom.plans.queries_search import _CHUNKS, chunks
from lexloom.plans.queries_text import _LN, lines, picked, stripped_sql, table
from lexloom.plans.sqltext import canon, frame, lit, values
from lexloom.sources import tables as SRC

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents as the pages of their source.
_PAGES = "(SELECT source AS document, doc_id AS page, text FROM documents)"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text")


_FOOT = lit("^(?:" + dims.FOOTER_PATTERN + ")$")


@query(f"""
WITH p AS (SELECT document, page, list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS x FROM {_PAGES} WHERE trim(text) <> ''),
e AS (SELECT document, page, unnest(list_distinct(list_filter(list_transform(list_filter(CASE WHEN len(x) > 8 THEN list_concat(x[1:4], x[-4:]) ELSE x END, lambda v: length(v) <= 180), lambda v: regexp_replace(lower(v), '\\s+', ' ', 'g')), lambda v: v <> '' AND NOT regexp_matches(v, {_FOOT})))) AS line FROM p),
n AS (SELECT document, count(*) AS pages FROM p GROUP BY document HAVING count(*) >= 3)
SELECT document, line, count(*) AS n_pages FROM e JOIN n USING (document) GROUP BY document, line, pages HAVING count(*) >= greatest(2, floor(pages * 0.05))""")
def repeated_edge_lines(spark, sf_dir):
    return S.repeated_edge_lines(pages(spark, sf_dir), share=0.05)


_KIND = f"""CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, {lit('(?i)' + dims.AMENDMENT_NOTE)}) THEN 'note'
  WHEN NOT regexp_matches(line, {lit('(?i)' + dims.CONTENT_START)}) AND (regexp_matches(line, {lit('(?i)' + dims.AMENDMENT_CONTINUATION)}) OR (length(line) <= 140 AND regexp_matches(line, '^["''“‘]'))) THEN 'more' ELSE 'text' END"""


@query(f"""SELECT doc, pos, line, max((kind = 'note')::INT) OVER (PARTITION BY doc, island) = 1 AND kind <> 'blank' AS removed FROM (
  SELECT *, sum((kind IN ('note', 'text'))::INT) OVER (PARTITION BY doc ORDER BY pos) AS island FROM (SELECT doc, pos, line, {_KIND} AS kind FROM {_LN}))""")
def amendment_regions(spark, sf_dir):
    return S.amendment_regions(lines(spark, sf_dir))


@query(r"""SELECT doc, pos, number, next AS title FROM (SELECT doc, pos, upper(regexp_extract(line, '(?i)^\s*(?:CHAPTER\s+)?([IVXLCDM]+)\s*$', 1)) AS number, lead(line) OVER (PARTITION BY doc ORDER BY pos) AS next FROM """ + _LN + r""")
WHERE number <> '' AND (regexp_matches(next, '(?i)^OF ') OR (length(regexp_replace(next, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(next, '[^A-Z]', '', 'g'))::DOUBLE / length(regexp_replace(next, '[^A-Za-z]', '', 'g')) >= 0.8))""")
def chapter_headings(spark, sf_dir):
    return S.chapter_headings(lines(spark, sf_dir))


_LINES = "(SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def doc_lines(spark, sf_dir):
    return S.exploded_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query(f"SELECT doc, paragraph::BIGINT AS paragraph, md5(string_agg(trim(line), ' ' ORDER BY pos)) AS h FROM (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY doc ORDER BY pos) AS paragraph FROM {_LINES}) WHERE trim(line) <> '' GROUP BY doc, paragraph")
def paragraphs(spark, sf_dir):
    return S.paragraphs(doc_lines(spark, sf_dir)).select("doc", "paragraph", F.md5("text").alias("h"))


@query()
def clean_page(spark, sf_dir):
    """Web pages as the pages of their host: the cleaned text, what was done and found."""
    host = F.coalesce(F.regexp_extract("url", "://([^/:]+)", 1), F.lit(""))
    cleaned = C.clean_pages(table(spark, sf_dir, "pages").select(host.alias("document"), F.col("page_id").alias("page"), F.col("html").alias("text")))
    return cleaned.select("document", F.col("page").alias("id"), "text", "counters.*", "found.*")


@query()
def clean_documents(spark, sf_dir):
    """Documents as the pages of their source, cleaned, with counters and findings."""
    return C.clean_pages(pages(spark, sf_dir)).select("document", "page", F.md5("text").alias("h"), "counters.*", "found.*")


@query()
def cleaning_counters(spark, sf_dir):
    """The 20 counters of each source, added up over its pages."""
    return C.cleaning_totals(C.clean_pages(pages(spark, sf_dir)))


def legal_pages(spark, sf_dir):
    """Documents as pages of laws: most open a provision, some a chapter, some go on."""
    i = F.col("doc_id")
    head = F.concat(F.when(i % 5 == 0, "CHAPTER II\n\nOF THE COURTS\n\n").otherwise(""), F.when(i % 4 != 3, F.concat((i % 90 + 1).cast("string"), F.lit(". "))).otherwise(""))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("document"), i.alias("page"), F.concat(head, "text").alias("text"))


def _laws(spark, sf_dir):
    """Kinds and names of the documents that sources stand for: small tables, a row each."""
    own = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("document")).distinct()
    kind = F.when(F.col("document").endswith("3"), "article").otherwise("section").alias("kind")
    return own.select("document", kind), own.select("document", F.concat("document", F.lit(".pdf")).alias("document_name"), F.concat(F.lit("The Act of "), "document").alias("document_title"), F.upper("document").alias("document_short_name"), F.lit("act").alias("document_type"))


@query()
def legal_blocks(spark, sf_dir):
    """Provisions of the laws: number, title over several lines, text, pages."""
    b = P.provision_blocks(legal_pages(spark, sf_dir), _laws(spark, sf_dir)[0])
    return b.select("document", "kind", "start.page", "start.pos", "number", "title", F.md5("text").alias("h"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "unsectioned")


@query()
def legal_chunks(spark, sf_dir):
    """Chunks of the cleaned laws with the metadata that the audit checks."""
    kinds, names = _laws(spark, sf_dir)
    # Of the findings only what provisions inherit, so that the others needn't be made.
    found = F.struct(*[F.col(f"found.{c}") for c in P.FOUND]).alias("found")
    cleaned = SRC.materialized(C.clean_pages(legal_pages(spark, sf_dir)).select("document", "page", "text", found), "cleaned")
    x = P.legal_chunks(cleaned.select("document", "page", "text"), cleaned.select("document", "page", "found"), kinds, names)
    return x.withColumn("h", F.md5("chunk")).drop("chunk")


_TITLE_STOP = " OR ".join(f"regexp_matches(v, {lit(p)})" for p in ["(?i)^" + dims.BODY_START, "(?i)" + dims.PROVISION, r"(?i)^\s*\((?:\d+|[a-z]|[ivxlcdm]+)\)\s+", r"(?i)^\s*Explanation(?:\s+\d+)?\s*[:.\-—–]?", r"(?i)^\s*Illustrations?\s*[:.\-—–]?\s*$", *(b for b in S.BOUNDARIES if "PREAMBLE" not in b)])


@query(f"""SELECT doc_id, f AS flags, CASE WHEN n = 0 THEN '' ELSE substring({stripped_sql("regexp_replace(array_to_string(list_filter(x[1:n], lambda v: v <> ''), ' '), '[ :.]+$', '')")}, 1, {dims.LONGEST_TITLE}) END AS title FROM (
  SELECT *, length(regexp_extract(f, {lit(P.TITLE_PART)})) AS n FROM (
    SELECT doc_id, x, array_to_string(list_transform(x, lambda v: CASE WHEN v = '' THEN 'b' WHEN {_TITLE_STOP} OR length(v) > {dims.LONGEST_TITLE_LINE} THEN 's' WHEN regexp_matches(v, '[.:]$') THEN 'e' ELSE 'c' END), '') AS f
    FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda v: {stripped_sql('v')}) AS x FROM documents WHERE text IS NOT NULL)))""")
def multiline_titles(spark, sf_dir):
    """What of each document's lines would belong to a title over several lines."""
    x = F.transform(F.split("text", "\n"), T.stripped)
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", x.alias("x")).withColumn("flags", F.array_join(F.transform("x", P.title_flags), ""))
    part = F.filter(F.slice("x", F.lit(1), F.length(F.regexp_extract("flags", P.TITLE_PART, 0))), lambda v: v != "")
    return d.select("doc_id", "flags", P.cut_title(part).alias("title"))


@query(f"SELECT doc, count(*) FILTER (regexp_matches(line, '^\\S+\\.$')) AS heads, sum(length(line))::BIGINT AS chars, count(*) FILTER (regexp_matches(line, '^\\S+\\.$')) > 0 AND sum(length(line)) < greatest(120, 45 * count(*) FILTER (regexp_matches(line, '^\\S+\\.$'))) AS heading_only FROM {_LINES} GROUP BY doc")
def body_presence(spark, sf_dir):
    h = F.sum(F.col("line").rlike(r"^\S+\.$").cast("long"))
    x = doc_lines(spark, sf_dir).groupBy("doc").agg(h.alias("heads"), F.sum(F.length("line")).alias("chars"))
    return x.withColumn("heading_only", (F.col("heads") > 0) & (F.col("chars") < F.greatest(F.lit(120), 45 * F.col("heads"))))


@query(f"SELECT source, sum(length(text) - length(replace(text, chr(10), '')))::BIGINT AS line_ends, sum(length(text) - length(replace(text, '|', '')))::BIGINT AS bars, count(*) AS pages FROM documents GROUP BY source")
def cleaning_stats(spark, sf_dir):
    n = lambda ch: F.sum(F.length("text") - F.length(F.replace("text", F.lit(ch)))).cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(n("\n").alias("line_ends"), n("|").alias("bars"), F.count(F.lit(1)).alias("pages"))


_OFF = f'SELECT document, page, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS start, (coalesce(sum(length(text) + 2) OVER w, 0) + length(text))::BIGINT AS "end" FROM {_PAGES} WINDOW w AS (PARTITION BY document ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'


@query(_OFF)
def page_offsets(spark, sf_dir):
    return S.page_offsets(pages(spark, sf_dir))


_SPANS = [(i, f"src{i % 5}", i * 900, i * 900 + 2500) for i in range(12)]


@query(f"SELECT s.document, s.span, array_to_string(list_transform(list_sort(list_distinct(list(o.page))), lambda x: x::VARCHAR), ',') AS pages FROM {values('s', 'span, document, start, stop', _SPANS)} JOIN ({_OFF}) o ON s.document = o.document AND o.\"end\" > s.start AND o.start < s.stop GROUP BY ALL")
def span_overlap_join(spark, sf_dir):
    s = frame(spark, "span LONG, document STRING, start LONG, end LONG", _SPANS)
    return S.pages_of(F.broadcast(s), page_offsets(spark, sf_dir))


#: Forms of lines of a law, around the lines of documents; # stands for a number.
_PROV = [
    "CHAPTER I", "#. Short title and {}", "(1) This Act may be {}", "(a) first {}", "(b) {}", "(2) It extends {}", "(a) again", "2[#. Definitions", "1Subs. by {}", "1990. A year", "Article #A - {}", "#. Substituted by law",
    "#-A: Powers of {}", "#. x", "Explanation", "#. [bracket", "PART II", "#. Appeals lie to {}",
]
_PV = f"""(SELECT doc_id AS doc, pos, replace(replace({lit(_PROV)}[(doc_id + pos) % {len(_PROV)} + 1], '{{}}', line), '#', (doc_id % 90 + pos)::VARCHAR) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)) AS l"""
_PAT = lit("(?i)" + dims.PROVISION.replace(r"([^\n]+)", r"(.+)"))
_NOT = " OR ".join(f"regexp_matches(title, {lit('(?i)^' + t)})" for t in dims.NO_TITLES)
_CANDS = rf"""SELECT doc, pos, number, title FROM (SELECT doc, pos, lower(regexp_extract(line, {_PAT}, 1)) AS label, {canon(f'regexp_extract(line, {_PAT}, 2)')} AS number, {stripped_sql(f'regexp_extract(line, {_PAT}, 3)')} AS title FROM {_PV})
WHERE label IN ('', 'section') AND regexp_matches(number, '^\d+[A-Z]{{0,2}}$') AND NOT regexp_matches(number, '^(?:1[89]\d\d|20\d\d|2100)$') AND length(title) BETWEEN 2 AND 600 AND NOT ({_NOT})"""


def _prov(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.replace(picked(_PROV, F.col("doc") + F.col("pos")), F.lit("{}"), F.col("line"))
    return x.select("doc", F.col("pos").cast("long").alias("pos"), F.replace(line, F.lit("#"), (F.col("doc") % 90 + F.col("pos")).cast("string")).alias("line"))


@query(_CANDS)
def provision_candidates(spark, sf_dir):
    return S.provision_candidates(_prov(spark, sf_dir))


@query("SELECT c.c_custkey AS doc, s.start, (SELECT min(b) FROM (VALUES (5), (12), (12), (30)) t(b) WHERE b > s.start AND b < s.stop)::BIGINT AS boundary FROM (SELECT c_custkey FROM customer) c CROSS JOIN (VALUES (0, 5), (3, 11), (5, 40), (12, 20), (30, 90)) s(start, stop)")
def next_boundary(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"))
    own = lambda col, rows: F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(col, r, strict=True)]) for r in rows]))
    starts = c.select("doc", own(["start", "end"], [(0, 5), (3, 11), (5, 40), (12, 20), (30, 90)]).alias("x")).select("doc", "x.*")
    return S.next_boundary(starts, c.select("doc", own(["b"], [(5,), (12,), (12,), (30,)]).alias("x")).select("doc", "x.*"))


@query(f'SELECT doc, number, title, pos AS first, lead(pos) OVER (PARTITION BY doc ORDER BY pos) - 1 AS "last" FROM ({_CANDS})')
def provision_blocks(spark, sf_dir):
    return S.provision_blocks(S.provision_candidates(_prov(spark, sf_dir)))


@query(f"""SELECT id, concat_ws(' | ', document_id, upper(provision_type[1]) || provision_type[2:] || ' ' || provision_number || ': T' || id, CASE WHEN subsection_path_key <> '' THEN upper(provision_type[1]) || provision_type[2:] || ' ' || provision_number || '(' || replace(subsection_path_key, '/', ')(') || ')' END) AS heading FROM {_CHUNKS}""")
def context_heading(spark, sf_dir):
    c, f = chunks(spark, sf_dir), F.col
    path = F.filter(F.split("subsection_path_key", "/"), lambda x: x != "")
    return c.select("id", S.context_heading(f("document_id"), f("provision_type"), f("provision_number"), F.concat(F.lit("T"), f("id")), path).alias("heading"))


@query(rf"""SELECT doc, pos, label, kind, path, array_to_string(path, '.') AS key FROM (SELECT doc, pos, label, kind, CASE WHEN kind = 'subsection' THEN [label] ELSE [last_value(CASE WHEN kind = 'subsection' THEN label END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), label] END AS path FROM (
  SELECT *, CASE WHEN regexp_matches(label, '^\d+$') THEN 'subsection' ELSE 'clause' END AS kind FROM (SELECT doc, pos, lower(regexp_extract(line, '^\s*\(([A-Za-z]+|\d+)\)', 1)) AS label FROM {_PV}) WHERE label <> '')) WHERE path[1] IS NOT NULL""")
def child_components(spark, sf_dir):
    return S.child_components(_prov(spark, sf_dir))


_BND = " OR ".join(f"regexp_matches(line, {lit(p)})" for p in S.BOUNDARIES)


@query(f"""SELECT doc, pos FROM (SELECT *, first_value(CASE WHEN trim(line) <> '' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM {_LN})
WHERE {_BND} OR (regexp_matches(line, {lit(S.ROMAN)}) AND coalesce(regexp_matches(next, {lit(S.BOUNDARIES[4])}) OR regexp_matches(next, {lit(S.BOUNDARIES[5])}), false))""")
def structural_boundaries(spark, sf_dir):
    return S.structural_boundaries(lines(spark, sf_dir))


_HEADS = ["number || '. ' || title", "'Section ' || number || '. ' || title", "'Section ' || number || ': ' || title"]
_BODY = "CASE " + " ".join(f"WHEN starts_with(lower(t), lower({h})) THEN substring(t, length({h}) + 1)" for h in _HEADS) + " ELSE t END"
_BODIES = "(SELECT doc_id, (doc_id % 40)::VARCHAR AS number, substring(text, 1, 12) AS title, CASE doc_id % 3 WHEN 0 THEN (doc_id % 40)::VARCHAR || '. ' || substring(text, 1, 12) || ': ' || substring(text, 13, 40 + doc_id % 90) WHEN 1 THEN 'section ' || (doc_id % 40)::VARCHAR || ': ' || substring(text, 1, 12) || substring(text, 13, doc_id % 150) ELSE substring(text, 1, doc_id % 160) END AS text FROM documents)"


@query(rf"SELECT doc_id, length(trim(regexp_replace(regexp_replace({_BODY}, '^[ :.—–\n]+', ''), '\s+', ' ', 'g'))) >= 80 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS body_present FROM (SELECT *, trim(text) AS t FROM {_BODIES})")
def provision_body(spark, sf_dir):
    i, t = F.col("doc_id"), F.col("text")
    number, title = (i % 40).cast("string"), F.substring("text", 1, 12)
    x = F.when(i % 3 == 0, F.concat(number, F.lit(". "), title, F.lit(": "), F.substring(t, F.lit(13), (40 + i % 90).cast("int"))))
    x = x.when(i % 3 == 1, F.concat(F.lit("section "), number, F.lit(": "), title, F.substring(t, F.lit(13), (i % 150).cast("int")))).otherwise(F.substring(t, F.lit(1), (i % 160).cast("int")))
    d = table(spark, sf_dir, "documents").select("doc_id", number.alias("number"), title.alias("title"), x.alias("x"))
    return d.select("doc_id", S.provision_body(F.lit("section"), F.col("number"), F.col("title"), F.col("x"), i % 11 == 0, i % 13 != 0).alias("body_present"))


@query()
def provision_chunks(spark, sf_dir):
    """Documents as provisions: lines are subsections, and every third one opens clauses."""
    line = lambda v, i: F.when(i % 3 == 0, F.concat(F.lit("("), (F.floor(i / 3) + 1).cast("string"), F.lit(") "), v)).otherwise(F.concat(F.lit("("), F.when(i % 3 == 1, "a").otherwise("b"), F.lit(") "), v))
    d = table(spark, sf_dir, "documents")
    return S.provision_chunks(d.select(F.col("doc_id").alias("id"), F.col("source").alias("short"), F.lit("section").alias("kind"), (F.col("doc_id") % 40).cast("string").alias("number"), F.lit("").alias("title"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("body")))


@query()
def split_chunks(spark, sf_dir):
    return S.split_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_WIN = "SELECT id, part::INT AS part, substring(text, part * 850 + 1, 1000) AS chunk FROM (SELECT doc_id AS id, text, unnest(range(0, greatest(1, ceil((length(text) - 150) / 850.0)::BIGINT))) AS part FROM documents)"


@query(f"SELECT id, part, md5(chunk) AS h FROM ({_WIN})")
def window_chunks(spark, sf_dir):
    return S.window_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "part", F.md5("chunk").alias("h"))


def _seq(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.col("document_id").alias("document"), F.col("provision_type").alias("kind"), F.when(F.col("id") % 17 != 0, F.col("provision_number")).alias("number"), F.col("id").alias("pos"))


_SEQ = f"(SELECT id, document_id AS document, provision_type AS kind, CASE WHEN id % 17 <> 0 THEN provision_number END AS number, id AS pos FROM {_CHUNKS})"


@query(f"SELECT id, chunk_number, n AS document_chunk_number, concat_ws('::', document, kind, coalesce(number, 'unsectioned'), 'chunk-' || n) AS chunk_id FROM (SELECT *, row_number() OVER (ORDER BY document, pos) AS chunk_number, (row_number() OVER (PARTITION BY document ORDER BY pos))::INT AS n FROM {_SEQ})")
def chunk_numbering(spark, sf_dir):
    return S.numbered(_seq(spark, sf_dir)).select("id", "chunk_number", "document_chunk_number", "chunk_id")


_SEQUENCE = f"""SELECT document, kind, number, (row_number() OVER w)::INT AS ordinal, lag(number) OVER w AS previous, lead(number) OVER w AS next FROM (SELECT document, kind, number, min(pos) AS pos FROM {_SEQ} WHERE number IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY document, kind ORDER BY pos)"""


@query(_SEQUENCE)
def provision_sequence(spark, sf_dir):
    return S.provision_sequence(_seq(spark, sf_dir))


@query("SELECT source, count(DISTINCT lang) > 1 AS mixed_lang, count(*) - count(DISTINCT doc_id) AS dup_pages, arg_min(lang, doc_id) AS first_lang FROM documents GROUP BY source")
def group_consistency(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.count_distinct("lang") > 1).alias("mixed_lang"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("dup_pages"), F.min_by("lang", "doc_id").alias("first_lang"))


@query(f"SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, page, part, subsection_path_key, chunk_id, id) AS place FROM {_CHUNKS}")
def source_order(spark, sf_dir):
    order = ["ordinal", "page", "part", "subsection_path_key", "chunk_id", "id"]
    x = ordered.ranged(chunks(spark, sf_dir).select("document_id", *order), "document_id", *order)
    return ordered.places(x, ["document_id"], order, "place").select("id", "place")


_SB = f"(SELECT document, kind, number, CASE WHEN ordinal % 3 = 0 THEN ordinal + 1 ELSE ordinal END AS ordinal, CASE WHEN ordinal % 2 = 0 THEN NULL ELSE previous END AS previous, next FROM ({_SEQUENCE}))"


@query(f"""SELECT document, kind, number, unnest(list_filter([CASE WHEN ordinal <> want THEN 'ordinal' END, CASE WHEN previous IS DISTINCT FROM p THEN 'previous' END, CASE WHEN next IS DISTINCT FROM n THEN 'next' END], lambda v: v IS NOT NULL)) AS field FROM (
  SELECT *, row_number() OVER w AS want, lag(number) OVER w AS p, lead(number) OVER w AS n FROM {_SB} WINDOW w AS (PARTITION BY document, kind ORDER BY ordinal, number))""")
def sequence_audit(spark, sf_dir):
    s = provision_sequence(spark, sf_dir)
    s = s.withColumn("previous", F.when(F.col("ordinal") % 2 != 0, F.col("previous"))).withColumn("ordinal", F.when(F.col("ordinal") % 3 == 0, F.col("ordinal") + 1).otherwise(F.col("ordinal")))
    return S.sequence_issues(s)


@query(f"SELECT document_id, count(*) AS chunks, count(*) FILTER (provision_type = 'section') AS sections, count(*) FILTER (heading_only_chunk) AS headings, count(DISTINCT provision_number) AS provisions, min(page) AS first_page, max(page) AS last_page FROM {_CHUNKS} GROUP BY document_id")
def chunk_summary(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("provision_type") == "section").alias("sections"), F.count_if("heading_only_chunk").alias("headings"), F.count_distinct("provision_number").alias("provisions"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(f"SELECT count(*) AS chunks, count(*) FILTER (heading_only_chunk) AS headings, count(*) FILTER (provision_body_present = false) AS bodiless, count(*) FILTER (component_type IS NOT NULL) AS children, count(*) FILTER (part > 1) AS split FROM {_CHUNKS}")
def ingest_diagnostics(spark, sf_dir):
    c = F.col
    return chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(c("heading_only_chunk")).alias("headings"), F.count_if(~c("provision_body_present")).alias("bodiless"), F.count_if(c("component_type").isNotNull()).alias("children"), F.count_if(c("part") > 1).alias("split"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def unexpected_points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().join(e, "id", "left_anti")


@query("SELECT doc_id FROM documents WHERE source <> 'src4' OR source IS NULL")
def delete_by_predicate(spark, sf_dir):
    """What deleting a document's points leaves."""
    return SRC.kept_rows(table(spark, sf_dir, "documents"), F.col("source") == "src4").select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def delete_duplicates(spark, sf_dir):
    """What deleting repeated points leaves."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.sha2("text", 256).alias("h"))
    return d.join(SRC.repeats(d, ["lang", "h"]), "id", "left_anti").select(F.col("id").alias("doc_id"))


@query("SELECT doc_id FROM documents WHERE source <> 'src4'")
def archived_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source <> 'src4'").select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def exact_duplicates(spark, sf_dir):
    from pyspark.sql import Window as W

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return d.withColumn("r", F.row_number().over(W.partitionBy("lang", "h").orderBy("doc_id"))).where("r > 1").select("doc_id")
