"""Queries of the metadata rules and audits, over documents seen as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import metadata as M
from lexloom.plans.queries_text import _SP as SPACE
from lexloom.plans.queries_text import stripped_sql, table
from lexloom.plans.sqltext import canon

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents as chunks of three of a source each, in one sequence of sections and one of
#: articles for every source.
_PLACED = """(SELECT *, max(o) OVER (PARTITION BY source, kind) AS last, row_number() OVER (PARTITION BY source, kind, o ORDER BY doc_id) AS part, count(*) OVER (PARTITION BY source, kind, o) AS parts FROM (
  SELECT *, dense_rank() OVER (PARTITION BY source, kind ORDER BY floor(n / 3.0)) AS o FROM (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'article' ELSE 'section' END AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) a) b)"""
_NUM = "CAST({o} AS VARCHAR) || CASE WHEN {o} % 5 = 0 THEN 'A' ELSE '' END"


def _num(o: str) -> str:
    return "(" + _NUM.format(o=o) + ")"


def _chunks(changed: dict[str, str]) -> str:
    """Chunks that meet every rule but for changed columns."""
    own = f"source || '::' || kind || '::' || {_num('o')}"
    near = lambda o, cond, x: f"CASE WHEN {cond} THEN {x.format(o=o)} END"
    columns = {
        "id": "doc_id", "document_id": "source", "document_name": "'name of ' || source", "document_title": "'title of ' || source", "document_short_name": "source", "document_type": "'act'",
        "chunk_id": f"source || '::' || kind || '::' || {_num('o')} || '::part-' || CAST(part AS VARCHAR) || '::chunk-' || CAST(n AS VARCHAR)",
        "provision_type": "kind", "provision_number": _num("o"), "base_provision_number": _num("o"), "provision_identity": own,
        "section_number": f"CASE WHEN kind = 'section' THEN {_num('o')} END", "article_number": f"CASE WHEN kind = 'article' THEN {_num('o')} END", "section_identity": f"CASE WHEN kind = 'section' THEN {own} END", "article_identity": f"CASE WHEN kind = 'article' THEN {own} END",
        "subsection_path": "CASE WHEN doc_id % 3 = 1 THEN ARRAY('1') WHEN doc_id % 3 = 2 THEN ARRAY('1', 'b') END", "subsection_path_key": "CASE WHEN doc_id % 3 = 1 THEN '1' WHEN doc_id % 3 = 2 THEN '1.b' END",
        "component_type": "CASE WHEN doc_id % 3 = 1 THEN 'subsection' WHEN doc_id % 3 = 2 THEN 'clause' END", "component_label": "CASE WHEN doc_id % 3 = 1 THEN '(1)' WHEN doc_id % 3 = 2 THEN '(b)' END",
        "chunk_number": "doc_id + 1", "document_chunk_number": "n", "page_start": "n", "page_end": "n + 1", "provision_part_number": "part", "provision_part_count": "parts", "provision_ordinal": "o", "source_pages": "ARRAY(n, n + 1)", "is_unsectioned_chunk": "false",
        "previous_provision_identity": near("(o - 1)", "o > 1", "source || '::' || kind || '::' || " + _num("{o}")), "next_provision_identity": near("(o + 1)", "o < last", "source || '::' || kind || '::' || " + _num("{o}")),
        "previous_provision_number": near("(o - 1)", "o > 1", _num("{o}")), "next_provision_number": near("(o + 1)", "o < last", _num("{o}")),
    }
    return "(SELECT " + ", ".join(f"{changed[c].replace('*', v) if c in changed else v} AS {c}" for c, v in columns.items()) + f" FROM {_PLACED} p)"


def _every(n: int, new: str) -> str:
    return f"CASE WHEN doc_id % {n} = 0 THEN {new} ELSE * END"


#: A column broken in every so many rows.
_ROWS = _chunks(
    {
        "document_id": _every(97, "' '"), "document_name": _every(23, "NULL"), "document_type": _every(89, "''"), "chunk_id": "CASE WHEN doc_id % 101 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'c' || CAST(doc_id AS VARCHAR) WHEN doc_id % 31 = 0 THEN source || 'x::section::1::part-9::chunk-0' ELSE * END",
        "provision_type": _every(103, "'rule'"), "provision_number": "CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 41 = 0 THEN '9-a' ELSE * END", "base_provision_number": "CASE WHEN doc_id % 43 = 0 THEN NULL WHEN doc_id % 47 = 0 THEN '7' ELSE * END",
        "provision_identity": "CASE WHEN doc_id % 53 = 0 THEN NULL WHEN doc_id % 59 = 0 THEN 'other' ELSE * END", "section_number": _every(61, "'6'"), "article_number": _every(67, "'6'"), "section_identity": _every(71, "'s'"), "article_identity": _every(73, "'a'"),
        "subsection_path": _every(79, "ARRAY_NONE"), "subsection_path_key": _every(83, "' '"), "component_type": _every(11, "'paragraph'"), "component_label": _every(13, "''"), "chunk_number": _every(17, "0"), "document_chunk_number": _every(107, "NULL"),
        "page_start": _every(19, "n + 2"), "page_end": _every(109, "-1"), "provision_part_number": _every(113, "9"), "provision_part_count": _every(127, "NULL"), "provision_ordinal": _every(131, "0"),
        "source_pages": "CASE WHEN doc_id % 137 = 0 THEN NULL WHEN doc_id % 139 = 0 THEN ARRAY(n, 0) ELSE * END", "is_unsectioned_chunk": _every(14, "true"),
    }
)
#: One rule of the collection broken in each of some sources.
_COLLECTION = _chunks(
    {
        "chunk_id": "CASE WHEN source = 'src7' AND n > 3 THEN 'src7::section::1::part-1::chunk-1' ELSE * END",
        "provision_ordinal": "CASE WHEN source = 'src1' AND o = 3 THEN 2 WHEN source = 'src2' AND o > 3 THEN o + 1 WHEN source = 'src3' AND doc_id % 11 = 0 THEN o + 1 ELSE * END",
        "previous_provision_identity": "CASE WHEN source = 'src4' AND o % 2 = 1 THEN NULL WHEN source = 'src8' AND o = 1 THEN 'x' ELSE * END", "next_provision_identity": "CASE WHEN source = 'src9' AND o = last THEN 'x' ELSE * END",
        "next_provision_number": "CASE WHEN source = 'src5' THEN 'x' ELSE * END", "previous_provision_number": "CASE WHEN source = 'src6' AND part = 1 THEN 'x' ELSE * END", "is_unsectioned_chunk": "source = 'src10'",
    }
)


def _duck(sql: str) -> str:
    return sql.replace("ARRAY_NONE", "[]::VARCHAR[]").replace("ARRAY(", "list_value(")


def _frame(spark, sf_dir, sql: str):
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_as_chunks")
    return spark.sql("SELECT * FROM " + sql.replace("FROM documents)", "FROM documents_as_chunks)").replace("VARCHAR", "STRING").replace("ARRAY_NONE", "cast(array() AS array<string>)"))


_T = lambda c: f"trim(coalesce({c}, ''))"
_POS = lambda c: f"coalesce({c} > 0, false)"
_RE = "regexp_extract(chunk_id, '^([^:]+)::(section|article)::([^:]+)::part-([0-9]+)::chunk-([0-9]+)$', {})"
_NAMED = _RE.format(1) + " <> ''"
_OK = f"{_T('document_id')} <> '' AND {_T('chunk_id')} <> ''"
_TYPED = _OK + " AND lower(provision_type) IN ('section', 'article')"
_IN = _TYPED + f" AND NOT is_unsectioned_chunk AND {_T('provision_number')} <> ''"
_CHILD = _IN + " AND len(subsection_path) > 0"
_SPEC = [
    *[("true", f"{_T(f)} = ''", M.MISSING, f, "blank") for f in M.TEXTS],
    (_OK, "len(subsection_path) = 0", M.CONSISTENCY, "subsection_path", "empty"), *[(_OK, f"{f} IS NOT NULL AND trim({f}) = ''", M.TYPE, f, "blank") for f in M.LABELS],
    *[(_OK, f"NOT {_POS(f)}", M.TYPE, f, "positive") for f in M.COUNTS], (_OK, f"NOT is_unsectioned_chunk AND NOT {_POS('provision_ordinal')}", M.TYPE, "provision_ordinal", "positive"),
    (_OK, "source_pages IS NULL OR len(source_pages) = 0 OR len(list_filter(source_pages, lambda p: p IS NULL OR p <= 0)) > 0", M.TYPE, "source_pages", "positive"),
    (_OK, "page_start > 0 AND page_end > 0 AND page_start > page_end", M.CONSISTENCY, "page_start", "order"), (_OK, "provision_part_number > 0 AND provision_part_count > 0 AND provision_part_number > provision_part_count", M.CONSISTENCY, "provision_part_number", "order"),
    (_OK, "lower(provision_type) NOT IN ('section', 'article')", M.TYPE, "provision_type", "known"),
    (_TYPED, f"is_unsectioned_chunk AND {_T('provision_identity')} <> {_T('document_id')} || '::' || lower(provision_type) || '::unsectioned'", M.CONSISTENCY, "provision_identity", "unsectioned"),
    *[(_TYPED, f"is_unsectioned_chunk AND {_T(f)} <> ''", M.CONSISTENCY, f, "unsectioned") for f in ("provision_number", "base_provision_number")], (_TYPED, "is_unsectioned_chunk AND provision_ordinal IS NOT NULL", M.CONSISTENCY, "provision_ordinal", "unsectioned"),
    (_TYPED, f"NOT is_unsectioned_chunk AND {_T('provision_number')} = ''", M.MISSING, "provision_number", "blank"),
    (_IN, f"({canon('provision_number')}) IS DISTINCT FROM provision_number", M.CONSISTENCY, "provision_number", "canonical"), (_IN, f"{_T('provision_identity')} = ''", M.MISSING, "provision_identity", "blank"),
    (_IN, f"{_T('provision_identity')} <> '' AND provision_identity <> {_T('document_id')} || '::' || provision_type || '::' || coalesce(nullif({_T('base_provision_number')}, ''), provision_number)", M.CONSISTENCY, "provision_identity", "parent"),
    (_IN, f"{_T('base_provision_number')} = ''", M.MISSING, "base_provision_number", "blank"), (_IN, f"{_T('base_provision_number')} NOT IN ('', provision_number)", M.CONSISTENCY, "base_provision_number", "mirror"),
    *[(_IN, f"provision_type = '{a}' AND {a}_number IS DISTINCT FROM provision_number", M.CONSISTENCY, f"{a}_number", "mirror") for a in ("section", "article")],
    *[(_IN, f"provision_type <> '{a}' AND {a}_number IS NOT NULL", M.CONSISTENCY, f"{a}_number", "other type") for a in ("section", "article")],
    *[(_IN, f"provision_type = '{a}' AND {a}_identity <> {_T('provision_identity')}", M.CONSISTENCY, f"{a}_identity", "mirror") for a in ("section", "article")],
    *[(_IN, f"provision_type <> '{a}' AND {a}_identity IS NOT NULL", M.CONSISTENCY, f"{a}_identity", "other type") for a in ("section", "article")],
    (_IN, "provision_ordinal <= 0", M.TYPE, "provision_ordinal", "stored"), (_CHILD, f"{_T('base_provision_number')} = ''", M.CONSISTENCY, "base_provision_number", "child"),
    (_CHILD, "subsection_path_key IS DISTINCT FROM array_to_string(subsection_path, '.')", M.CONSISTENCY, "subsection_path_key", "join"),
    (_CHILD, "component_type IS DISTINCT FROM CASE len(subsection_path) WHEN 1 THEN 'subsection' WHEN 2 THEN 'clause' ELSE 'paragraph' END", M.CONSISTENCY, "component_type", "depth"),
    (_CHILD, "component_label IS DISTINCT FROM '(' || subsection_path[-1] || ')'", M.CONSISTENCY, "component_label", "last"), (_IN, f"NOT {_NAMED}", M.CONSISTENCY, "chunk_id", "form"),
    *[(_IN, f"{_NAMED} AND {_RE.format(i)} <> {x}", M.CONSISTENCY, "chunk_id", r) for i, x, r in ((1, _T("document_id"), "document"), (2, "lower(provision_type)", "type"), (3, "provision_number", "number"))],
    *[(_IN, f"{_NAMED} AND {_POS(f)} AND {_RE.format(i)}::BIGINT <> {f}", M.CONSISTENCY, "chunk_id", r) for i, f, r in ((4, "provision_part_number", "part"), (5, "document_chunk_number", "chunk"))],
]


def _row_sql(view: str) -> str:
    made = ", ".join(f"CASE WHEN ({scope}) AND ({cond}) THEN {{'category': '{c}', 'field': '{f}', 'rule': '{r}'}} END" for scope, cond, c, f, r in _SPEC)
    return f"SELECT id, x.category, x.field, x.rule FROM (SELECT id, unnest(list_filter([{made}], lambda v: v IS NOT NULL)) AS x FROM {_duck(view)})"


@query(_row_sql(_ROWS))
def row_rules(spark, sf_dir):
    return M.row_issues(_frame(spark, sf_dir, _ROWS))


@query(f"SELECT category, field, count(*) AS n FROM ({_row_sql(_ROWS)}) GROUP BY ALL")
def audit_counts(spark, sf_dir):
    return row_rules(spark, sf_dir).groupBy("category", "field").agg(F.count(F.lit(1)).alias("n"))


_COLL_SQL = f"""
WITH c AS (SELECT * FROM {_duck(_COLLECTION)}),
r AS (SELECT * FROM c WHERE NOT is_unsectioned_chunk),
g AS (SELECT document_id AS d, provision_type AS k, provision_identity AS own, count(DISTINCT provision_ordinal) AS kinds, min(provision_ordinal) AS o, arg_min(provision_number, id) AS num FROM r GROUP BY ALL),
s AS (SELECT *, row_number() OVER w AS spot, count(*) OVER (PARTITION BY d, k, o) AS same, lag(own) OVER w AS p, lead(own) OVER w AS n, lag(num) OVER w AS pn, lead(num) OVER w AS nn FROM g WHERE kinds = 1 WINDOW w AS (PARTITION BY d, k ORDER BY o, own)),
t AS (SELECT *, max((spot <> o)::INT) OVER (PARTITION BY d, k) AS gap FROM s),
f AS (SELECT r.*, t.* FROM r JOIN t ON d = document_id AND k = provision_type AND own = provision_identity)
SELECT id, 'consistency_error' AS category, field, rule FROM (
  SELECT id, 'chunk_id' AS field, 'unique' AS rule FROM (SELECT id, row_number() OVER (PARTITION BY chunk_id ORDER BY id) AS r FROM c) WHERE r > 1
  UNION ALL SELECT id, 'provision_ordinal', 'one' FROM r JOIN g ON d = document_id AND k = provision_type AND own = provision_identity WHERE kinds <> 1
  UNION ALL SELECT id, 'provision_ordinal', 'shared' FROM f WHERE same > 1
  UNION ALL SELECT id, 'provision_ordinal', 'consecutive' FROM f WHERE gap = 1
  UNION ALL SELECT id, 'previous_provision_identity', 'order' FROM f WHERE gap = 0 AND previous_provision_identity IS DISTINCT FROM p
  UNION ALL SELECT id, 'next_provision_identity', 'order' FROM f WHERE gap = 0 AND next_provision_identity IS DISTINCT FROM n
  UNION ALL SELECT id, 'previous_provision_number', 'order' FROM f WHERE gap = 0 AND previous_provision_number IS DISTINCT FROM pn
  UNION ALL SELECT id, 'next_provision_number', 'order' FROM f WHERE gap = 0 AND next_provision_number IS DISTINCT FROM nn
  UNION ALL SELECT id, 'previous_provision_identity', 'first' FROM f WHERE gap = 0 AND p IS NULL AND previous_provision_identity IS NOT NULL
  UNION ALL SELECT id, 'next_provision_identity', 'last' FROM f WHERE gap = 0 AND n IS NULL AND next_provision_identity IS NOT NULL)"""


@query(_COLL_SQL)
def collection_audit(spark, sf_dir):
    return M.collection_issues(_frame(spark, sf_dir, _COLLECTION))


_ALL_SQL = f"SELECT * FROM ({_row_sql(_COLLECTION)}) UNION ALL SELECT * FROM ({_COLL_SQL})"


@query(f"""SELECT (SELECT count(*) FROM documents) AS total_points, count(DISTINCT id) AS invalid_points, count(*) FILTER (category = 'missing_required_field') AS missing_required_field, count(*) FILTER (category = 'type_error') AS type_error,
  count(*) FILTER (category = 'consistency_error') AS consistency_error, (SELECT count(*) FROM documents) - count(DISTINCT id) AS valid_points FROM ({_ALL_SQL})""")
def audit_summary(spark, sf_dir):
    c = _frame(spark, sf_dir, _COLLECTION)
    return M.audit_summary(c, M.audit(c))


@query(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY id, category, field, rule) AS place FROM ({_row_sql(_ROWS)}))
SELECT place::INT AS place, '- Chunk ' || id || ': ' || category || ' ' || field || ' ' || rule AS error FROM e WHERE place <= 25 UNION ALL SELECT 26, '- ...and ' || (count(*) - 25) || ' more validation errors' FROM e HAVING count(*) > 25""")
def ingest_gate(spark, sf_dir):
    """The first errors that stop an ingest: a report of 25, and the number of others."""
    return M.ingest_gate(row_rules(spark, sf_dir))


@query(f"""SELECT v.n AS other_dimension, true AS metric_matches, CASE WHEN v.n = 0 THEN a.n END AS invalid_points, v.n = 0 AND a.n = 0 AS compatible
FROM (SELECT count(*) FILTER (len(embedding) IS DISTINCT FROM 64) AS n FROM embeddings) v, (SELECT count(DISTINCT id) AS n FROM ({_ALL_SQL})) a""")
def collection_compatibility(spark, sf_dir):
    c = _frame(spark, sf_dir, _COLLECTION)
    return M.compatibility(table(spark, sf_dir, "embeddings"), c, M.audit(c), dimension=64, metric="Cosine", stored_metric="cosine")


# ---- ids, keys and filters over the same chunks -----------------------------------------

#: What a chunk's id is made of, in order; absent values are empty, parts default to 1.
_ID = ["document_id", "document_name", "document_type", "provision_type", "provision_number", "provision_identity", "provision_part_number", "provision_part_count", "document_chunk_number", "chunk_id", "page_start", "page_end"]
_ID_SQL = ", ".join(f"coalesce({c}::VARCHAR, '{1 if 'part' in c else ''}')" for c in _ID)


def _with_text(spark, sf_dir, sql: str):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return _frame(spark, sf_dir, sql).join(d, "id")


@query(f"""SELECT id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substring('89ab', (('0x' || h[17])::INT % 4) + 1, 1) || h[18:20], h[21:32]) AS point_id FROM (
  SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(sha256(concat_ws('|', {_ID_SQL}, coalesce(array_to_string(source_pages, ','), ''), {stripped_sql('text')})))) AS h
  FROM {_duck(_ROWS)} c JOIN documents d ON d.doc_id = c.id)""")
def chunk_point_id(spark, sf_dir):
    """The id of a chunk by its fourteen fields, the same for the same chunk."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("1" if "part" in c else "")) for c in _ID]
    pages = F.coalesce(F.array_join(F.col("source_pages").cast("array<string>"), ","), F.lit(""))
    return _with_text(spark, sf_dir, _ROWS).select("id", T.deterministic_id(*parts, pages, T.stripped(F.col("text"))).alias("point_id"))


@query(f"SELECT doc_id, md5({stripped_sql('x')}) AS h FROM (SELECT doc_id, regexp_replace(text, '{SPACE}+', ' ', 'g') AS x FROM documents)")
def embedding_text(spark, sf_dir):
    """Texts as they are embedded: white space as single spaces."""
    x = F.regexp_replace("text", T.uni(r"\s+"), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.stripped(x)).alias("h"))


@query(f"""SELECT id, coalesce(nullif({_T('chunk_id')}, ''), document_id || '#' || document_chunk_number) AS document_key,
  CASE WHEN {_T('provision_number')} <> '' THEN concat_ws('::', document_id, lower(provision_type), provision_number) ELSE concat_ws('::', document_id, 'unsectioned', document_chunk_number) END AS provision_key FROM {_duck(_ROWS)}""")
def chunk_keys(spark, sf_dir):
    """What tells chunks apart, and what groups them into provisions: rows without a number
    stand alone."""
    c = _frame(spark, sf_dir, _ROWS)
    own = lambda n: F.nullif(F.trim(F.coalesce(n, F.lit(""))), F.lit(""))
    key = F.coalesce(own("chunk_id"), F.concat("document_id", F.lit("#"), "document_chunk_number"))
    group = F.when(own("provision_number").isNotNull(), F.concat_ws("::", "document_id", F.lower("provision_type"), "provision_number")).otherwise(F.concat_ws("::", "document_id", F.lit("unsectioned"), "document_chunk_number"))
    return c.select("id", key.alias("document_key"), group.alias("provision_key"))


@query(f"SELECT id FROM {_duck(_COLLECTION)} WHERE provision_ordinal BETWEEN 2 AND 4 AND provision_type = 'section' AND document_id IN ('src0', 'src1', 'src5')")
def ordinal_filter(spark, sf_dir):
    c = F.col
    return _frame(spark, sf_dir, _COLLECTION).where(c("provision_ordinal").between(2, 4) & (c("provision_type") == "section") & c("document_id").isin("src0", "src1", "src5")).select("id")


@query(f"SELECT id FROM {_duck(_COLLECTION)} WHERE article_number IN ('1', '2', '5A') AND document_id = 'src3' AND coalesce(is_unsectioned_chunk, false) = false")
def article_filter(spark, sf_dir):
    """Articles by number in the one document that has them by default."""
    c = F.col
    return _frame(spark, sf_dir, _COLLECTION).where(c("article_number").isin("1", "2", "5A") & (c("document_id") == "src3") & ~F.coalesce("is_unsectioned_chunk", F.lit(False))).select("id")


@query(f"""SELECT id, lower(provision_type) = 'section' AND {canon('provision_number')} = '2' AND document_id <> 'src9' AS in_route,
  coalesce(subsection_path_key, '') = '1' AND base_provision_number = '2' AS is_child, coalesce(subsection_path_key, '') = '' AND component_type IS NULL AS is_parent FROM {_duck(_COLLECTION)}""")
def route_check(spark, sf_dir):
    """Retrieved chunks looked at again: whether the route meant them, as a child or parent."""
    c, none = F.col, F.lit("")
    route = (F.lower("provision_type") == "section") & (T.canonical_number(c("provision_number")) == "2") & (c("document_id") != "src9")
    child, parent = (F.coalesce("subsection_path_key", none) == "1") & (c("base_provision_number") == "2"), (F.coalesce("subsection_path_key", none) == "") & c("component_type").isNull()
    return _frame(spark, sf_dir, _COLLECTION).select("id", route.alias("in_route"), child.alias("is_child"), parent.alias("is_parent"))


@query(f"SELECT id, chunk_id, subsection_path_key FROM {_duck(_COLLECTION)} WHERE document_id = 'src2' AND base_provision_number IN ('1', '2', '3') AND subsection_path_key = '1' ORDER BY id LIMIT 20")
def payload_spot_check(spark, sf_dir):
    """A look at twenty stored rows of one document's provisions and path."""
    c = F.col
    x = _frame(spark, sf_dir, _COLLECTION).where((c("document_id") == "src2") & c("base_provision_number").isin("1", "2", "3") & (c("subsection_path_key") == "1"))
    return x.select("id", "chunk_id", "subsection_path_key").orderBy("id").limit(20)
