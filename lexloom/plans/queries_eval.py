"""Queries of the evaluation and relational operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import evaluation as E
from lexloom.operators.search import dot
from lexloom.plans.queries_text import picked, table
from lexloom.plans.sqltext import lit
from lexloom.sources.store import applied
from lexloom.sources.tables import coalesced_key, last_wins, materialized

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Conversations as samples: a turn retrieves a unit, two units are expected.
_RET = "(SELECT conv_id AS sample, turn AS pos, ((turn * 7 + conv_id) % 5)::VARCHAR AS unit FROM conversations)"
_EXP = "(SELECT DISTINCT conv_id AS sample, CASE WHEN conv_id % 10 = 0 THEN []::VARCHAR[] ELSE [(conv_id % 5)::VARCHAR, ((conv_id + 1) % 5)::VARCHAR] END AS units FROM conversations)"


def _retrieved(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("sample"), F.col("turn").alias("pos"), ((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("string").alias("unit"))


def _metrics(spark, sf_dir):
    c, i = table(spark, sf_dir, "conversations"), F.col("conv_id")
    units = F.when(i % 10 == 0, F.array().cast("array<string>")).otherwise(F.array((i % 5).cast("string"), ((i + 1) % 5).cast("string")))
    return E.sample_metrics(_retrieved(spark, sf_dir), c.select(i.alias("sample"), units.alias("units")).distinct(), 2)


_METRICS = f"""
SELECT sample, round(CASE WHEN len(got) > 0 THEN len(list_intersect(got, units))::DOUBLE / len(got) ELSE 0 END, 6) AS precision, round(CASE WHEN len(units) > 0 THEN len(list_intersect(got, units))::DOUBLE / len(units) ELSE 0 END, 6) AS recall,
  round(CASE WHEN len(units) > 0 THEN len(list_intersect(got[1:2], units))::DOUBLE / len(units) ELSE 0 END, 6) AS recall_at_k,
  round(coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(units, lambda u: list_position(got, u)), lambda p: p > 0)), 0), 6) AS reciprocal_rank,
  len(list_filter(units, lambda u: NOT list_contains(got[1:2], u))) = 0 AS hit_at_k, round(1 - len(got)::DOUBLE / n, 6) AS duplicate_rate
FROM {_EXP} JOIN (SELECT sample, list(unit ORDER BY pos) AS got FROM (SELECT sample, unit, min(pos) AS pos FROM {_RET} GROUP BY ALL) GROUP BY sample) USING (sample) JOIN (SELECT sample, count(*) AS n FROM {_RET} GROUP BY sample) USING (sample)"""


@query(_METRICS)
def sample_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


_CTX = "(SELECT conv_id AS sample, 'doc' || ((turn + conv_id) % 3)::VARCHAR AS document, CASE WHEN turn % 2 = 0 THEN 'section' ELSE 'article' END AS kind, (turn % 4)::VARCHAR || 'a' AS number FROM conversations)"
_WANT = "(SELECT conv_id AS sample, CASE WHEN conv_id % 7 <> 0 THEN 'doc' || (conv_id % 3)::VARCHAR END AS document, CASE WHEN conv_id % 4 = 0 THEN 'section' END AS kind, CASE WHEN conv_id % 5 = 0 THEN []::VARCHAR[] WHEN conv_id % 5 < 3 THEN ['0A'] ELSE ['0A', '3a'] END AS numbers, CASE WHEN conv_id % 2 = 0 THEN 'See [Source 1].' ELSE 'See source 1.' END AS response FROM conversations GROUP BY conv_id)"


@query(f"""SELECT w.sample, coalesce(bool_or(c.document = w.document), false) AS document_accuracy, len(any_value(w.numbers)) > 0 AND count(DISTINCT upper(c.number)) FILTER ((w.document IS NULL OR c.document = w.document) AND (w.kind IS NULL OR c.kind = w.kind) AND list_contains(list_transform(w.numbers, lambda x: upper(x)), upper(c.number))) = len(any_value(w.numbers)) AS provision_accuracy,
  regexp_matches(any_value(w.response), '\\[Source\\s+\\d+\\]') AS citation_presence FROM {_WANT} w LEFT JOIN {_CTX} c ON c.sample = w.sample GROUP BY w.sample""")
def answer_metrics(spark, sf_dir):
    c, i, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    doc = lambda x: F.concat(F.lit("doc"), (x % 3).cast("string"))
    ctx = c.select(i.alias("sample"), doc(t + i).alias("document"), F.when(t % 2 == 0, "section").otherwise("article").alias("kind"), F.concat((t % 4).cast("string"), F.lit("a")).alias("number"))
    numbers = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 < 3, F.array(F.lit("0A"))).otherwise(F.array(F.lit("0A"), F.lit("3a")))
    want = c.select("conv_id").distinct().select(i.alias("sample"), F.when(i % 7 != 0, doc(i)).alias("document"), F.when(i % 4 == 0, "section").alias("kind"), numbers.alias("numbers"), F.when(i % 2 == 0, "See [Source 1].").otherwise("See source 1.").alias("response"))
    return E.answer_metrics(ctx, want)


def _some(*names):
    def f(spark, sf_dir):
        return _metrics(spark, sf_dir).select("sample", *names)

    return f


for _q, _n in (("mrr", ["reciprocal_rank"]), ("recall_at_k", ["recall_at_k"]), ("precision_recall", ["precision", "recall", "duplicate_rate"]), ("hit_at_k", ["hit_at_k"])):
    QUERIES[_q], SQL[_q] = _some(*_n), f"SELECT sample, {', '.join(_n)} FROM ({_METRICS})"


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(quantile_cont({m}, 0.5), 6) AS p50, round(quantile_cont({m}, 0.95), 6) AS p95, count({m}) AS n FROM ({_METRICS})" for m in ("precision", "recall", "recall_at_k", "reciprocal_rank", "duplicate_rate")))
def eval_summary(spark, sf_dir):
    return E.summary(_metrics(spark, sf_dir), ["precision", "recall", "recall_at_k", "reciprocal_rank", "duplicate_rate"])


@query("SELECT coalesce(nullif(trim(CASE WHEN event_id % 50 = 0 THEN '  ' ELSE event_type END), ''), 'unknown') AS channel, count(*) AS events, count(*) FILTER (user_id % 10 = 0) AS failures, round(sum(value), 3) AS latency, sum(event_id % 4)::BIGINT AS accepted FROM events GROUP BY 1")
def channel_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = F.when(F.col("event_id") % 50 == 0, "  ").otherwise(F.col("event_type"))
    return E.channel_metrics(e.select(c.alias("channel"), F.when(F.col("user_id") % 10 == 0, "error").otherwise("success").alias("status"), F.col("value").alias("latency"), (F.col("event_id") % 4).alias("accepted")))


_REJ = "[" + ", ".join(map(lit, E.REJECTIONS)) + "]"
#: Forms of answers, around what assistants say.
ANSWERS = ["The section was NOT FOUND in {}", "Section 3 says {}", "The provided context does not contain {}", "ATA | Section 6: x\nbody {}\nPPC | Article 10A\nmore", "{}"]
_ANS = f"(SELECT conv_id * 1000 + turn AS id, replace({lit(ANSWERS)}[(conv_id + turn) % {len(ANSWERS)} + 1], '{{}}', text) AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL) AS a"


def answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.replace(picked(ANSWERS, F.col("conv_id") + F.col("turn")), F.lit("{}"), F.col("text")).alias("answer"))


@query(f"SELECT id, len(list_filter({_REJ}, lambda p: contains(lower(answer), p))) > 0 AS rejected FROM {_ANS}")
def rejection(spark, sf_dir):
    return answers(spark, sf_dir).select("id", E.rejected(F.col("answer")).alias("rejected"))


_HEADS = r"regexp_extract_all(answer, '(?m)^([A-Za-z]+) \| (?:Section|Article) (\d+[A-Z]*)', {})"


@query(f"SELECT id, pos, label, number FROM (SELECT id, unnest({_HEADS.format(1)}) AS label, unnest({_HEADS.format(2)}) AS number, (generate_subscripts({_HEADS.format(1)}, 1) - 1)::INT AS pos FROM {_ANS})")
def parse_contexts(spark, sf_dir):
    return E.parsed_contexts(answers(spark, sf_dir).withColumnRenamed("answer", "context"))


@query("SELECT a.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pairwise_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("id"), F.round(dot(F.col("embedding"), F.transform("other", lambda x: x.cast("double"))), 6).alias("cosine"))


@query("SELECT event_type, round(avg(CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END), 6) AS mean, count(*) FILTER (event_id % 6 <> 0) AS valid_rows FROM events GROUP BY event_type")
def valid_scores_avg(spark, sf_dir):
    v = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    x = table(spark, sf_dir, "events").select("event_type", F.nanvl(v, F.lit(None)).alias("v"))
    return x.groupBy("event_type").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("valid_rows"))


@query("SELECT conv_id, array_to_string(list_filter(list_transform(list(text ORDER BY turn)[1:2], lambda c: rtrim(substring(c, 1, 60))), lambda c: c <> ''), '|') AS contexts FROM conversations GROUP BY conv_id")
def truncate_contexts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("c"))
    return c.select("conv_id", F.array_join(E.truncated(F.col("c"), 2, 60), "|").alias("contexts"))


@query("SELECT conv_id, turn, md5(text) AS h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_prediction(spark, sf_dir):
    return E.latest(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", F.md5("text").alias("h"))


#: Items as samples with three keys each, and documents as predictions by one of them.
_SAMPLES = "(SELECT 'k' || item_id AS sample_key, 'i' || item_id AS sample_id, 'r' || item_id AS raw_id FROM benchmark) AS s"
_PREDS = "(SELECT substring('kir', doc_id % 3 + 1, 1) || CAST(doc_id % 77 AS VARCHAR) AS key, min(source) AS answer FROM documents GROUP BY 1)"


@query(f"SELECT s.sample_key, coalesce(p.answer, q.answer, r.answer) AS answer FROM {_SAMPLES} LEFT JOIN {_PREDS} p ON p.key = s.sample_key LEFT JOIN {_PREDS} q ON q.key = s.sample_id LEFT JOIN {_PREDS} r ON r.key = s.raw_id")
def resolve_prediction(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select(*[F.concat(F.lit(k), F.col("item_id")).alias(n) for k, n in (("k", "sample_key"), ("i", "sample_id"), ("r", "raw_id"))])
    key = F.concat(F.substring(F.lit("kir"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1)), F.col("doc_id") % 77)
    p = table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("source").alias("answer"))
    return E.resolve_predictions(s, p).select("sample_key", "answer")


#: Traces of sixteen events each, some of them cut, empty or not a list.
_CUT = "(event_id // 16) % 17"


@query(f"""SELECT coalesce(nullif(trim(CASE WHEN event_id % 50 = 0 THEN '  ' ELSE event_type END), ''), 'unknown') AS channel, count(*) AS events, count(*) FILTER (event_id % 9 = 0) AS failures, round(sum(value), 3) AS latency,
  sum(event_id % 4)::BIGINT AS accepted, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 6 END)::BIGINT AS raw, (SELECT count(DISTINCT event_id // 16) FROM events WHERE {_CUT} IN (1, 3)) AS malformed FROM events WHERE {_CUT} NOT IN (1, 2, 3) GROUP BY 1""")
def trace_metrics(spark, sf_dir):
    """Channels of all traces, and how many traces could not be read."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    one = F.struct(
        F.when(i % 50 == 0, "  ").otherwise(F.col("event_type")).alias("channel"), F.when(i % 9 == 0, "error").otherwise("success").alias("status"), F.col("value").alias("latency_ms"),
        (i % 4).alias("accepted_count"), F.when(i % 5 != 0, i % 6).alias("raw_count"), (i % 3).cast("int").alias("query_index"),
    )
    full = F.to_json(F.struct(F.lit("f12").alias("schema_version"), F.struct(F.collect_list(one).alias("events"), F.count(F.lit(1)).alias("candidate_count")).alias("retrieval")))
    t = e.groupBy(F.floor(i / 16).alias("id")).agg(full.alias("t"))
    kind = F.col("id") % 17
    t = t.select("id", F.when(kind == 1, F.substring("t", 1, 40)).when(kind == 2, F.lit('{"retrieval": {}}')).when(kind == 3, F.lit('{"retrieval": {"events": "none"}}')).otherwise(F.col("t")).alias("trace"))
    events, bad = E.trace_events(materialized(t, "traces"))
    return E.trace_metrics(events).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("malformed"))))


#: Users with a version and a quota used, and their events as changes to it.
_STATE = "(SELECT DISTINCT user_id, user_id % 3 AS version, user_id % 50 AS value FROM events)"
_MOVES = "(SELECT user_id, event_id % 7 AS base, event_id % 10 + 1 AS delta FROM events)"


@query(f"""WITH c AS (SELECT user_id, base, min(delta) AS delta, count(*) AS n FROM {_MOVES} GROUP BY ALL),
p AS (SELECT c.*, s.version, s.value, row_number() OVER (PARTITION BY c.user_id, base >= version ORDER BY base) - 1 AS place FROM c JOIN {_STATE} s USING (user_id)),
g AS (SELECT *, base >= version AND base = version + place AS good FROM p)
SELECT user_id, (any_value(version) + count(*) FILTER (good))::BIGINT AS version, (any_value(value) + coalesce(sum(delta) FILTER (good), 0))::BIGINT AS value, (sum(n) - count(*) FILTER (good))::BIGINT AS conflicts FROM g GROUP BY user_id""")
def keyed_changes(spark, sf_dir):
    """Quotas after all changes that were made on the version that they met."""
    e = table(spark, sf_dir, "events")
    state = e.select("user_id", (F.col("user_id") % 3).alias("version"), (F.col("user_id") % 50).alias("value")).distinct()
    return applied(state, e.select("user_id", (F.col("event_id") % 7).alias("base"), (F.col("event_id") % 10 + 1).alias("delta")), "user_id")


# ---- lists, counts, quotas: customers as users, orders as subscriptions and history,
# ---- nations as categories, regions as plans ------------------------------------------


@query("SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_users, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_subscriptions, (SELECT count(*) FROM documents) AS documents")
def dashboard_counts(spark, sf_dir):
    one = lambda t, *a: table(spark, sf_dir, t).agg(*a)
    n = F.count(F.lit(1))
    x = one("customer", n.alias("users"), F.count_if(F.col("c_acctbal") > 0).alias("active_users"))
    return x.crossJoin(one("orders", F.count_if(F.col("o_orderstatus") == "O").alias("open_subscriptions"))).crossJoin(one("documents", n.alias("documents")))


@query("SELECT n.n_name AS plan, count(c.c_custkey) AS subscribers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY n.n_name")
def plan_subscribers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select(F.col("n_name").alias("plan"), F.coalesce("k", F.lit(0)).cast("long").alias("subscribers"))


@query("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE lower(n.n_name) = lower(n.n_name) AND (contains(lower(c.c_name), '00') OR contains(lower(c.c_mktsegment), 'build')) AND c.c_acctbal > 0")
def users_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where((F.lower("c_name").contains("00") | F.lower("c_mktsegment").contains("build")) & (F.col("c_acctbal") > 0))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return c.join(n, "c_nationkey").orderBy(F.desc("c_custkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT o.o_orderkey, c.c_name, o.o_orderstatus FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' AND o.o_totalprice > 200000")
def subscriptions_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return o.join(c, "o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "c_name", "o_orderstatus")


@query("SELECT doc_id, source FROM documents WHERE lower(source) = 'src7' AND lang = 'en' AND (contains(lower(text), 'the') OR contains(lower(source), 'the'))")
def documents_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where((F.lower("source") == "src7") & (F.col("lang") == "en") & (F.lower("text").contains("the") | F.lower("source").contains("the")))
    return d.orderBy(F.desc("doc_id")).select("doc_id", "source")


@query("SELECT o_custkey, o_orderkey, r, total FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS r, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE r <= 5")
def recent_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    total = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"))
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.withColumn("r", F.row_number().over(w)).where("r <= 5")
    return last.join(total, "o_custkey").select("o_custkey", "o_orderkey", "r", "total")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5 OFFSET 5")
def page_2(spark, sf_dir):
    """The second page of five."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(5).limit(5).select("o_orderkey", "o_orderdate")


AS_OF = "1998-01-01 00:00:00"


@query(f"""SELECT o_orderkey, greatest(0, 50 - (o_custkey % 70)) AS remaining, o_orderstatus = 'F' OR TIMESTAMP '{AS_OF}' >= o_orderdate + INTERVAL 365 DAY AS expired,
  CASE WHEN TIMESTAMP '{AS_OF}' >= o_orderdate + CASE WHEN o_orderpriority LIKE '1%' THEN INTERVAL 30 DAY ELSE INTERVAL 365 DAY END THEN 0 ELSE o_custkey % 70 END AS used_after_reset FROM orders""")
def quota_state(spark, sf_dir):
    now, at = F.lit(AS_OF).cast("timestamp"), F.col("o_orderdate")
    used = F.col("o_custkey") % 70
    window = F.when(F.col("o_orderpriority").like("1%"), F.make_dt_interval(F.lit(30))).otherwise(F.make_dt_interval(F.lit(365)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.greatest(F.lit(0).cast("long"), 50 - used).alias("remaining"), ((F.col("o_orderstatus") == "F") | (now >= at + F.make_dt_interval(F.lit(365)))).alias("expired"),
        F.when(now >= at + window, F.lit(0).cast("long")).otherwise(used).alias("used_after_reset"),
    )


@query("SELECT user_id, max(event_id) FILTER (r = 1) AS latest, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY user_id")
def latest_per_user(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    x = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 10")
    return x.groupBy("user_id").agg(F.max(F.when(F.col("r") == 1, F.col("event_id"))).alias("latest"), F.count(F.lit(1)).alias("kept"))


@query("SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def category_in_use(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left_semi").select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)")
def unused_category(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(s, "n_nationkey", "left_anti").select("n_nationkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_size <= 25")
def active_plans(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size <= 25").orderBy(F.lower("p_name"), "p_partkey").select("p_partkey", "p_name")


#: Forms of passwords, with the numbers of customers.
PASSWORDS = ["Short1!", "LongEnough#{}", "no-upper-case-{}", "NO-LOWER-CASE-{}", "NoDigits-Here!!", "Has Space {}!", "NoSpecial12345{}"]
_PW = f"(SELECT c_custkey AS i, replace({lit(PASSWORDS)}[c_custkey % {len(PASSWORDS)} + 1], '{{}}', c_custkey::VARCHAR) AS p FROM customer)"


@query(f"SELECT i, length(p) >= 12 AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[^A-Za-z0-9\\s]') AND NOT regexp_matches(p, '\\s') AS strong FROM {_PW}")
def password_rules(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.replace(picked(PASSWORDS, F.col("c_custkey")), F.lit("{}"), F.col("c_custkey").cast("string")).alias("p"))
    p = F.col("p")
    return c.select("i", ((F.length(p) >= 12) & p.rlike("[A-Z]") & p.rlike("[a-z]") & p.rlike("[0-9]") & p.rlike(r"[^A-Za-z0-9\s]") & ~p.rlike(r"\s")).alias("strong"))


@query("SELECT page_id, url LIKE '%.pdf' AS suffix_ok, length(html) <= 20971520 AS size_ok, html LIKE '%PDF-%' AND left(html, 5) = '%PDF-' AS magic_ok, sha256(html) AS checksum FROM pages")
def upload_checks(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").endswith(".pdf").alias("suffix_ok"), (F.length(h) <= 20 << 20).alias("size_ok"), (F.left(h, F.lit(5)) == "%PDF-").alias("magic_ok"), F.sha2(h, 256).alias("checksum"))


@query("""SELECT key, arg_max(answer, pos) AS answer FROM (SELECT coalesce(nullif(trim(CASE WHEN doc_id % 3 <> 0 THEN lang || doc_id % 50 ELSE '  ' END), ''), nullif(trim(source), ''), nullif(trim(doc_id::VARCHAR), '')) AS key, doc_id AS pos, n_chars AS answer FROM documents) GROUP BY key""")
def coalesced_predictions(spark, sf_dir):
    """Predictions by the first of three names of their key; the last of a key wins."""
    d = table(spark, sf_dir, "documents")
    named = F.when(F.col("doc_id") % 3 != 0, F.concat("lang", (F.col("doc_id") % 50).cast("string"))).otherwise("  ")
    x = d.select(named.alias("sample_id"), "source", F.col("doc_id"), F.col("n_chars").alias("answer"))
    return last_wins(x.withColumn("key", coalesced_key("sample_id", "source", "doc_id")), "key", "doc_id").select("key", "answer")
