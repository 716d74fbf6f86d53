"""Batches that resume, and changes by key, against what they should leave."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lexloom.operators import evaluation, rank
from lexloom.sources import store


def rows_of(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_a_killed_run_resumes_without_doubles(spark, tmp_path):
    table = str(tmp_path / "t")
    df = spark.createDataFrame([(k, "x%d" % k) for k in range(200)] + [(5, "x5"), (None, "no")], "id LONG, v STRING").repartition(3)
    calls = []

    def dies(own, path):
        calls.append(path)
        if len(calls) == 4:
            own.limit(3).write.parquet(path + "/_temporary/half")
            raise ValueError("killed")
        own.write.mode("overwrite").parquet(path)

    with pytest.raises(RuntimeError, match="batch 3 of 8"):
        store.store_batches(df, table, "id", 8, write=dies)
    assert store.batch_log(spark, table) == [0, 1, 2] and len(rows_of(store.stored(spark, table))) < 200
    assert store.store_batches(df, table, "id", 8) == [3, 4, 5, 6, 7] and store.store_batches(df, table, "id", 8) == []
    assert rows_of(store.stored(spark, table)) == [(k, "x%d" % k) for k in range(200)]


def test_transient_failures_are_tried_again(spark, tmp_path):
    table, failures, waits = str(tmp_path / "t"), ["Connection reset by peer", "read timed out"], []

    def flaky(own, path):
        if failures:
            raise OSError(failures.pop())
        own.write.mode("overwrite").parquet(path)

    assert store.store_batches(spark.range(5), table, "id", 1, write=flaky, sleep=waits.append) == [0] and waits == [2, 4]
    failures += ["I/O error"] * 3
    with pytest.raises(RuntimeError):
        store.store_batches(spark.range(5), str(tmp_path / "u"), "id", 1, write=flaky, sleep=waits.append)
    assert store.stored(spark, str(tmp_path / "u")) is None and not store.is_transient(ValueError("no such column")) and store.wait_before(9) == 20


def test_changes_match_a_loop(spark):
    r = random.Random(2)
    state = {"k%d" % k: (r.randrange(4), r.randrange(50)) for k in range(30)}
    changes = [("k%d" % r.randrange(40), r.randrange(6), r.randrange(1, 9)) for _ in range(150)]
    want = {}
    for k in {*state, *(c[0] for c in changes)}:
        version, value = state.get(k, (0, 0))
        own = [c for c in changes if c[0] == k]
        good = 0
        for base in sorted({b for _, b, _ in own}):
            if base == version:
                version, value, good = version + 1, value + min(d for _, b, d in own if b == base), good + 1
        want[k] = (version, value, len(own) - good)
    s = spark.createDataFrame([(k, *v) for k, v in state.items()], "k STRING, version LONG, value LONG")
    got = store.applied(s, spark.createDataFrame(changes, "k STRING, base LONG, delta LONG"), "k")
    assert {x.k: (x.version, x.value, x.conflicts) for x in got.collect()} == want


def test_versions_are_idempotent_and_conflicts_are_met(spark, tmp_path):
    t = store.Versions(spark, str(tmp_path / "v"), "user", buckets=4)
    change = lambda *rows: spark.createDataFrame(rows, "user STRING, base LONG, delta LONG")
    assert t.change(change(("a", 0, 1), ("a", 1, 1), ("b", 0, 5))) == (1, 0)
    assert t.change(change(("a", 0, 1), ("a", 1, 1), ("b", 0, 5))) == (1, 3)  # the same again
    assert t.change(change(("a", 2, 10), ("b", 0, 7))) == (2, 1)
    state = lambda v=None: {r.user: (r.version, r.value) for r in t.read(v).collect()}
    assert state() == {"a": (3, 12), "b": (1, 5)} and state(1) == {"a": (2, 2), "b": (1, 5)} and state(0) == {}
    # Another writer takes the next version between the reading and the writing of this one.
    other, commit = store.Versions(spark, t.path, "user", buckets=4), t._commit

    def late(version, manifest):
        t._commit = commit
        other.change(change(("b", 1, 100)))
        commit(version, manifest)

    t._commit = late
    assert t.change(change(("a", 3, 1), ("b", 1, 1))) == (4, 1)
    assert state() == {"a": (4, 13), "b": (2, 105)}


def test_two_writers_lose_nothing(spark, tmp_path):
    tables = [store.Versions(spark, str(tmp_path / "v"), "user", buckets=2) for _ in range(3)]
    work = [threading.Thread(target=lambda t=t, u=u: t.change(spark.createDataFrame([(u, 0, 1)], "user STRING, base LONG, delta LONG"))) for t, u in zip(tables, "abc", strict=True)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert {r.user: (r.version, r.value) for r in tables[0].read().collect()} == dict.fromkeys("abc", (1, 1)) and tables[0].current() == 3


def test_traces_are_read_and_malformed_ones_told(spark):
    good = '{"retrieval": {"events": [{"channel": " bm25 ", "status": "success", "latency_ms": 1.5, "accepted_count": 2}, {"status": "error", "raw_count": 4, "more": [1]}]}}'
    rows = [(1, good), (2, "{"), (3, None), (4, "{}"), (5, '{"retrieval": {"events": null}}'), (6, '{"retrieval": {"events": "x"}}'), (7, '{"retrieval": {"events": [{"latency_ms": "slow"}]}}')]
    events, bad = evaluation.trace_events(spark.createDataFrame(rows, "id LONG, trace STRING"))
    assert sorted(r.id for r in bad.collect()) == [2, 3, 6]
    got = {tuple(r) for r in evaluation.trace_metrics(events).collect()}
    assert got == {("bm25", 1, 0, 1.5, 2, 0), ("unknown", 2, 2, 0.0, 0, 4)}


def test_sources_are_formatted(spark):
    schema = "qid LONG, place INT, document_id STRING, document_title STRING, document_short_name STRING, document_type STRING, provision_type STRING, provision_number STRING, provision_title STRING, page_start LONG, page_end LONG, page_number LONG, chunk_numbers ARRAY<LONG>, merged BOOLEAN, page_quality_status STRING, suspicious BOOLEAN, content STRING"
    rows = [
        (1, 1, "ata", "Anti-Terrorism Act", "ATA", "act", "section", "7", "Punishment", 3, 5, 3, [4, 5], True, None, True, " text \n"), (1, 2, "x", None, None, None, None, None, None, None, None, None, [1], None, None, None, "  "),
        (1, 3, None, "The ATA", "ata", None, None, None, None, None, None, 9, [2], None, " good ", None, "more"),
    ]
    records = rank.sources(spark.createDataFrame(rows, schema))
    assert {(r.place, r.label, r.pages, r.quality) for r in records.collect()} == {(1, "Section 7 — Punishment", "3-5", "suspicious"), (3, "Unsectioned material", "9", "good")}
    want = "[Source 1]\nDocument: Anti-Terrorism Act (ATA)\nDocument ID: ata\nDocument type: act\nProvision: Section 7 — Punishment\nPages: 3-5\nMerged provision parts: True\nSource chunks: [4, 5]\nQuality: suspicious\n\ntext"
    want += "\n\n---\n\n[Source 3]\nDocument: The ATA\nDocument ID: Unknown\nDocument type: legal_document\nProvision: Unsectioned material\nPages: 9\nMerged provision parts: False\nSource chunks: [2]\nQuality: good\n\nmore"
    assert [r.context for r in rank.context(records).collect()] == [want]


def test_vector_blocks_match_brute_force(spark):
    from lexloom.operators import search

    r = random.Random(6)
    vec = lambda: [round(r.uniform(-1, 1), 1) for _ in range(3)]
    vectors = [(k, vec()) for k in range(300)] + [(k, [0.5, 0.5, 0.5]) for k in range(300, 360)] + [(900, None), (901, [0.1, None, 0.2]), (902, [1.0, 2.0]), (None, [9.0, 9.0, 9.0])]
    queries = [(q, vec()) for q in range(12)] + [(12, [1.0, 1.0, 1.0]), (13, None)]
    v = spark.createDataFrame(vectors, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(4)
    q = spark.createDataFrame(queries, "qid LONG, q ARRAY<DOUBLE>")
    want = set()
    for i, x in queries[:13]:
        scored = sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)), 6), k) for k, y in vectors[:360])
        want |= {(i, k, -s, n) for n, (s, k) in enumerate(scored[:5], 1)}
    for held in (4096, 5):
        assert {(g.qid, g.id, g.score + 0.0, g["rank"]) for g in search.vector_topk(q, v, 5, held=held).collect()} == {(a, b, c + 0.0, d) for a, b, c, d in want}
    assert search.vector_topk(q, v.limit(0), 5).count() == 0 and search.vector_topk(q.limit(0), v, 5).count() == 0
    assert search.vector_topk(q, v, 5, where=F.col("vec_id") < 3).count() == 39


@pytest.mark.parametrize("block", [1, 7, 32])
def test_posting_blocks_give_the_same_rows(spark, block):
    from lexloom.operators import search

    r = random.Random(block)
    word = lambda: "w%d" % min(int(r.expovariate(0.02)), 600)
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(r.randrange(3, 120)))) for k in range(400)] + [(400, None), (401, "")], "doc_id LONG, text STRING")
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(r.randrange(1, 9)))) for q in range(25)] + [(25, ""), (26, "nothing here")], "item_id LONG, text STRING")
    rows, counts = search.bm25_blocks(asked, docs, 5, block=block)
    want = {tuple(x) for x in search.bm25_topk(asked, docs, 5).select("qid", "id", "score", "rank").collect()}
    assert {tuple(x) for x in rows.select("qid", "id", "score", "rank").collect()} == want
    n = counts.first()
    assert 0 < n["read"] <= n["all"] and (block > 1 or n["read"] < 0.7 * n["all"])
