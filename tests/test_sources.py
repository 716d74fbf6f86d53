import json

from lexloom.sources import tables
from lexloom.streaming import ingest


def test_json_lines_skip_blank_and_tell_malformed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{"id": 2\n{"id": 3, "x": null}\n')
    rows, bad = tables.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id LONG, x STRING")
    assert sorted(r.id for r in rows.collect()) == [1, 3] and bad.count() == 1


def test_read_rows_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}]))
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"id": 3}]}))
    (tmp_path / "c.csv").write_text("id\n4\n")
    got = [sorted(r.id for r in tables.read_rows(spark, str(tmp_path / n), "id LONG").collect()) for n in ("a.json", "b.json", "c.csv")]
    assert got == [[1, 2], [3], [4]]


def test_uploads(spark, tmp_path):
    (tmp_path / "archived").mkdir()
    for n, b in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b"nope"), ("archived/c.pdf", b"%PDF-")):
        (tmp_path / n).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: r.refused for r in tables.checked_uploads(tables.find_files(spark, str(tmp_path))).collect()}
    assert got == {"a.pdf": None, "b.pdf": "magic"}


def test_pending_and_unexpected(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "id LONG") for ids in ([1, 2, 3], [2, 9]))
    assert sorted(r.id for r in tables.pending(a, b).collect()) == [1, 3]
    assert [r.id for r in tables.unexpected(a, b).collect()] == [9]


def test_partitioned_write(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "CAST(id % 3 AS STRING) AS document_id")
    tables.write_partitioned(df, str(tmp_path / "t"), "document_id", "id")
    assert spark.read.parquet(str(tmp_path / "t")).where("document_id = '1'").count() == 17


def test_stream_ingest_is_idempotent(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    schema = "chunk_id STRING, text STRING"
    for k, ids in enumerate((["a", "b"], ["b", "c"])):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"chunk_id": i, "text": "x"}) for i in ids))
        ingest.ingest(ingest.read_chunks(spark, str(folder), schema), table, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.chunk_id for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]


def test_channel_windows_count_late_events_within_the_watermark(spark, tmp_path):
    folder = tmp_path / "ev"
    folder.mkdir()
    rows = [("2024-01-01T00:01:00Z", "bm25", "success", 1.0), ("2024-01-01T00:02:00Z", "bm25", "error", 2.0), ("2024-01-01T02:00:00Z", "dense", "success", 3.0)]
    (folder / "a.json").write_text("\n".join(json.dumps(dict(zip(("ts", "channel", "status", "latency"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("ts TIMESTAMP, channel STRING, status STRING, latency DOUBLE").json(str(folder))
    q = ingest.channel_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.channel, r.events, r.failures, r.latency) for r in spark.table("windows").collect()}
    assert got == {("bm25", 2, 1, 3.0), ("dense", 1, 0, 3.0)}


def test_delete_by_predicate_and_repeats(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "b", None), (5, "b", None), (6, "a", "y")]
    df = spark.createDataFrame(rows, "id LONG, doc STRING, text STRING")
    a, b, c, d = (str(tmp_path / n) for n in "abcd")
    df.write.parquet(a)
    assert tables.delete_rows(spark, a, b, F.col("doc") == "a") == 3 and sorted(r.id for r in spark.read.parquet(b).collect()) == [3, 4, 5]
    assert tables.delete_repeats(spark, a, c, ["doc", F.sha2("text", 256).alias("h")]) == 2 and sorted(r.id for r in spark.read.parquet(c).collect()) == [1, 3, 4, 6]
    assert tables.reset(df, d) == 0 and spark.read.parquet(d).columns == df.columns


def test_metadata_rules_stop_early(spark):
    from lexloom.operators import metadata as M

    empty = dict.fromkeys(M.FIELDS)
    row = empty | {"document_id": "d", "chunk_id": "d::section::1::part-1::chunk-1", "provision_type": "Section", "provision_number": "1", "provision_ordinal": 1}
    rows = [empty, row | {"provision_type": "rule"}, row | {"is_unsectioned_chunk": True}, row | {"provision_number": " "}]
    schema = "id LONG, " + ", ".join(f"{k} {t}" for k, t in M.FIELDS.items())
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], schema)
    got = {}
    for r in M.row_issues(df).collect():
        got.setdefault(r.id, set()).add((r.field, r.rule))
    assert got[0] == {(f, "blank") for f in M.TEXTS}
    assert ("provision_type", "known") in got[1] and not any(f == "section_number" for f, _ in got[1])
    assert {("provision_number", "unsectioned"), ("provision_ordinal", "unsectioned"), ("provision_identity", "unsectioned")} <= got[2] and ("chunk_id", "form") not in got[2]
    assert ("provision_number", "blank") in got[3] and ("base_provision_number", "blank") not in got[3]


def test_keys_of_several_names_and_last_rows(spark, tmp_path):
    rows = [("a", None, 1, "x"), (" ", "b", 2, "y"), (None, "b", 3, "z"), ("a", "c", 4, "w"), (None, "  ", 5, "v")]
    df = spark.createDataFrame(rows, "sample_id STRING, id STRING, at INT, answer STRING").withColumn("key", tables.coalesced_key("sample_id", "id"))
    assert {(r.key, r.answer) for r in tables.last_wins(df, "key", "at").collect()} == {("a", "w"), ("b", "z"), (None, "v")}
    path, report = str(tmp_path / "log"), str(tmp_path / "report")
    tables.append_json(df.where("at < 3"), path)
    tables.append_json(df.where("at >= 3"), path)
    assert sorted(r["at"] for r in spark.read.json(path).collect()) == [1, 2, 3, 4, 5]
    tables.write_report(df, report)
    tables.write_report(df.where("at = 1"), report)
    assert [(r.key, r["at"]) for r in spark.read.option("header", "true").csv(report).collect()] == [("a", "1")]
