"""Properties of the operators that the SQL comparison doesn't show."""

import random
import uuid

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import cleaning, evaluation, rank, search, structure
from lexloom.plans import questions


def test_canonical_numbers(spark):
    cases = {"9-A": "9A", "9 - a": "9A", "Section 11EE(2)(b)": "11EE", "art. 10": "10", "S. 34": "34", "302.": "302", "junk": None, "": None, "12abcd": None}
    df = spark.createDataFrame(list(cases.items()), "raw STRING, want STRING").withColumn("got", T.canonical_number(F.col("raw")))
    assert all(r.got == r.want for r in df.collect())


def test_deterministic_id_is_a_uuid5(spark):
    import hashlib

    got = spark.createDataFrame([("a", None)], "x STRING, y STRING").select(T.deterministic_id(F.col("x"), F.col("y"))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(b"a|").hexdigest()))


def test_tokens_are_a_set_without_stop_words(spark):
    got = spark.createDataFrame([("The Anti–Terrorism act, the ACT of 1997 é x",)], "t STRING").select(T.tokens(F.col("t"))).first()[0]
    assert got == ["anti-terrorism", "act", "1997"]


def test_null_body_is_usable_and_false_is_not(spark):
    df = spark.createDataFrame([(1, "x", None, None), (2, "x", False, False), (3, " ", False, True), (4, "x", True, True)], "id INT, page_content STRING, heading_only_chunk BOOLEAN, provision_body_present BOOLEAN")
    assert [r.id for r in df.where(search.usable()).collect()] == [1]


def test_bm25_rare_term_and_phrase_first(spark):
    corpus = spark.createDataFrame([(1, "common words qisas here"), (2, "common words here"), (3, "words common here and there"), (4, "rare appeal lies")], "doc_id LONG, text STRING")
    q = spark.createDataFrame([(1, "common qisas"), (2, "common words here")], "item_id LONG, text STRING")
    top = {(r.qid, r.rank): r.id for r in search.bm25_topk(q, corpus, 3).collect()}
    assert top[1, 1] == 1 and top[2, 1] == 2


def test_bm25_scan_hands_on_few_rows(spark, monkeypatch):
    """Tasks hand on what can still be among the best, and the result is that of the join."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i, None if i == 7 else " ".join(r.choices(vocabulary, range(1, 61), k=r.randint(1, 40)))) for i in range(900)]
    corpus = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(3).withColumn("other", F.col("doc_id") % 5 == 0)
    q = spark.createDataFrame([(i, " ".join(r.choices(vocabulary, k=1 + i % 6))) for i in range(20)] + [(3, "w59 w58"), (50, ""), (51, "none"), (None, "w1")], "item_id LONG, text STRING")
    seen, real = [], search.materialized
    q = real(q, "asked")  # so that its size is known
    monkeypatch.setattr(search, "materialized", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    rows = lambda: sorted(map(tuple, search.bm25_topk(q, corpus, 4, keep=~F.col("other")).collect()))
    one = rows()
    scored = next(df for name, df in seen if name == "scored")
    assert scored.count() < 20 * 720 / 8
    for name, value in (("SCORES", 70), ("HELD_ROWS", 30), ("HELD_QUERIES", 6)):
        monkeypatch.setattr(search, name, value)
    assert rows() == one
    monkeypatch.setattr(search, "BROADCAST_BYTES", -1)
    assert rows() == one and len(one) > 70


def test_bm25_filter_keeps_statistics(spark):
    corpus = spark.createDataFrame([(i, f"alpha w{i} common") for i in range(20)], "doc_id LONG, text STRING")
    q = spark.createDataFrame([(1, "alpha w3")], "item_id LONG, text STRING")
    every = {r.id: r.score for r in search.bm25_topk(q, corpus, 20).collect()}
    some = {r.id: r.score for r in search.bm25_topk(q, corpus, 20, keep=F.col("doc_id").isin(3, 4)).collect()}
    assert some == {k: every[k] for k in (3, 4)}


def test_null_score_never_becomes_zero(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 2.0), (4, -1.0)], "id INT, s DOUBLE").select("id", rank.clamp(F.col("s")).alias("c"))
    assert {r.id: r.c for r in df.collect()} == {1: None, 2: 0.0, 3: 1.0, 4: 0.0}


def test_duplicate_in_a_route_does_not_raise_fusion(spark):
    rows = [(1, 5, "vector", 0, 0.9, 1), (1, 6, "vector", 0, 0.8, 2)]
    schema = "qid LONG, id LONG, method STRING, query_index INT, score DOUBLE, retrieval_rank INT"
    one = {r.id: r.fusion for r in rank.rrf_fusion(spark.createDataFrame(rows, schema)).collect()}
    two = {r.id: r.fusion for r in rank.rrf_fusion(spark.createDataFrame([*rows, (1, 5, "vector", 0, 0.85, 3)], schema)).collect()}
    assert one[5] == two[5] and two[6] < one[6]


def test_greedy_near_duplicates_keep_the_best(spark):
    schema = "qid LONG, id LONG, provision STRING, part INT, content STRING, rank INT"
    rows = [(1, 1, "a", 1, "one two three", 2), (1, 2, "a", 1, "one two three", 1), (1, 3, "a", 2, "one two three", 3), (1, 4, "b", 1, "one two three", 4)]
    assert sorted(r.id for r in rank.near_dup_greedy(spark.createDataFrame(rows, schema)).collect()) == [2, 3, 4]


def test_scenario_beats_citation_and_comparison_beats_scenario(spark):
    q = spark.createDataFrame([(1, "He was killed in a riot, does section 302 apply?"), (2, "compare murder and riot"), (3, "section 302 text"), (4, "hello")], "qid LONG, question STRING")
    assert {r.qid: r.question_type for r in questions.query_plan(q).collect()} == {1: "fact_scenario", 2: "comparison", 3: "section_lookup", 4: "general"}


def test_amendment_region_closes_at_content(spark):
    rows = [("d", 0, "1 Inserted by Act"), ("d", 1, ""), ("d", 2, "by Act X"), ("d", 3, "Whoever does"), ("d", 4, "by Act Y")]
    got = structure.amendment_regions(spark.createDataFrame(rows, "doc STRING, pos LONG, line STRING"))
    assert [r.removed for r in got.orderBy("pos").collect()] == [True, False, True, False, False]


def test_split_text_limits_and_covers():
    text = "First sentence here. " * 30 + "\n\n" + "x" * 400
    parts = structure.split_text(text, 200, 40)
    assert all(0 < len(p) <= 200 for p in parts)
    assert sum(p.count("x") for p in parts) >= 400


def test_percentiles_drop_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,)], "m DOUBLE")
    r = evaluation.summary(df, ["m"]).first()
    assert (r.n, r.p50, r["mean"]) == (3, 2.0, round(7 / 3, 6))


def test_page_is_cleaned(spark):
    page = "Pakistan Penal Code\n12\nThe impri-\nson\u00adment ofthe \ufb01ne , shallbe 5[paid]\n***"
    got = cleaning.clean_pages(spark.createDataFrame([("d", 1, page), ("d", 2, None)], "document STRING, page INT, text STRING"))
    assert {r.page: r.text for r in got.collect()} == {1: "The imprisonment of the fine, shall be 5[paid]", 2: ""}


def test_distinct_strings_are_trimmed_of_spaces_alone(spark):
    got = spark.createDataFrame([([" a0", "a0 ", "", "1 b"],)], "x ARRAY<STRING>").select(T.distinct_strings(F.col("x"))).first()[0]
    assert got == ["a0", "1 b"]


def test_greedy_near_duplicates_match_a_plain_loop(spark):
    import random

    r = random.Random(5)
    rows = [(q, 100 * q + i, r.choice("ab"), r.randrange(2), " ".join(r.choice("pqrstuvw") * 3 for _ in range(r.randrange(1, 7))), i) for q in range(4) for i in range(25)]
    df = spark.createDataFrame(rows, "qid LONG, id LONG, provision STRING, part INT, content STRING, rank INT")
    kept, want = {}, set()
    for q, i, p, part, text, _ in sorted(rows, key=lambda x: (x[0], x[5])):
        own, group = set(text.split()), kept.setdefault((q, p, part), [])
        if not any(len(own & k) / len(own | k) >= 0.6 for k in group):
            group.append(own)
            want.add(i)
    assert {x.id for x in rank.near_dup_greedy(df, 0.6).collect()} == want


def test_provision_chunks_match_a_plain_loop(spark):
    import random
    import re

    r = random.Random(8)
    marks = ["(1) ", "(2)", "(a) ", "(b) ", "(iv) ", "", "", "Explanation.- "]
    rows = []
    for i in range(40):
        body = "\n".join(r.choice(marks) + " ".join("word%d" % r.randrange(99) + r.choice(["", "", "."]) for _ in range(r.randrange(1, 90))) for _ in range(r.randrange(1, 9)))
        rows.append((i, "ATA", "section", str(i), r.choice(["", "Some title"]), body))
    rows += [(50, "PPC", "article", "9A", "t", ""), (51, "PPC", "article", "9B", None, "(1) alone"), (52, "PPC", "section", "7", "x", "y" * 2500)]
    want = []
    for i, short, kind, number, title, body in rows:
        head = f"{short} | {kind.title()} {number}" + (f": {title}" if title else "")
        texts = [("", head, body)]
        ls, now, kids = body.strip().split("\n"), None, []
        for at, line in enumerate(ls):
            m = re.match(structure.CHILD_MARKER, line)
            if m:
                label = m[1].lower()
                now = label if label.isdigit() else now
                end = next((j for j in range(at + 1, len(ls)) if re.match(structure.CHILD_MARKER, ls[j])), len(ls))
                path = [label] if label.isdigit() else [now, label]
                if now is not None:
                    kids.append((path, at, re.sub(structure.CHILD_MARKER, "", "\n".join(ls[at:end])).strip()))
        if len(kids) > 1 or any(len(p) > 1 for p, _, _ in kids):
            texts += [(".".join(p) + f"@{at}", f"{head} | {kind.title()} {number}" + "".join(f"({x})" for x in p), t) for p, at, t in kids]
        for path, h, t in texts:
            limit = max(200, 1000 - len(h) - 2)
            parts = [t.strip()] if len(t.strip()) <= limit else structure.split_text(t.strip(), limit, 150)
            want += [(i, path, n, len(parts), f"{h}\n\n{p}".strip()) for n, p in enumerate(parts, 1)]
    df = spark.createDataFrame(rows, "id LONG, short STRING, kind STRING, number STRING, title STRING, body STRING")
    got = [(x.id, x.path, x.part, x.parts, x.chunk) for x in structure.provision_chunks(df).collect()]
    assert sorted(got) == sorted(want)


def test_pieces_fit_overlap_and_hold_the_text():
    text = "\n\n".join(" ".join(f"w{i}x{j}." for j in range(i % 30 + 1)) for i in range(60))
    pieces = structure.split_text(text, 300, 60)
    assert all(0 < len(p) <= 300 for p in pieces) and set(text.split()) == {w for p in pieces for w in p.split()}
    assert any(a.split()[-1] in b for a, b in zip(pieces, pieces[1:], strict=False)) and structure.split_text("a" * 950, 300, 0) == ["a" * 300] * 3 + ["a" * 50]
