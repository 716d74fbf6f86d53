"""Periodic runs, exact dedup and the filter audit against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from lexloom.llm import exact_dedup, filter_audit, registry, runs

from test_llm import ODD, empty, frame, odd  # isort: skip

SF = "/root/testdata/sf0.001"


# ---- 11 ----------------------------------------------------------------------------


def brute_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(least, 2 * p) and i > s:
                out.setdefault((s, i + p), p)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda x: (x[0], x[2]))


def repetitive(r):
    """Few words, stretches that repeat, and copies of whole stretches further on."""
    n = r.randrange(120)
    w = [b"%d" % r.randrange(r.choice([1, 2, 3, 4, 30])) for _ in range(n)]
    for _ in range(r.randrange(4) if n > 4 else 0):
        a, p, m = r.randrange(n), r.randrange(1, max(2, n // 4)), r.randrange(n)
        for i in range(a + p, min(n, a + m)):
            w[i] = w[i - p]
    return w + w[len(w) // 3 :] + w[: r.randrange(len(w) + 1)] if r.random() < 0.3 else w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_match_brute_force(least):
    r = random.Random(least)
    for _ in range(1200):
        w = repetitive(r)
        assert runs.runs_of(w, least) == brute_runs(w, least)


def test_runs_in_small_packs(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 7)
    r = random.Random(9)
    for _ in range(200):
        w = repetitive(r)
        assert runs.runs_of(w) == brute_runs(w)


def test_a_run_within_a_copied_block_is_copied():
    inner = [b"x%d" % i for i in range(7)] * 3
    block = [b"l%d" % i for i in range(9)] + inner + [b"r%d" % i for i in range(9)]
    w = block + [b"m"] + block + [b"n"] + block
    assert runs.runs_of(w) == brute_runs(w) and len(runs.runs_of(w)) == 3


def contract_words(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_runs_query_matches_brute_force(spark):
    rows = {r.doc_id: r for r in registry.queries()["op11_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w, got = contract_words(d.doc_id, d.text), rows[d.doc_id]
        if len(w) > 1500:
            w_runs = runs.runs_of(w)  # compared with brute force on short texts
        else:
            w_runs = brute_runs(w)
        gone = {k for s, size, q in w_runs for k in range(s + q, s + size)}
        best = min(w_runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        text = "".join(f"{s},{size},{q}\n" for s, size, q in w_runs)
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got.n_runs, got.start, got.length, got.period) == (len(w_runs), *best)
        assert got.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert (got.runs_sha256, got.collapsed_sha256) == (hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_cases(spark):
    rows = runs.find_runs(odd(spark, [(7, "a b " * 8, "en")])).collect()
    assert len(rows) == len(ODD) + 1
    assert [r.collapsed for r in rows if r.doc_id == 7] == ["a b"] and [r.n_words for r in rows if r.text is None] == [0]
    assert runs.find_runs(empty(spark)).count() == 0
    long = " ".join(f"w{k}" for k in range(30_000)) + " end" * 30_000
    (r,) = runs.find_runs(frame(spark, [long])).collect()
    assert [(x.start, x.length, x.period) for x in r.runs] == [(30_000, 30_000, 1)] and len(r.collapsed.split()) == 30_001


# ---- 12 ----------------------------------------------------------------------------


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("share", [1 << 12, 4, 1])
def test_exact_groups_match_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", share)
    r = random.Random(share)
    texts = [r.choice(["Same", "same", "SAME", "é", "É", "", None, "other %d" % r.randrange(40)]) for _ in range(400)]
    got = {x.id: x for x in exact_dedup.exact_groups(frame(spark, texts).repartition(5)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lowered(t)].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
            assert bytes(got[i].digest) == hashlib.sha256(t.encode()).digest()


def test_exact_dedup_cases(spark):
    rows = exact_dedup.exact_groups(odd(spark, [(None, "SAME ROW", "en"), (8, "some text without an id\nline", "en")])).collect()
    assert len(rows) == len(ODD) + 2
    by = defaultdict(list)
    for r in rows:
        by[bytes(r.digest)].append(r)
    assert all(sum(r.kept for r in g) == 1 for g in by.values())
    same = by[hashlib.sha256(b"same row").digest()]
    assert {r.keep_id for r in same} == {3} and {r.group_size for r in same} == {3}
    assert {r.keep_id for r in by[hashlib.sha256(b"").digest()]} == {2}
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    kept = exact_dedup.drop_copies(odd(spark, [(None, "SAME ROW", "en"), (8, "some text without an id\nline", "en")]))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([2, 3, 4, 5, 6, 8])
    names = spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x")], "name STRING, text STRING")
    assert [r.name for r in exact_dedup.drop_copies(names, id_col="name").collect()] == ["b"]


def test_exact_dedup_has_no_python_in_its_plan(spark):
    plan = registry.queries()["op12_exact_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 13 ----------------------------------------------------------------------------


def brute_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    fails = []
    for i, t, s in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        own = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t or "")) > 2 * len(t or ""),
            "D": bool(re.search("[#$%&*|]", t or "")), "E": i is not None and least[t or ""] < i,
        }
        fails.append((i, s or "", {k for k, v in own.items() if v}))
    out, removed = {}, Counter()
    for part in {p for _, p, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                c, earlier = Counter(), set(order[: step - 1])
                for i, p, own in fails:
                    if p == part:
                        c["kept"] += not own & (earlier | {f})
                        here = f in own and not own & earlier
                        c["removed"] += here
                        c["redundant"] += f in own and not here
                        c["unique_fails"] += own == {f}
                        c["good_lost"] += here and i in good
                        c["toxic_lost"] += here and i in toxic
                out[part, order, step] = c
                removed[part, f] += c["removed"]
    return {(p, o, k): (*[c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")], removed[p, o[k - 1]]) for (p, o, k), c in out.items()}


def test_audit_matches_brute_force(spark):
    r = random.Random(5)
    docs = []
    for i in range(60):
        t = " ".join(r.choice(["word", "Word", "other", "x%d" % r.randrange(400), "A#"]) for _ in range(r.choice([3, 150, 260])))
        docs.append((i, r.choice([t, t, None, "", "again and again"]), r.choice(["s", "t", "", None])))
    docs += [(None, "again and again", "s"), (3, docs[3][1], "t"), (3, docs[3][1], "t"), (0, "again and again", "u")]
    labels = [(r.randrange(60), r.choice([0, 1, None]), r.choice([0, 1])) for _ in range(50)] + [(None, 1, 1)]
    frame_ = spark.createDataFrame([(i, t, s, "x", "y", "z") for i, t, s in docs], "doc_id LONG, text STRING, source STRING, part STRING, words STRING, n STRING")
    failed = filter_audit.failures(frame_.repartition(3))
    got = filter_audit.audit(failed, spark.createDataFrame(labels, "doc_id LONG, quality LONG, toxic LONG")).collect()
    want = brute_audit(docs, labels)
    rows = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got}
    assert len(got) == len(rows) and rows == want


def test_audit_cases(spark):
    none = spark.createDataFrame([], "doc_id LONG, quality LONG, toxic LONG")
    assert filter_audit.audit(filter_audit.failures(empty(spark)), none).count() == 0
    rows = filter_audit.audit(filter_audit.failures(odd(spark)), none).collect()
    assert len(rows) == 600 and {r.step for r in rows} == {1, 2, 3, 4, 5} and not any(r.good_lost for r in rows)


@pytest.mark.parametrize("name", ["op12_exact_dedup", "op13_filter_audit"])
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    cur = c.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    assert sorted(repr([r[x] for x in names]) for r in df.collect()) == sorted(repr([dict(zip(cols, r, strict=True))[x] for x in names]) for r in cur.fetchall())
