"""Blocks, carries and chunks against plain loops over whole documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators import cleaning, metadata, ordered, provisions, structure
from lexloom.plans import dims
from lexloom.sources.tables import materialized

BITS = [
    "PREAMBLE", "CHAPTER II", "PART I", "XVI", "OF HURT", "Of the courts", "THE FIRST SCHEDULE", "1. Short title and", "extent of this law", "7.-Punishment for acts: Whoever acts", "302. Punishment.", "Section 9: Title", "Article 10A. Fair",
    "12-A. Powers — This Act applies", "1990. A year", "8. [omitted", "5. Substituted by law", "Explanation 1. text", "(1) first subsection", "(a) clause", "This Act may be called", "some words that go on", "ending here.", "and so:", "4.", "6. ***",
    "lower line", "11[15. Inserted section title", "w " * 90, "", "", "Notwithstanding anything",
]


def number_of(raw):
    m = re.fullmatch(r"(\d+)\s*(?:-\s*)?([A-Za-z]*)", raw)
    return m[1] + m[2].upper() if m and len(m[2]) <= 3 else None


def valid(m, kind):
    n, title = number_of(m[2]), m[3].strip()
    if not n or (m[1] and m[1].lower() != kind) or not re.fullmatch(r"\d+[A-Z]{0,%d}" % (3 if kind == "article" else 2), n):
        return False
    if re.fullmatch(r"\d{4}", n) and 1800 <= int(n) <= 2100:
        return False
    return 2 <= len(title) <= 600 and not any(re.match(p, title, re.I) for p in dims.NO_TITLES)


class Heading(dict):
    """Groups of a heading's match, and where it begins and ends."""

    a = b = 0


def headings(whole):
    """A line of a provision's form, or a number alone with the next line that isn't blank,
    unless this is of that form itself."""
    rows = [(m.start(), m[0]) for m in re.finditer(r"[^\n]+", whole) if m[0].strip()]
    lone = dims.PROVISION.replace(r"([^\n]+)", r"\s*$")
    out = []
    for k, (at, line) in enumerate(rows):
        end = at + len(line)
        if re.match(lone, line, re.I):
            if k + 1 == len(rows) or re.match(lone, rows[k + 1][1], re.I) or re.match(dims.PROVISION, rows[k + 1][1], re.I):
                continue
            end = rows[k + 1][0] + len(rows[k + 1][1])
            line += rows[k + 1][1]
        m = re.match(dims.PROVISION, line, re.I)
        if m:
            h = Heading(enumerate([m[0], *m.groups()]))
            h.a, h.b = at, end
            out.append(h)
    return out


def stops(line):
    marks = [r"\((?:\d+|[a-z]|[ivxlcdm]+)\)\s+", r"Explanation(?:\s+\d+)?\s*[:.\-—–]?", r"Illustrations?\s*[:.\-—–]?\s*$", dims.BODY_START, dims.PROVISION]
    parts = [p for p in structure.BOUNDARIES if "PREAMBLE" not in p]
    return any(re.match(p, line, re.I) for p in marks) or any(re.match(p, line) for p in parts) or len(line) > 160


def blocks(texts, kind):
    """(number, title, text, pages) of a document's pages, by offsets in its joined text."""
    whole, spans = "", []
    for p, t in texts:
        t = (t or "").strip()
        whole += "\n\n" if spans else ""
        spans.append((p, len(whole), len(whole) + len(t)))
        whole += t
    found = [m for m in headings(whole) if valid(m, kind)]
    edges = [m.start() for p in structure.BOUNDARIES for m in re.finditer(("(?mi)" if p.startswith("(?i)") else "(?m)") + p.removeprefix("(?i)").replace(r"\s*", r"[ \t]*"), whole)]
    for m in re.finditer("(?m)" + structure.ROMAN.replace(r"\s*", r"[ \t]*"), whole):
        below = re.search(r"\S[^\n]*", whole[m.end() :])
        if below and any(re.match(p, below[0].strip()) for p in structure.BOUNDARIES[4:6]):
            edges.append(m.start())
    out = []
    first = found[0].a if found else len(whole)
    for p, a, b in spans:
        if whole[a : min(b, first)].strip():
            out.append((None, None, whole[a : min(b, first)].strip(), [p]))
    for k, m in enumerate(found):
        end = min([e for e in edges if e > m.a] + [found[k + 1].a if k + 1 < len(found) else len(whole)])
        number, raw = number_of(m[2]), m[3].strip()
        own = re.fullmatch("(?i)" + dims.INLINE_BODY, raw)
        if own:
            title = own[1].strip().rstrip(" :.—–")[:220]
            text = f"{number}. {title}\n\n{own[2].strip()}{whole[m.b:end]}".strip()
        else:
            parts, at = [raw], m.b
            while at < end and raw[-1] not in ".:":
                nxt = re.match(r"(?:\n\s*)+([^\n]+)", whole[at:end])
                if not nxt or stops(nxt[1].strip()):
                    break
                parts.append(nxt[1].strip())
                at += nxt.end()
                if parts[-1][-1] in ".:":
                    break
            title = " ".join(parts).rstrip(" :.").strip()[:220]
            text = f"{number}. {title}\n\n{whole[at:end].strip()}".strip() if len(parts) > 1 else whole[m.a : end].strip()
        out.append((number, title, text, [p for p, a, b in spans if b > m.a and a < end]))
    return out


@pytest.fixture(scope="module")
def documents():
    r = random.Random(3)
    return {f"d{d}": [(p, "\n".join(r.choice(BITS) for _ in range(r.randrange(1, 9))) + "\nx") for p in range(1, r.randrange(2, 6))] for d in range(120)}


def kind_of(d):
    return "article" if d.endswith("3") else "section"


def frames(spark, documents):
    pages = spark.createDataFrame([(d, p, t, "x") for d, ps in documents.items() for p, t in ps], "document STRING, page LONG, text STRING, line STRING")
    return pages.repartition(5), spark.createDataFrame([(d, kind_of(d)) for d in documents], "document STRING, kind STRING")


def test_blocks_match_a_plain_loop(spark, documents):
    pages, kinds = frames(spark, documents)
    got = {}
    for r in provisions.provision_blocks(pages, kinds).collect():
        got.setdefault(r.document, []).append((r.start, (r.number, r.title, r.text, r.pages)))
    for d, ps in documents.items():
        assert [b for _, b in sorted(got.get(d, []), key=lambda x: x[0])] == blocks(ps, kind_of(d)), ps


def test_odd_pages_make_blocks(spark):
    pages = spark.createDataFrame([("a", 1, None), ("a", 2, ""), (None, 1, "x"), ("a", None, "x"), ("b", 1, "text")], "document STRING, page LONG, text STRING")
    kinds = spark.createDataFrame([("a", "section"), ("b", "section")], "document STRING, kind STRING")
    assert [(r.document, r.text, r.unsectioned) for r in provisions.provision_blocks(pages, kinds).collect()] == [("b", "text", True)]
    assert provisions.provision_blocks(pages.limit(0), kinds).count() == 0


def test_chunks_pass_the_audit(spark, documents):
    some = {d: documents[d] for d in sorted(documents)[:25]}
    pages, kinds = frames(spark, some)
    names = spark.createDataFrame([(d, d + ".pdf", d + " title", d.upper(), "act") for d in some], "document STRING, document_name STRING, document_title STRING, document_short_name STRING, document_type STRING")
    found = materialized(cleaning.clean_pages(pages), "found")
    chunks = materialized(provisions.legal_chunks(pages, found.select("document", "page", "found"), kinds, names), "chunks")
    assert {"document_id", *metadata.FIELDS} <= set(chunks.columns)
    assert metadata.audit(chunks.withColumn("id", F.col("chunk_number"))).collect() == []
    rows = chunks.orderBy("chunk_number").collect()
    assert [r.chunk_number for r in rows] == list(range(1, len(rows) + 1)) and len({r.chunk_id for r in rows}) == len(rows)
    first = {(d, p): f for d, p, f in found.select("document", "page", "found.chapter_number").collect()}
    for r in rows:
        assert r.chapter_number == next((first[r.document_id, p] for p in r.source_pages if first[r.document_id, p]), None)


@pytest.mark.parametrize("ahead", [False, True])
def test_carries_match_a_loop(spark, ahead):
    r = random.Random(4)
    rows = [(r.choice("ab"), k, r.choice([None, None, k]), r.randrange(5)) for k in range(300)]
    x = ordered.ranged(spark.createDataFrame(rows, "key STRING, at LONG, v LONG, n LONG").repartition(7), "at")
    y = ordered.carried(x, ["key"], ["at"], {"before": "v"}, ahead=ahead)
    y = ordered.totals(ordered.places(y, ["key"], ["at"], "place"), ["key"], ["at"], {"sum": "n"})
    got = {q.at: (q.before, q.place, q.sum) for q in y.collect()}
    for key, at, _, _ in rows:
        own = [q for q in rows if q[0] == key]
        near = [q[2] for q in (reversed(own) if ahead else own) if (q[1] > at if ahead else q[1] < at) and q[2] is not None]
        assert got[at] == (near[-1] if near else None, sum(q[1] <= at for q in own), sum(q[3] for q in own if q[1] < at))


def test_pages_of_spans_match_a_loop(spark):
    r = random.Random(5)
    pages, at = [], {"a": 0, "b": 0}
    for p in range(60):
        d, n = r.choice("ab"), r.choice([0, 1, 5, 30])
        pages.append((d, p, at[d], at[d] + n))
        at[d] += n + 2
    spans = [(r.choice("abc"), k, s, s + r.randrange(60)) for k in range(80) for s in [r.randrange(400)]]
    o = spark.createDataFrame(pages, "document STRING, page LONG, start LONG, end LONG")
    s = spark.createDataFrame(spans, "document STRING, span LONG, start LONG, end LONG")
    got = {(x.document, x.span): x.pages for x in structure.pages_of(s, o).collect()}
    want = {(d, k): ",".join(str(p) for e, p, a, b in pages if e == d and b > lo and a < hi) for d, k, lo, hi in spans}
    assert got == {k: v for k, v in want.items() if v}


def plain_split(text, limit, overlap):
    """Cut at the first separator that occurs, put pieces together while they fit, and cut
    those that are too long by the separators behind it: with a list of work, no recursion."""
    done, work = [], [(text, 0)]
    while work:
        t, level = work.pop()
        if level is None:
            done.append(t)
            continue
        while structure.SEPARATORS[level] and not re.search(structure.SEPARATORS[level], t):
            level += 1
        sep = structure.SEPARATORS[level]
        starts = sorted({0, *([m.start() for m in re.finditer(sep, t)] if sep else range(len(t)))})
        pieces = [t[a:b] for a, b in zip(starts, [*starts[1:], len(t)], strict=True) if a < b]
        todo, run = [], []

        def close():
            now = []
            for p in run:
                if now and sum(map(len, now)) + len(p) > limit:
                    todo.append(("".join(now).strip(), None))
                    while now and (sum(map(len, now)) > overlap or sum(map(len, now)) + len(p) > limit):
                        now.pop(0)
                now.append(p)
            todo.append(("".join(now).strip(), None))
            run.clear()

        for p in pieces:
            if len(p) < limit or not sep:
                run.append(p)
            else:
                close()
                todo.append((p, level + 1))
        close()
        work += reversed(todo)
    return [c for c in done if c]


def test_splitting_matches_a_plain_loop(spark):
    r = random.Random(8)
    texts = ["", None, " \n ", "x" * 900]
    for _ in range(120):
        texts.append("".join(r.choice(["word ", "another. ", "\n", "\n\n", "(1) ", "(a) ", "Explanation: ", "\nIllustration\n", "z" * r.randrange(90), "? "]) for _ in range(r.randrange(80))))
    for limit, overlap in ((60, 15), (100, 0), (1000, 150)):
        got = {}
        for x in structure.split_chunks(spark.createDataFrame(list(enumerate(texts)), "id LONG, text STRING"), limit, overlap).collect():
            got.setdefault(x.id, []).append((x.part, x.chunk))
        for i, t in enumerate(texts):
            assert [c for _, c in sorted(got.get(i, []))] == plain_split(t or "", limit, overlap), (limit, t)


def test_what_chunks_write_on_the_way(spark, monkeypatch):
    """Of the findings only those that provisions inherit are made; lines are written without a
    copy of themselves, and their marks once for all that reads them."""
    from lexloom.plans import queries_structure
    from lexloom.sources import tables

    seen = []

    def spy(df, name):
        seen.append((name, df))
        return materialized(df, name)

    for module in (tables, ordered, provisions):
        monkeypatch.setattr(module, "materialized", spy, raising=False)
    chunks = queries_structure.legal_chunks(spark, "/root/testdata/sf0.001")
    assert chunks.limit(1).count() == 1
    written = [n for n, _ in seen]
    found = dict(seen)["cleaned"].schema
    assert set(found.names) == {"document", "page", "text", "found"} and set(found["found"].dataType.names) == set(provisions.FOUND)
    assert written.count("marked") == 1
    assert next(df for n, df in seen if n == "ranges").columns == ["document", "page", "pos", "line", "_range"]
