"""The cleaning chain against a plain loop over each page's lines."""

import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import cleaning
from lexloom.plans import dims

SF = "/root/testdata/sf0.001"
I = re.IGNORECASE  # noqa: E741


def replaced(text, steps):
    n = 0
    for pattern, new in steps:
        text, k = re.subn(pattern, new, text)
        n += k
    return text, n


OCR = [("(?i)" + re.escape(a), b) for a, b in dims.OCR_REPAIRS.items()] + dims.JOINED_WORDS


def plain(text):
    x = unicodedata.normalize("NFKC", text)
    x = "".join(ch for ch in x if ch not in "­​‌‍⁠﻿").replace("\xa0", " ")
    return x.replace("\r\n", "\n").replace("\r", "\n")


def frequency(line):
    x = " ".join(line.split()).lower()
    x = re.sub(r"\bpage\s+\d+\b", "page <n>", x)
    return "<page-number>" if re.fullmatch(r"\d+", x) else x


def repeated(texts, share):
    full, seen = [t for t in texts if t and t.strip()], Counter()
    for t in full if len(full) >= 3 else ():
        ls = [" ".join(v.split()) for v in plain(t).splitlines() if v.strip()]
        seen.update({frequency(v) for v in ls[:4] + ls[-4:] if len(v) <= 180})
    return {v for v, n in seen.items() if n >= max(2, int(len(full) * share)) and v not in ("", "<page-number>")}


def section(line):
    m = re.match(dims.SECTION_LINE, line, I)
    if not m or not m[2]:
        return None
    rest = m[2]
    for k in [i for i, ch in enumerate(rest) if ch == ":" and rest[:i].strip()]:
        if re.match(dims.BODY_STARTER, rest[k + 1 :].lstrip(" \t\"([']"), I):
            return m[1], rest[:k].strip().rstrip(" ,;.-"), rest[k + 1 :].lstrip()
    return m[1], rest, ""


def title(line):
    letters = [ch for ch in line if ch.isalpha()]
    if not letters or len(line) > 140 or line[-1] in ".;," or re.match(dims.BODY_STARTER, line, I):
        return False
    return line.upper().startswith("OF ") or sum(ch.isupper() for ch in letters) >= 0.8 * len(letters)


def is_(pattern, line):
    return bool(re.match(pattern, line, I))


def chapter(lines, k):
    if is_(dims.CHAPTER_LINE, lines[k]):
        return True
    below = next((v for v in lines[k + 1 :] if v), "")
    return is_(dims.ROMAN_LINE, lines[k]) and bool(below) and title(below)


def loop(text, edges):
    c, out, noted = Counter(original_characters=len(text)), [], False
    x, c["hyphenations_fixed"] = replaced(plain(text), dims.SPLIT_WORDS)
    x, c["broken_words_fixed"] = replaced(x, OCR)
    for raw in x.splitlines():
        line = re.sub(r"[ \t]+", " ", raw).strip()
        if not line:
            out.append("")
            continue
        kind = None
        if any(re.fullmatch(p, line, I) for p in dims.HEADER_PATTERNS) or frequency(line) in edges:
            kind = ["headers_removed"]
        elif re.fullmatch(dims.FOOTER_PATTERN, line, I):
            kind = ["footers_removed"]
        elif any(re.fullmatch(p, line) for p in dims.ARTIFACT_PATTERNS):
            kind = ["artifacts_removed", "footnotes_removed"]
        elif is_(dims.AMENDMENT_NOTE, line):
            kind, noted = ["amendment_notes_removed", "footnotes_removed"], True
        elif noted:
            quote = len(line) <= 140 and (line[0] in "\"'" or line.endswith(('"', "'.", '";', '".')))
            cited = re.match(r"\([IVXLCDM]+\s+of\s+\d{4}\).{0,80}S\.\s*\d+", line, I)
            if not is_(dims.CONTENT_START, line) and (is_(dims.AMENDMENT_CONTINUATION, line) or quote or cited):
                kind = ["amendment_continuation_lines_removed", "footnotes_removed"]
            else:
                noted = False
        if kind:
            c.update(kind)
            continue
        clean = replaced(line, dims.CITATION_MARKS)[0].strip()
        c["footnotes_removed"] += clean != line
        if not clean:
            continue
        s = section(clean)
        if s:
            c["sections_detected"] += 1
            c["inline_section_bodies_split"] += s[2] != ""
            out += [f"{s[0]}. {s[1]}:", "", s[2]] if s[2] else [clean]
            continue
        for name, p in (("chapters", dims.CHAPTER_LINE), ("parts", dims.PART_LINE), ("explanations", dims.EXPLANATION_LINE), ("illustrations", dims.ILLUSTRATION_LINE), ("enumerations", dims.ENUMERATION_LINE)):
            c[name + "_detected"] += is_(p, clean)
        out.append(clean)
    paragraphs, now = [], []

    def save():
        if now:
            paragraphs.append(" ".join(now))
            now.clear()

    for k, line in enumerate(out):
        last = paragraphs[-1] if paragraphs else ""
        if not line:
            save()
        elif is_(dims.ROMAN_LINE, line) and chapter(out, k):
            save()
            paragraphs.append(line)
            c["chapters_detected"] += 1
            c["standalone_chapters_detected"] += 1
        elif section(line) or any(is_(p, line) for p in (dims.CHAPTER_LINE, dims.PART_LINE, dims.EXPLANATION_LINE, dims.ILLUSTRATION_LINE, dims.ENUMERATION_LINE)) or (
            (is_(dims.CHAPTER_LINE, last) or is_(dims.ROMAN_LINE, last)) and title(line)
        ):
            save()
            paragraphs.append(line)
        else:
            now.append(line)
    save()
    x, n = replaced("\n\n".join(paragraphs), OCR)
    c["broken_words_fixed"] += n
    x = replaced(x, dims.SPACING)[0].strip()
    c["cleaned_characters"] = len(x)
    c["characters_removed"] = max(0, len(text) - len(x))
    found = findings(x)
    c["heading_only_pages_detected"] = int(found["heading_only_page"])
    return x, {k: c[k] for k in cleaning.COUNTERS}, found


def findings(text):
    lines = [v.strip() for v in text.splitlines() if v.strip()]
    heads = [section(v) for v in lines]
    unique = lambda xs: list(dict.fromkeys(x for x in xs if x))
    numbers = unique(h[0] for h in heads if h)
    titles = unique(re.sub(r"\s*:$", "", h[1]) for h in heads if h)
    own = [k for k in range(len(lines)) if chapter(lines, k)]
    number = name = None
    if own:
        m = re.match(dims.CHAPTER_LINE, lines[own[0]], I) or re.match(dims.ROMAN_LINE, lines[own[0]], I)
        below = lines[own[0] + 1] if own[0] + 1 < len(lines) else ""
        number, name = m[1].upper(), below if below and title(below) else None
    out = {k for k in own if not heads[k]}
    out |= {k + 1 for k in out if k + 1 < len(lines) and title(lines[k + 1])}
    rest = [v for k, v in enumerate(lines) if not heads[k] and k not in out and not any(is_(p, v) for p in (dims.PART_LINE, dims.EXPLANATION_LINE, dims.ILLUSTRATION_LINE))]
    size, n = len(" ".join(rest)), sum(h is not None for h in heads)
    only = n > 0 and size < max(120, 45 * n)
    part = next((m[1].upper() for m in (re.match(dims.PART_LINE, v, I) for v in lines) if m), None)
    topic = titles[0] if titles else name
    return {
        "section_numbers": numbers, "section_titles": titles, "chapter_number": number, "chapter_title": name, "part": part,
        "primary_section": numbers[0] if numbers else None, "primary_section_title": titles[0] if titles else None, "legal_topic": topic and topic.lower(),
        "section_body_present": not only, "heading_only_page": only, "section_heading_count": n, "non_heading_character_count": size,
        "contains_explanation": bool(re.search(r"(?mi)^\s*Explanation(?:\s+\d+)?\b", text)), "contains_illustration": bool(re.search(r"(?mi)^\s*Illustrations?\b", text)),
        "keywords": [t for t in dims.LEGAL_TERMS if re.search(rf"\b{t}\b", text.lower())][: dims.MOST_KEYWORDS],
        "legal_references": unique(m.upper() for m in re.findall(dims.LEGAL_REFERENCE, text, I)),
    }


BITS = [
    "CHAPTER XVI", "XVI", "iv", "CHAPTER", "OF OFFENCES AFFECTING LIFE", "Of hurt", "PART II", "302. Punishment of murder: Whoever commits murder shall be punished", "7. Short title", "298-C. A: b: (\"Any person\" who",
    "12.", "Explanation 1: text", "Illustrations", "(a) first", "(iv) fourth", "1 Inserted by Act X", "by Ordinance", "\"quoted words\";", "(VII of 1979), S. 19", "for the words", "Whoever causes hurt", "Page 12", "14",
    "***", "12[", "law115[but shall] 115; more", "a 1[ 2[ b and 2019 but c", "See section 34 , and Sec. 35-A ( of 1860 )", "ofthe person inthe case", "aJudge took the property", "imprison-", "ment of1986", "381-", "A. next",
    "Pakistan Penal Code (Act XLV of 1860)", "", "", "   ", "end.Next one ,two", ";x (\ta )", "some plain words", "Theft is an offence with fine", "é ö   x​", "ﬁne of two", "UPPER CASE LINE", "İstanbul",
]


@pytest.fixture(scope="module")
def pages():
    r = random.Random(7)
    made = [(f"d{k % 7}", k, "\r\n".join(r.choice(BITS) for _ in range(r.randrange(16)))) for k in range(500)]
    made += [("e", k, f"THE ACT\nPage {k}\n" + "\n".join(r.choice(BITS) for _ in range(9)) + "\nFoot  note") for k in range(9)]
    return [*made, ("f", 1, None), ("f", 2, ""), ("g", 1, "x " * 5000 + "\n" + "y\n" * 3000)]


def check(rows, pages):
    texts = {}
    for d, _, t in pages:
        texts.setdefault(d, []).append(t)
    edges = {d: repeated(ts, cleaning.SHARE) for d, ts in texts.items()}
    got = {(r.document, r.page): r for r in rows}
    assert len(rows) == len(got) == len(pages)
    for d, p, t in pages:
        text, counters, found = loop(t or "", edges[d])
        r = got[d, p]
        assert r.text == text, t
        assert r.counters.asDict() == counters, t
        assert r.found.asDict() == found, t


def test_pages_match_a_plain_loop(spark, pages):
    df = spark.createDataFrame([(d, p, t, "x", "y") for d, p, t in pages], "document STRING, page LONG, text STRING, own STRING, ls STRING")
    check(cleaning.clean_pages(df.repartition(6)).collect(), pages)


def test_documents_match_a_plain_loop(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("source AS document", "doc_id AS page", "text")
    check(cleaning.clean_pages(df).collect(), [tuple(r) for r in df.collect()])


def test_counters_add_up(spark, pages):
    df = spark.createDataFrame(pages, "document STRING, page LONG, text STRING")
    cleaned = cleaning.clean_pages(df)
    want = {}
    for r in cleaned.collect():
        want.setdefault(r.document, Counter()).update(r.counters.asDict())
    for r in cleaning.cleaning_totals(cleaned).collect():
        assert {c: r[c] for c in cleaning.COUNTERS} == {c: want[r.document][c] for c in cleaning.COUNTERS}
    assert cleaning.clean_pages(df.limit(0)).count() == 0


def test_rules_of_marks_and_spacing(spark):
    from pyspark.sql import functions as F

    from lexloom.functions import text as T

    df = spark.createDataFrame([("end.Next one ,two\n;x (\na )", "a 1[ 2[ b and 2019 but c")], "s STRING, m STRING")
    r = df.select(T.punct_spacing(F.col("s")).alias("s"), T.strip_citation_marks(F.col("m")).alias("m")).first()
    assert (r.s, r.m) == ("end. Next one, two; x (a)", replaced("a 1[ 2[ b and 2019 but c", dims.CITATION_MARKS)[0].strip())


def test_early_tests_change_nothing(spark):
    """Joined words and keywords are those of the plain patterns; only what isn't ASCII goes to
    Python, in bounded batches."""
    texts = ["ofthe court", "éofthe court", "OFTHE COURT", "theCourt and andThe ıncourt İncourt", "1ofthe _ofthe -ofthe (ofthe)", "forTheft byany", "abc123 x12345", "", "fine-print refine fine", "a murder of\nunlawful assembly", "ﬁne ½ theft", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    want = T.substituted(F.col("t"), [*[(r"(?i)" + re.escape(w), r) for w, r in dims.OCR_REPAIRS.items()], *dims.JOINED_WORDS])
    low = F.lower("t")
    words = F.slice(F.array_compact(F.array(*[F.when(low.rlike(T.uni(rf"\b{t}\b")), F.lit(t)) for t in dims.LEGAL_TERMS])), 1, dims.MOST_KEYWORDS)
    rows = df.select("t", T.ocr_counted(F.col("t"))["t"].alias("o"), want.alias("want"), cleaning.keywords(F.col("t")).alias("k"), words.alias("words"), cleaning.nfkc(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.o == r.want and (r.t is None or r.k == r.words) and r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cleaning.clean_pages(df.select(F.lit("d").alias("document"), F.col("i").alias("page"), F.col("t").alias("text")))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512


ODD_BITS = [
    "ofthe", "Inthe", "tothecase", "wilt of a", "deceased", "bean", "received", "theCourt12", "ofan", "onthe ", "ina", "x19", "abc1234 ", "é12", "Mere, if", "a12[", "3[the", "] 4;", "[5]", "7 but", "2019 and", "١٢ but", "a\t b", "  ", " ,x", ".Next", "( a", "b )",
    "\n", "\n\n\n\n", "\r\n", "\x0b", "\u2028", "\u0085", "\u00a0", "\u3000", "\u200b", "\ufeff", "\u00ad", "-\n", "- \n", "12-\nA.", "ﬁne", "½", "ſection 5", "sec. 12-A", "Explanatıon", "Illustrations", "Explanation 2", "İİ", "é", "\x1c", "\x00", "日本 ", "ﬂ́", "CHAPTER II", "IV", "OF HURT", "12. Of a: Whoever",
]


def test_plain_tests_first_change_nothing(spark):
    """What a text must hold is looked for first; results are those of the patterns alone."""
    r = random.Random(5)
    texts = ["".join(r.choice(ODD_BITS) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    texts += [x + chr(c) + y for c in [*range(0x250), *range(0x1680, 0x1681), *range(0x2000, 0x2070), 0x3000, 0xFEFF] for x, y in (("", "a"), ("a", "b"), ("a", ""))]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").repartition(4)
    t, strip = F.col("t"), lambda c: F.regexp_replace(c, T.uni(r"^\s+|\s+$"), "")
    made = {
        "stripped": (T.stripped(t), strip(t)), "lines": (T.split_lines(T.clean_whitespace(t)), F.split(T.clean_whitespace(t), T.LINE_END)), "single": (T.single_spaced(t), F.regexp_replace(t, r"[ \t]+", " ")),
        "words": (T.split_words_counted(t), T.counted(t, dims.SPLIT_WORDS)), "ocr": (T.ocr_counted(t)["t"], T.substituted(t, T.OCR_STEPS)), "ocr_n": (T.ocr_counted(t)["n"], T.counted(t, T.OCR_STEPS)["n"]),
        "marks": (T.strip_citation_marks(t), strip(T.substituted(t, dims.CITATION_MARKS))), "spacing": (T.punct_spacing(t), strip(T.substituted(t, dims.SPACING))),
        "explanation": (cleaning.page_mentions(t)["contains_explanation"], t.rlike(T.uni(r"(?mi)^\s*Explanation(?:\s+\d+)?\b"))), "references": (cleaning.page_mentions(t)["legal_references"], cleaning.legal_references(t)),
        "illustration": (cleaning.page_mentions(t)["contains_illustration"], t.rlike(T.uni(r"(?mi)^\s*Illustrations?\b"))), "nfkc": (cleaning.nfkc(t), F.col("want")),
    }
    want = spark.createDataFrame([(i, unicodedata.normalize("NFKC", x)) for i, x in enumerate(texts)], "i INT, want STRING")
    both = df.join(want, "i").select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in made.items()])
    for row in both.collect():
        for k in made:
            assert row[k].a == row[k].b, (k, row.t)


def test_what_normalization_keeps():
    """Stable characters stay as they are and never join one before; normalization neither makes
    nor takes white space or what is invisible, so that edges may be normalized line by line."""
    blank = re.compile(f"[\\s{T.INVISIBLE}]")
    stable = re.compile(f"[{T.STABLE}]")
    for i in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(i)
        if stable.match(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c)
        assert all(blank.match(x) for x in unicodedata.normalize("NFKC", c)) == bool(blank.match(c)), hex(i)
        assert not set(unicodedata.normalize("NFKC", c)) & set("\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029") or unicodedata.normalize("NFKC", c) == c


def test_odd_pages_match_a_plain_loop(spark):
    """Both rounds of joined words, marks taken out between them and edges of any white space.
    Digits, signs and line ends that Java and Python tell apart otherwise stay out."""
    r = random.Random(11)
    bits = [b for b in ODD_BITS if b not in ("\x1c", "\x00", "İİ", "Explanatıon", "١٢ but", "é12", "\u200b", "\ufeff", "\u00ad")]
    pages = [("d", k, "".join(r.choice(bits) + r.choice(["", " ", "\n", "]\n"]) for _ in range(r.randrange(1, 16)))) for k in range(400)]
    edge = ["The  Act\u3000of 1860", " The Act of 1860\r", "The Act of 1860\u200b", "\u200b\nTHE ACT OF 1860"]
    pages += [("e", k, edge[k % 4] + "\n" + "word " * (40 * (k % 2)) + f"\nline {'abcdefghi'[k]}\n" + "x\n" * 9 + "end of\tit") for k in range(9)]
    check(cleaning.clean_pages(spark.createDataFrame(pages, "document STRING, page LONG, text STRING")).collect(), pages)


def test_pages_of_a_document_go_to_many_tasks(spark):
    """Pages that came in one split, all of one document, aren't cleaned by one task."""
    df = spark.createDataFrame([("d", k, f"Page {k}\nsome words") for k in range(400)], "document STRING, page LONG, text STRING").coalesce(1)
    cleaned = cleaning.clean_pages(df)
    counts = [r["count"] for r in cleaned.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) >= 8 and max(counts) <= 100


def test_counters_do_without_mentions(spark):
    """Totals of counters don't look for keywords and citations."""
    df = spark.createDataFrame([("d", 1, "Theft, section 5")], "document STRING, page LONG, text STRING")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    cleaned = cleaning.clean_pages(df)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        assert "abetment" in plan(cleaned) and "abetment" not in plan(cleaning.cleaning_totals(cleaned))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
