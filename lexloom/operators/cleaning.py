"""Cleaning of pages as one chain, with what it did and what it found.

A page stays one row throughout: its lines are an array, and each step is an expression
over it. Rules that depend on earlier lines run in two ways. Where they only look back for
the last line of certain kinds, the kinds are written as a string of one letter a line and
cut into stretches before those letters. Where they depend on what was decided before
(paragraphs), a fold with a small state writes one letter a line. Only repeated edge lines
need other pages: they are counted by document, at most a few lines of each page, and come
back as one short list a document.

Defined cases: a null or blank page gives an empty text with counters of 0 and without
findings; pages that share a number are pages like others; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions import text as T
from lexloom.plans import dims
from lexloom.operators.search import maybe_broadcast
from lexloom.sources.tables import dealt, materialized, small_batches

#: Share of a document's pages that a repeated line stands on, and lines of an edge.
SHARE, EDGE, LONGEST_EDGE = 0.8, 4, 180

COUNTERS = [
    "original_characters", "cleaned_characters", "characters_removed", "headers_removed", "footers_removed", "artifacts_removed", "footnotes_removed",
    "amendment_notes_removed", "amendment_continuation_lines_removed", "broken_words_fixed", "hyphenations_fixed", "sections_detected", "chapters_detected",
    "standalone_chapters_detected", "parts_detected", "explanations_detected", "illustrations_detected", "enumerations_detected", "inline_section_bodies_split",
    "heading_only_pages_detected",
]


def nfkc(c: Column) -> Column:
    """Compatibility normalization, which has no built-in function."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    # Texts that hold stable characters alone are as they should be and needn't go to Python.
    return F.coalesce(F.pandas_udf(run, StringType())(F.when(c.rlike(T.UNSTABLE), c)), c)


def _like(c: Column, pattern: str) -> Column:
    return c.rlike(T.uni("(?i)" + pattern))


def _any(c: Column, *patterns: str) -> Column:
    """Any of patterns that begin at a line's start, which is tried once for all."""
    return _like(c, "^(?:" + "|".join(f"(?:{p.removeprefix('^')})" for p in patterns) + ")")


# ---- single lines -----------------------------------------------------------------


def for_frequency(line: Column) -> Column:
    """A line as it is compared between pages: numbers of pages don't tell them apart."""
    x = F.lower(T.stripped(F.regexp_replace(line, T.uni(r"\s+"), " ")))
    x = F.regexp_replace(x, T.uni(r"\bpage\s+\d+\b"), "page <n>")
    return F.regexp_replace(x, T.uni(r"^\d+$"), "<page-number>")


def section_heading(line: Column) -> Column:
    """(number, title, body) of a line that opens a section, else null. Of the colons that
    could end the title the first one counts after which operative words stand; without one
    the whole line is the title."""
    g = lambda i: F.regexp_extract(line, T.uni("(?is)" + dims.SECTION_LINE), i)
    cut = T.uni(rf'(?is)^(.+?):\s*(["(\[\'\s]*{dims.BODY_STARTER}.*)$')

    def split(v: Column) -> Column:
        title = F.when(v["body"] == "", v["rest"]).otherwise(F.regexp_replace(T.stripped(F.regexp_extract(v["rest"], cut, 1)), r"[ ,;.\-]+$", ""))
        return F.struct(v["number"], title.alias("title"), v["body"])

    own = T.once(F.struct(g(1).alias("number"), g(2).alias("rest")), lambda v: F.struct(v["number"], v["rest"], F.when(v["rest"].contains(":"), F.regexp_extract(v["rest"], cut, 2)).otherwise("").alias("body")))
    return F.when(is_section(line), T.once(own, split))


def is_section(line: Column) -> Column:
    return line.rlike(T.uni(r"(?i)^\s*\d+(?:-[A-Za-z]+)?[A-Za-z]?\.\s*[^\s]"))


def titlelike(line: Column) -> Column:
    """A short subject line: it begins with OF, or nearly all its letters are capitals."""
    letters, capitals = (F.length(F.regexp_replace(line, rf"[^\p{{{k}}}]", "")) for k in ("L", "Lu"))
    form = (F.length(line) <= 140) & ~line.rlike("[.;,]$") & ~_like(line, "^" + dims.BODY_STARTER)
    return form & (letters > 0) & (F.upper(line).startswith("OF ") | (capitals / F.greatest(F.lit(1), letters) >= 0.8))


def _quoted(line: Column) -> Column:
    return line.rlike("^[\"']|(?:\"|'\\.|\";|\"\\.)$")


def _continues(line: Column) -> Column:
    """Lines that go on with an amendment note. A blank line never comes here."""
    quoted = (F.length(line) <= 140) & _quoted(line)
    cited = _like(line, r"^\s*\([IVXLCDM]+\s+of\s+\d{4}\).{0,80}S\.\s*\d+")
    return ~_like(line, dims.CONTENT_START) & (_like(line, dims.AMENDMENT_CONTINUATION) | quoted | cited)


# ---- the chain --------------------------------------------------------------------


def repeated_edges(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(document, repeated): first and last lines that a share of a document's pages repeat.
    Each page names a line once and has 2 * EDGE lines at most, so a document's list holds
    3 * EDGE lines at most at the least share of three pages."""
    x = pages.where(F.coalesce(F.col("text"), F.lit("")).rlike(T.uni(r"\S")))
    # Normalization and clean_whitespace() neither part, join nor empty lines: only the lines
    # of the edges go through them. A line of spaces and invisible characters counts as blank.
    full = F.filter(T.split_lines(F.col("text")), lambda v: v.rlike(T.uni(rf"[^\s{T.INVISIBLE}]")))
    edge = T.once(full, lambda v: F.concat(F.slice(v, 1, EDGE), F.slice(v, F.greatest(F.lit(1), F.size(v) - EDGE + 1), EDGE)))
    # Lines that can't become short enough leave at once: those of plain text and single spaces.
    able = F.filter(edge, lambda v: (F.length(v) <= LONGEST_EDGE + 2) | v.contains("  ") | v.contains("\t") | v.rlike(T.ODD))
    lines = F.transform(F.split(T.clean_whitespace(nfkc(F.col("edge"))), "\n"), lambda v: T.stripped(F.regexp_replace(v, T.uni(r"\s+"), " ")))
    x = x.select("document", F.array_join(able, "\n").alias("edge")).select("document", lines.alias("ls"))
    own = F.array_distinct(F.transform(F.filter("ls", lambda v: F.length(v) <= LONGEST_EDGE), for_frequency))
    n = x.groupBy("document").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")
    seen = x.select("document", F.explode(F.filter(own, lambda v: ~v.isin("", "<page-number>"))).alias("line")).groupBy("document", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    often = seen.join(n, "document").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share)))
    return often.groupBy("document").agg(F.sort_array(F.collect_list("line")).alias("repeated"))


#: How lines of a kind other than T begin, where it isn't for their end or for other pages,
#: and lines that structure a page.
OPENS = r"(?i)^\s*(?:[\d\[\]*_(\"']|pakistan|page|for|the|with|vide|see|read|by|s\.|and)"
STRUCTURES = r"(?i)^\s*[\d(cepivxlmd]"


def _kinds(line: Column, repeated: Column) -> Column:
    """A letter for each line: B blank, H header, F footer, A mark, N amendment note, M what
    may continue one, T other text."""
    own = (
        F.when(T.is_header(line), "H").when(T.is_footer(line), "F").when(T.is_mark(line), "A")
        .when(_like(line, dims.AMENDMENT_NOTE), "N").when(_continues(line), "M").otherwise("T")
    )
    known = F.when(line == "", "B").when((F.size(repeated) > 0) & F.array_contains(repeated, for_frequency(line)), "H")
    return known.when(line.rlike(T.uni(OPENS)) | ((F.length(line) <= 140) & _quoted(line)), own).otherwise("T")


def _after_notes(kinds: Column) -> Column:
    """The kinds with R for lines that continue a note: the last line before them that is
    a note or text is a note. Stretches begin at these."""
    return F.array_join(F.transform(F.split(kinds, "(?=[NT])"), lambda s: F.when(s.startswith("N"), F.translate(s, "M", "R")).otherwise(s)), "")


def _tally(kinds: str, letters: str) -> Column:
    return (F.length(kinds) - F.length(F.translate(F.col(kinds), letters, ""))).cast("long")


def clean_pages(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(document, page, text, counters, found) of pages (document, page, text): the cleaned
    text, the 20 counters as a struct, and what page_lines_found() and page_mentions() find in it."""
    small_batches(pages.sparkSession)
    # Written, so that its size is known: pages stay where they are dealt to if it is small.
    # Joined by shuffle, the pages of a large document would go to one task.
    edges = materialized(repeated_edges(pages, share), "repeated")
    x = dealt(pages.select("document", "page", "text"), "document", "page").join(maybe_broadcast(edges), "document", "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))
    x = x.select("document", "page", F.coalesce("text", F.lit("")).alias("raw"), "repeated").withColumn("odd", F.col("raw").rlike(T.ODD))
    x = x.withColumn("t", F.when(F.col("odd"), T.clean_whitespace(nfkc(F.when(F.col("odd"), F.col("raw"))))).otherwise(F.col("raw")))
    x = x.withColumn("h", T.split_words_counted(F.col("t"))).withColumn("o", T.ocr_counted(F.col("h.t")))
    x = x.select("document", "page", "repeated", F.length("raw").cast("long").alias("original"), F.col("h.n").alias("hyphens"), F.col("o.n").alias("broken"), F.col("o.some").alias("some"), F.when(F.col("odd"), F.split("o.t", T.LINE_END)).otherwise(F.split("o.t", "\n")).alias("ls"))
    x = x.withColumn("ls", F.transform("ls", lambda v: T.stripped(T.single_spaced(v))))
    x = x.withColumn("kinds", _after_notes(F.array_join(F.transform("ls", lambda v: _kinds(v, F.col("repeated"))), "")))
    # Lines that stay, with their marks taken out; some are nothing but marks.
    pairs = F.filter(F.arrays_zip(F.col("ls").alias("line"), F.split("kinds", "").alias("kind")), lambda v: v["kind"].isin("B", "T", "M"))
    x = x.withColumn("own", F.transform(pairs, lambda v: F.struct(v["line"].alias("line"), T.strip_citation_marks(v["line"]).alias("clean"))))
    x = x.withColumn("marked", F.size(F.filter("own", lambda v: v["line"] != v["clean"])).cast("long"))
    kept = F.filter("own", lambda v: (v["line"] == "") | (v["clean"] != ""))
    x = x.withColumn("own", F.transform(kept, lambda v: F.struct(v["clean"].alias("line"), section_heading(v["clean"]).alias("s")))).drop("ls")
    split = lambda v: F.coalesce(v["s"]["body"] != "", F.lit(False))
    x = x.withColumn("opening", F.transform(F.filter("own", lambda v: v["s"].isNull() & v["line"].rlike(T.uni(STRUCTURES))), lambda v: v["line"]))
    count = lambda p: F.size(F.filter("opening", lambda v: _like(v, p))).cast("long")
    x = x.withColumns({
        "sections": F.size(F.filter("own", lambda v: v["s"].isNotNull())).cast("long"), "bodies": F.size(F.filter("own", split)).cast("long"),
        "chapters": count(dims.CHAPTER_LINE), "parts": count(dims.PART_LINE), "explanations": count(dims.EXPLANATION_LINE), "illustrations": count(dims.ILLUSTRATION_LINE),
        "enumerations": count(dims.ENUMERATION_LINE),
    })
    heading = lambda v: F.concat(v["s"]["number"], F.lit(". "), v["s"]["title"], F.lit(":"))
    x = x.withColumn("ls", F.flatten(F.transform("own", lambda v: F.when(split(v), F.array(heading(v), F.lit(""), v["s"]["body"])).otherwise(F.array(v["line"]))))).drop("own", "opening")
    x = _paragraphs(x)
    # Letters come together anew only where a mark was taken out of a line.
    pair = lambda o: F.struct(o["t"].alias("t"), o["n"].alias("n"))
    again = F.when(F.col("some") | (F.col("marked") > 0), pair(T.ocr_counted(F.col("joined")))).otherwise(pair(T.repairs_counted(F.col("joined"), T.SPACED_REPAIRS)))
    x = x.withColumn("o", again).withColumn("text", T.punct_spacing(F.col("o.t"))).withColumn("broken", F.col("broken") + F.col("o.n"))
    # Apart, so that what reads the counters alone doesn't look for keywords and citations.
    x = x.withColumn("held", page_lines_found(F.col("text"))).withColumn("found", F.struct(*[F.col(f"held.{c}").alias(c) for c in LINES_FOUND], *[c.alias(k) for k, c in page_mentions(F.col("text")).items()]))
    x = x.withColumn("cleaned", F.length("text").cast("long"))
    value = {
        "original_characters": F.col("original"), "cleaned_characters": F.col("cleaned"), "characters_removed": F.greatest(F.lit(0).cast("long"), F.col("original") - F.col("cleaned")),
        "headers_removed": _tally("kinds", "H"), "footers_removed": _tally("kinds", "F"), "artifacts_removed": _tally("kinds", "A"), "footnotes_removed": _tally("kinds", "ANR") + F.col("marked"),
        "amendment_notes_removed": _tally("kinds", "N"), "amendment_continuation_lines_removed": _tally("kinds", "R"), "broken_words_fixed": F.col("broken"), "hyphenations_fixed": F.col("hyphens"),
        "sections_detected": F.col("sections"), "chapters_detected": F.col("chapters") + F.col("alone"), "standalone_chapters_detected": F.col("alone"), "parts_detected": F.col("parts"),
        "explanations_detected": F.col("explanations"), "illustrations_detected": F.col("illustrations"), "enumerations_detected": F.col("enumerations"),
        "inline_section_bodies_split": F.col("bodies"), "heading_only_pages_detected": F.col("held.heading_only_page").cast("long"),
    }
    return x.select("document", "page", "text", F.struct(*[value[c].alias(c) for c in COUNTERS]).alias("counters"), "found")


def _paragraphs(x: DataFrame) -> DataFrame:
    """ls (lines, blank ones between) as joined (paragraphs, two line ends between) and alone
    (lone numerals with a title below). Headings are paragraphs of their own; so is a title
    whose paragraph before is a chapter's number."""
    prev = F.concat(F.array(F.lit("")), F.slice("ls", 1, F.greatest(F.lit(0), F.size("ls") - 1)))
    full = F.filter(F.arrays_zip(F.col("ls").alias("line"), prev.alias("before")), lambda v: v["line"] != "")
    x = x.withColumn("full", full)
    nxt = F.concat(F.slice("full", 2, F.greatest(F.lit(1), F.size("full"))), F.array(F.struct(F.lit("").alias("line"), F.lit("").alias("before"))))
    x = x.withColumn("full", F.arrays_zip(F.col("full").alias("own"), nxt.alias("next")))

    def kind(v: Column) -> Column:
        line, below = v["own"]["line"], v["next"]["line"]
        roman, title = _like(line, dims.ROMAN_LINE), titlelike(line)
        plain = F.when(title, "Q").otherwise("P")
        fixed = is_section(line) | _any(line, dims.PART_LINE, dims.EXPLANATION_LINE, dims.ILLUSTRATION_LINE, dims.ENUMERATION_LINE)
        # L lone numeral with a title below, C chapter, S other heading; of plain lines: X both a
        # numeral and like a title, R numeral, U, K the word before a numeral, Q title, P others.
        word = _like(line, "^CHAPTER$")
        return F.when(~line.rlike(T.uni(STRUCTURES)), plain).otherwise(
            F.when(roman & titlelike(below), "L").when(_like(line, dims.CHAPTER_LINE), "C").when(fixed, "S").when(roman & title, "X").when(roman, "R")
            .when(word & title, "U").when(word, "K").otherwise(plain)
        )

    # Two letters a line: + where a blank line stands before it.
    x = x.withColumn("steps", F.transform("full", lambda v: F.struct((v["own"]["before"] == "").alias("gap"), kind(v).alias("k"))))
    start = F.struct(F.lit(False).alias("mark"), F.lit("").alias("cur"), F.lit("").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        # Saving a paragraph of one numeral, or of the word and a numeral, marks a chapter.
        saved = F.when(acc["cur"] == "", acc["mark"]).otherwise(acc["cur"].rlike("^[UK]?[RX]$"))
        mark, cur = F.when(v["gap"], saved).otherwise(acc["mark"]), F.when(v["gap"], F.lit("")).otherwise(acc["cur"])
        fixed = v["k"].isin("L", "C", "S")
        alone = fixed | (mark & v["k"].isin("X", "U", "Q"))
        new = F.when(alone, F.when(fixed, v["k"].isin("L", "C")).otherwise(v["k"] == "X")).otherwise(mark)
        # Two lines tell all that matters of a paragraph.
        own = F.when(alone, F.lit("")).otherwise(F.substring(F.concat(cur, v["k"]), 1, 3))
        return F.struct(new.alias("mark"), own.alias("cur"), F.concat(acc["out"], F.when(alone, "H").when(v["gap"], "G").otherwise("P")).alias("out"))

    x = x.withColumn("marks", F.aggregate("steps", start, step)["out"])
    # A line joins the one before if both are plain and no blank line parts them.
    marks = F.split("marks", "")
    x = x.withColumn("ends", F.arrays_zip(F.transform("full", lambda v: v["own"]["line"]).alias("line"), marks.alias("m"), F.concat(F.array(F.lit("H")), marks).alias("b")))
    parts = F.transform(F.filter("ends", lambda v: v["line"].isNotNull()), lambda v: F.concat(F.when((v["m"] == "P") & (v["b"] != "H"), " ").otherwise("\n\n"), v["line"]))
    alone = F.size(F.filter("steps", lambda v: v["k"] == "L")).cast("long")
    return x.withColumn("joined", F.regexp_replace(F.array_join(parts, ""), "^\n\n", "")).withColumn("alone", alone).drop("full", "steps", "marks", "ends", "ls")


# ---- findings ---------------------------------------------------------------------


def keywords(text: Column) -> Column:
    """The first MOST_KEYWORDS of the legal terms that stand in a text, in the list's order."""
    # Most terms stand nowhere, which plain search tells.
    one = lambda low: F.array_compact(F.array(*[F.when(low.contains(T.rare_part(t)) & low.rlike(T.uni(rf"\b{t}\b")), F.lit(t)) for t in dims.LEGAL_TERMS]))
    return F.slice(T.once(F.lower(text), one), 1, dims.MOST_KEYWORDS)


def legal_references(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(T.uni("(?i)" + dims.LEGAL_REFERENCE)), F.lit(1)), F.upper))


#: What a cleaned page's lines hold: numbers and titles of its sections, its first chapter and
#: part, whether it has a body besides its headings, and its topic.
LINES_FOUND = ["section_numbers", "section_titles", "chapter_number", "chapter_title", "part", "primary_section", "primary_section_title", "legal_topic", "section_body_present", "heading_only_page", "section_heading_count", "non_heading_character_count"]


def page_mentions(text: Column) -> dict[str, Column]:
    """What is said anywhere in a cleaned page. Most pages say nothing of it, which plain
    search for a part tells: one without the letters that other scripts write as i, k or s."""
    low = F.lower(text)
    return {
        "contains_explanation": low.contains("explanat") & text.rlike(T.uni(r"(?mi)^\s*Explanation(?:\s+\d+)?\b")),
        "contains_illustration": low.contains("llu") & text.rlike(T.uni(r"(?mi)^\s*Illustrations?\b")),
        "keywords": keywords(text), "legal_references": F.when(low.contains("ec"), legal_references(text)).otherwise(F.array().cast("array<string>")),
    }


def page_lines_found(text: Column) -> Column:
    """The findings that a cleaned page's lines, which end in LF alone, hold: LINES_FOUND as a
    struct."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.stripped), lambda v: v != "")
    number = lambda v, p: F.upper(F.regexp_extract(v, T.uni("(?i)" + p), 1))
    row = lambda v, s, c, r: F.struct(v.alias("line"), s.alias("s"), c.alias("c"), r.alias("r"), titlelike(v).alias("t"))
    no = F.lit(None).cast("struct<number: string, title: string, body: string>")
    rows = F.transform(lines, lambda v: F.when(v.rlike(T.uni(STRUCTURES)), row(v, section_heading(v), number(v, dims.CHAPTER_LINE), number(v, dims.ROMAN_LINE))).otherwise(row(v, no, F.lit(""), F.lit(""))))
    none = F.struct(F.lit("").alias("line"), no.alias("s"), F.lit("").alias("c"), F.lit("").alias("r"), F.lit(False).alias("t"))
    chapter = lambda v: F.when(v["own"]["c"] != "", F.struct(v["own"]["c"].alias("number"), F.when(v["next"]["t"], v["next"]["line"]).alias("title"))).when((v["own"]["r"] != "") & v["next"]["t"], F.struct(v["own"]["r"].alias("number"), v["next"]["line"].alias("title")))

    def build(a: Column) -> Column:
        paired = F.arrays_zip(a.alias("own"), F.concat(F.slice(a, 2, F.greatest(F.lit(1), F.size(a))), F.array(none)).alias("next"), F.concat(F.array(none), a).alias("prev"))
        paired = F.filter(paired, lambda v: v["own"].isNotNull())
        heads = F.filter(F.transform(a, lambda v: v["s"]), lambda s: s.isNotNull())
        is_chapter = lambda v: v["own"]["s"].isNull() & chapter(v).isNotNull()
        # The title below a chapter's number counts as heading too.
        below = lambda v: v["prev"]["s"].isNull() & v["own"]["t"] & ((v["prev"]["c"] != "") | (v["prev"]["r"] != ""))
        body = F.filter(paired, lambda v: v["own"]["s"].isNull() & ~is_chapter(v) & ~below(v) & ~_any(v["own"]["line"], dims.PART_LINE, dims.EXPLANATION_LINE, dims.ILLUSTRATION_LINE))
        # Of the lines with a space between; they are stripped and none is empty.
        size = F.greatest(F.lit(0), F.aggregate(body, F.lit(-1), lambda n, v: n + F.length(v["own"]["line"]) + 1))
        n = F.size(heads)
        only = (n > 0) & (size < F.greatest(F.lit(120), 45 * n))
        titles = F.array_distinct(F.filter(F.transform(heads, lambda s: F.regexp_replace(s["title"], T.uni(r"\s*:$"), "")), lambda t: t != ""))
        numbers = F.array_distinct(F.transform(heads, lambda s: s["number"]))
        first = F.get(F.filter(F.transform(paired, chapter), lambda c: c.isNotNull()), F.lit(0))
        part = F.get(F.filter(F.transform(a, lambda v: F.upper(F.regexp_extract(v["line"], T.uni("(?i)" + dims.PART_LINE), 1))), lambda p: p != ""), F.lit(0))
        return F.struct(
            numbers.alias("section_numbers"), titles.alias("section_titles"), first["number"].alias("chapter_number"), first["title"].alias("chapter_title"), part.alias("part"),
            F.get(numbers, F.lit(0)).alias("primary_section"), F.get(titles, F.lit(0)).alias("primary_section_title"),
            F.lower(F.coalesce(F.get(titles, F.lit(0)), first["title"])).alias("legal_topic"), (~only).alias("section_body_present"), only.alias("heading_only_page"),
            n.alias("section_heading_count"), size.alias("non_heading_character_count"),
        )

    # The rows are made once: a lambda's argument holds them where build() reads them.
    return T.once(rows, build)


def cleaning_totals(cleaned: DataFrame) -> DataFrame:
    """The counters of each document, added up over its pages, and their number."""
    return cleaned.groupBy("document").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(f"counters.{c}").alias(c) for c in COUNTERS])
