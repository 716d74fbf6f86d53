"""Pages and chunks: lines, repeated edges, regions, offsets, provisions, numbering."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexloom.functions import text as T
from lexloom.operators import ordered
from lexloom.plans import dims
from lexloom.sources.tables import materialized, small_batches


def exploded_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line, pos from 0."""
    return pages.select("*", F.posexplode(F.split(text, "\n")).alias("pos", "line")).drop(text)


def repeated_edge_lines(pages: DataFrame, share: float = 0.8, depth: int = 4) -> DataFrame:
    """(document, line, n_pages): first and last lines of pages that most pages of their
    document repeat. pages: (document, page, text). The first and last lines of a page are
    sliced within its row, so only they are shuffled."""
    x = F.filter(F.transform(F.split("text", "\n"), lambda v: F.trim(v)), lambda v: v != "")
    edge = F.when(F.size(x) > 2 * depth, F.concat(F.slice(x, 1, depth), F.slice(x, -depth, depth))).otherwise(x)
    plain = F.transform(F.filter(edge, lambda v: F.length(v) <= 180), lambda v: F.regexp_replace(F.lower(v), r"\s+", " "))
    keep = F.array_distinct(F.filter(plain, lambda v: (v != "") & ~v.rlike(dims.FOOTER_PATTERN + "$")))
    full = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    n = full.groupBy("document").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")
    seen = full.select("document", F.explode(keep).alias("line")).groupBy("document", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    return seen.join(n, "document").where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("document", "line", "n_pages")


def amendment_regions(lines: DataFrame) -> DataFrame:
    """lines (doc, pos, line) with removed: a note opens a region, which continuations and
    blank lines carry on and any other line closes."""
    c = F.col("line")
    note = c.rlike("(?i)" + dims.AMENDMENT_NOTE)
    quoted = (F.length(c) <= 140) & c.rlike("^[\"'“‘]")
    more = ~c.rlike("(?i)" + dims.CONTENT_START) & (c.rlike("(?i)" + dims.AMENDMENT_CONTINUATION) | quoted)
    kind = F.when(F.trim(c) == "", "blank").when(note, "note").when(more, "more").otherwise("text")
    x = lines.withColumn("kind", kind)
    # A region is all that follows a line which either opens or closes it.
    order = W.partitionBy("doc").orderBy("pos")
    x = x.withColumn("island", F.sum(F.col("kind").isin("note", "text").cast("int")).over(order))
    opened = F.max((F.col("kind") == "note").cast("int")).over(W.partitionBy("doc", "island")) == 1
    return x.withColumn("removed", opened & (F.col("kind") != "blank")).drop("kind", "island")


def chapter_headings(lines: DataFrame) -> DataFrame:
    """CHAPTER lines, or lone Roman numerals, that a title follows."""
    nxt = F.lead("line").over(W.partitionBy("doc").orderBy("pos"))
    letters, upper = F.length(F.regexp_replace("next", "[^A-Za-z]", "")), F.length(F.regexp_replace("next", "[^A-Z]", ""))
    title = F.col("next").rlike("(?i)^OF ") | ((letters > 0) & (upper / letters >= 0.8))
    number = F.upper(F.regexp_extract("line", r"(?i)^\s*(?:CHAPTER\s+)?([IVXLCDM]+)\s*$", 1))
    return lines.withColumn("next", nxt).where((number != "") & title).select("doc", "pos", number.alias("number"), F.col("next").alias("title"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc, paragraph, text): lines up to a blank one, joined by spaces."""
    order = W.partitionBy("doc").orderBy("pos")
    x = lines.withColumn("blank", F.trim("line") == "").withColumn("paragraph", F.sum(F.col("blank").cast("int")).over(order))
    own = F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("line"))))
    return x.where("NOT blank").groupBy("doc", "paragraph").agg(F.array_join(F.transform(own, lambda v: v["line"]), " ").alias("text"))


# ---- chunks ---------------------------------------------------------------------


def page_offsets(pages: DataFrame) -> DataFrame:
    """[start, end) of each page in its document's joined text, two characters between."""
    x = pages.select("document", "page", F.length("text").cast("long").alias("size")).withColumn("step", F.col("size") + 2)
    x = ordered.totals(ordered.ranged(x.where("document IS NOT NULL"), "document", "page"), ["document"], ["page"], {"start": "step"})
    return x.select("document", "page", "start", (F.col("start") + F.col("size")).alias("end"))


def pages_of(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """(document, span, pages): pages that overlap each span of their document. One sweep
    over the bounds of both: how many pages end up to a span's start, and how many start
    before its end, are the numbers of the pages that it overlaps, so that the join with them
    is by number. Pages of a document follow one another."""
    o = ordered.places(ordered.ranged(offsets.select("document", "page", F.col("start").cast("long"), F.col("end").cast("long")), "document", "start", "page"), ["document"], ["start", "page"], "k")
    o = materialized(o.drop("_range"), "numbered_pages")
    none = F.lit(None).cast(spans.schema["span"].dataType)
    bound = lambda df, at, tie, ends, starts, span: df.select("document", F.col(at).cast("long").alias("at"), F.lit(tie).alias("tie"), F.lit(ends).cast("long").alias("ends"), F.lit(starts).cast("long").alias("starts"), span.alias("span"))
    swept = bound(o, "end", 0, 1, 0, none).unionByName(bound(o, "start", 3, 0, 1, none)).unionByName(bound(spans, "start", 1, 0, 0, F.col("span"))).unionByName(bound(spans, "end", 2, 0, 0, F.col("span")))
    swept = ordered.totals(ordered.ranged(swept, "document", "at", "tie"), ["document"], ["at", "tie"], {"ended": "ends", "started": "starts"}).where("span IS NOT NULL")
    near = swept.groupBy("document", "span").agg(F.max(F.when(F.col("tie") == 1, F.col("ended"))).alias("lo"), F.max(F.when(F.col("tie") == 2, F.col("started"))).alias("hi")).where("hi > lo")
    hit = near.select("document", "span", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("k")).join(o, ["document", "k"])
    return hit.groupBy("document", "span").agg(F.array_join(F.array_sort(F.collect_set("page")).cast("array<string>"), ",").alias("pages"))


def provision_candidates(lines: DataFrame) -> DataFrame:
    """(doc, pos, number, title): lines that open a section, by form and reject rules."""
    from lexloom.operators.provisions import valid_candidate

    g = lambda i: F.regexp_extract("line", "(?i)" + dims.PROVISION, i)
    x = lines.select("doc", "pos", g(1).alias("label"), T.canonical_number(g(2)).alias("number"), T.stripped(g(3)).alias("title"))
    return x.where(valid_candidate(F.col("label"), F.col("number"), F.col("title"), F.lit("section"))).select("doc", "pos", "number", "title")


def next_boundary(starts: DataFrame, bounds: DataFrame) -> DataFrame:
    """The nearest boundary after each start, before its end: one ordered pass over both
    kinds of rows instead of a range join."""
    x = starts.select("doc", "start", "end", F.lit(None).cast("long").alias("b")).unionByName(bounds.select("doc", F.col("b").alias("start"), F.lit(None).cast("long").alias("end"), "b"))
    after = W.partitionBy("doc").orderBy("start").rangeBetween(1, W.unboundedFollowing)
    near = F.min("b").over(after)
    return x.withColumn("near", near).where("b IS NULL").select("doc", "start", F.when(F.col("near") < F.col("end"), F.col("near")).alias("boundary"))


def provision_blocks(candidates: DataFrame) -> DataFrame:
    """Each provision's lines: up to the next one of its document."""
    nxt = F.lead("pos").over(W.partitionBy("doc").orderBy("pos"))
    return candidates.select("doc", "number", "title", F.col("pos").alias("first"), (nxt - 1).alias("last"))


def context_heading(short: Column, kind: Column, number: Column, title: Column, path: Column) -> Column:
    """``ATA | Section 7: Title | Section 7(1)(b)``."""
    head = F.concat(F.initcap(kind), F.lit(" "), number)
    child = F.when(F.size(path) > 0, F.concat(head, F.array_join(F.transform(path, lambda p: F.concat(F.lit("("), p, F.lit(")"))), "")))
    return F.concat_ws(" | ", short, F.concat(head, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(": "), title)).otherwise("")), child)


def child_components(lines: DataFrame) -> DataFrame:
    """(doc, pos, label, kind, path, key): markers at line starts. A number opens a
    subsection; letters are a clause of the last subsection, and nothing before one."""
    x = lines.select("doc", "pos", F.regexp_extract("line", CHILD_MARKER, 1).alias("label")).where("label <> ''")
    x = x.withColumn("label", F.lower("label")).withColumn("kind", F.when(F.col("label").rlike(r"^\d+$"), "subsection").otherwise("clause"))
    current = F.last(F.when(F.col("kind") == "subsection", F.col("label")), ignorenulls=True).over(W.partitionBy("doc").orderBy("pos"))
    x = x.withColumn("path", F.when(F.col("kind") == "subsection", F.array("label")).otherwise(F.array(current, "label")))
    return x.where(~F.array_contains(F.transform("path", lambda v: v.isNull()), True)).withColumn("key", F.array_join("path", "."))


CHILD_MARKER = r"^\s*\(([A-Za-z]+|\d+)\)\s*"

# Where a long text is cut, the best place first.
SEPARATORS = [
    r"\n(?=Explanation(?:\s+\d+)?\s*[:.\-—–]?)", r"\n(?=Illustrations?\s*[:.\-—–]?\s*$)", r"\n(?=\(\d+\)\s+)", r"\n(?=\([a-z]\)\s+)", r"\n(?=\([ivxlcdm]+\)\s+)",
    r"\n\n+", r"\n", r"(?<=[.!?])\s+", r"\s+", "",
]
#: Characters of a chunk with its heading, what neighbours share, and the least of a body.
LIMIT, OVERLAP, LEAST = 1000, 150, 200


def split_text(text: str, limit: int, overlap: int) -> list[str]:
    """Pieces of less than limit characters, cut before the first separator of the list that
    occurs, longer ones again by the next; pieces are put together while they fit, and
    neighbours share whole pieces of up to overlap characters."""

    def joined(pieces: list[str]) -> list[str]:
        out, now, size = [], [], 0
        for p in pieces:
            if now and size + len(p) > limit:
                out.append("".join(now).strip())
                while now and (size > overlap or size + len(p) > limit):
                    size -= len(now.pop(0))
            now.append(p)
            size += len(p)
        return [x for x in [*out, "".join(now).strip()] if x]

    def cut(t: str, level: int) -> list[str]:
        while SEPARATORS[level] and not re.search(SEPARATORS[level], t):
            level += 1
        sep = SEPARATORS[level]
        at = [m.start() for m in re.finditer(sep, t)] if sep else range(1, len(t))
        bounds = [0, *at, len(t)]
        out, short = [], []
        for piece in (t[i:j] for i, j in zip(bounds, bounds[1:], strict=False) if i < j):
            if len(piece) < limit or not sep:
                short.append(piece)
                continue
            out += joined(short) + cut(piece, level + 1)
            short = []
        return out + joined(short)

    return cut(text, 0) if text else []


def split_chunks(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, chunk). The cuts depend on each other, hence a pandas function."""

    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t or "", limit, overlap))

    small_batches(docs.sparkSession)
    pieces = F.pandas_udf(cut, ArrayType(StringType()))
    return docs.select("id", F.posexplode(pieces("text")).alias("part", "chunk"))


def heading_chunks(bodies: DataFrame) -> DataFrame:
    """bodies (..., heading, body) with part, parts and chunk: each part of the body below
    the heading, which together fit the limit; a body that fits is one part, an empty one
    the heading alone."""

    def cut(b: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for body, heading in zip(b.fillna("").str.strip(), h.fillna(""), strict=True):
            limit = max(LEAST, LIMIT - len(heading) - 2)
            parts = [body] if len(body) <= limit else split_text(body, limit, min(OVERLAP, limit - 1))
            out.append([f"{heading}\n\n{p}".strip() for p in parts])
        return pd.Series(out)

    small_batches(bodies.sparkSession)
    pieces = F.pandas_udf(cut, ArrayType(StringType()))("body", "heading")
    own = [c for c in bodies.columns if c not in ("heading", "body")]
    return bodies.withColumn("_parts", pieces).select(*own, F.size("_parts").alias("parts"), F.posexplode("_parts").alias("part", "chunk")).withColumn("part", F.col("part") + 1)


def provision_chunks(provisions: DataFrame) -> DataFrame:
    """(id, path, part, parts, chunk): chunks of each provision (id, short, kind, number,
    title, body), and of each of its child components below a heading of its own. A lone
    subsection adds nothing to its parent."""
    head = lambda path: context_heading(F.col("short"), F.col("kind"), F.col("number"), F.col("title"), path)
    none = F.array().cast("array<string>")
    parents = provisions.select("id", F.lit("").alias("path"), head(none).alias("heading"), "body")
    # Lines from one marker to the next are a component's.
    lines = provisions.select(F.col("id").alias("doc"), F.posexplode(F.split(F.trim("body"), "\n")).alias("pos", "line"))
    found = child_components(lines).select("doc", "pos", "path", "key")
    order = W.partitionBy("doc").orderBy("pos")
    marked = lines.withColumn("marker", F.col("line").rlike(CHILD_MARKER)).withColumn("start", F.max(F.when(F.col("marker"), F.col("pos"))).over(order)).where("start IS NOT NULL")
    texts = marked.groupBy("doc", F.col("start").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda v: v["line"]), "\n").alias("text"))
    kids = found.join(texts, ["doc", "pos"])
    several = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path")).alias("deep")).where("n > 1 OR deep > 1").select("doc")
    kids = kids.join(several, "doc", "left_semi").withColumnRenamed("doc", "id").join(provisions.drop("body"), "id")
    children = kids.select("id", F.concat(F.col("key"), F.lit("@"), F.col("pos")).alias("path"), head(F.col("path")).alias("heading"), F.trim(F.regexp_replace("text", CHILD_MARKER, "")).alias("body"))
    return heading_chunks(parents.unionByName(children))


def provision_body(kind: Column, number: Column, title: Column, text: Column, heading_only: Column, body_present: Column) -> Column:
    """Whether a provision's text has a body of at least 80 characters besides its heading,
    on pages that have one."""
    t = F.trim(text)
    forms = [F.concat(number, F.lit(". "), title), F.concat(F.initcap(kind), F.lit(" "), number, F.lit(". "), title), F.concat(F.initcap(kind), F.lit(" "), number, F.lit(": "), title)]
    rest = t
    for f in reversed(forms):
        rest = F.when(F.startswith(F.lower(t), F.lower(f)), F.substring(t, F.length(f) + 1, F.length(t))).otherwise(rest)
    n = F.length(F.trim(F.regexp_replace(F.regexp_replace(rest, r"^[ :.—–\n]+", ""), r"\s+", " ")))
    return (n >= 80) & ~F.coalesce(heading_only, F.lit(False)) & F.coalesce(body_present, F.lit(True))


# Lines that begin a part of a document.
BOUNDARIES = [
    r"(?i)^\s*CHAPTER\s+([IVXLCDM]+|\d+)\s*$", r"(?i)^\s*PART\s+([IVXLCDM]+|\d+)\s*$",
    r"(?i)^\s*(?:THE\s+)?(?:FIRST\s+|SECOND\s+|THIRD\s+|FOURTH\s+|FIFTH\s+|SIXTH\s+|SEVENTH\s+|EIGHTH\s+)?SCHEDULE\b[^\n]*$", r"(?i)^\s*PREAMBLE\s*$",
    r"^\s*(OF\s+[A-Z][A-Z\s,.'()\-]+)\s*$", r"^\s*(Of\s+[A-Z][A-Za-z\s,.'()\-]+)\s*$",
]
ROMAN = r"^\s*([IVXLCDM]+)\s*$"


def structural_boundaries(lines: DataFrame) -> DataFrame:
    """(doc, pos): lines that begin a chapter, part, schedule, preamble or subject, and lone
    Roman numerals whose next line that isn't blank is a subject."""
    c = F.col("line")
    plain = c.rlike(BOUNDARIES[0])
    for p in BOUNDARIES[1:]:
        plain = plain | c.rlike(p)
    after = W.partitionBy("doc").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    following = F.first(F.when(F.trim("line") != "", F.trim("line")), ignorenulls=True).over(after)
    subject = F.coalesce(F.col("next").rlike(BOUNDARIES[4]) | F.col("next").rlike(BOUNDARIES[5]), F.lit(False))
    return lines.withColumn("next", following).where(plain | (c.rlike(ROMAN) & subject)).select("doc", "pos")


def window_chunks(docs: DataFrame, size: int = 1000, step: int = 850) -> DataFrame:
    """(id, part, chunk): windows of a fixed width."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - (size - step)) / step)).cast("int")
    x = docs.select("id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return x.select("id", "part", F.substring(F.col("text"), F.col("part") * step + 1, F.lit(size)).alias("chunk"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Numbers over all documents and within each, by its pos, and the chunk's name."""
    x = ordered.ranged(chunks.withColumn("_all", F.lit(0)), "document", "pos")
    x = ordered.places(x, ["document"], ["pos"], "document_chunk_number").withColumn("document_chunk_number", F.col("document_chunk_number").cast("int"))
    x = ordered.places(x, ["_all"], ["document", "pos"], "chunk_number").drop("_all", "_range")
    return x.withColumn("chunk_id", F.concat_ws("::", "document", "kind", F.coalesce("number", F.lit("unsectioned")), F.concat(F.lit("chunk-"), "document_chunk_number")))


def provision_sequence(chunks: DataFrame) -> DataFrame:
    """(document, kind, number, ordinal, previous, next): provisions in the order of their
    first appearance, per document and kind."""
    first = chunks.where("number IS NOT NULL").groupBy("document", "kind", "number").agg(F.min("pos").alias("pos"))
    key, order = ["document", "kind"], ["pos", "number"]
    x = ordered.places(ordered.ranged(first, *key, *order), key, order, "ordinal")
    x = ordered.carried(ordered.carried(x, key, order, {"previous": "number"}), key, order, {"next": "number"}, ahead=True)
    return x.select(*key, "number", F.col("ordinal").cast("int").alias("ordinal"), "previous", "next")


# ---- audit ------------------------------------------------------------------------


def sequence_issues(seq: DataFrame) -> DataFrame:
    """(document, kind, field) broken by stored ordinals and links: one ordinal a provision,
    1..n without gaps, links to the neighbours."""
    key, order = ["document", "kind"], ["ordinal", "number"]
    x = ordered.places(ordered.ranged(seq, *key, *order), key, order, "want")
    x = ordered.carried(ordered.carried(x, key, order, {"p": "number"}), key, order, {"n": "number"}, ahead=True)
    bad = F.filter(F.array(F.when(F.col("ordinal") != F.col("want"), F.lit("ordinal")), F.when(~F.col("previous").eqNullSafe(F.col("p")), F.lit("previous")), F.when(~F.col("next").eqNullSafe(F.col("n")), F.lit("next"))), lambda v: v.isNotNull())
    return x.select("document", "kind", "number", F.explode(bad).alias("field"))
