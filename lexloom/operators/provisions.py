"""Provisions of documents: from pages over lines to blocks, chunks and their metadata.

Lines are dealt to ranges of (document, page, position), and what a line needs of others
(the line below, the provision and the part it stands in) is carried along that order, so
documents of any size are worked on by many tasks. Only the lines of one provision on
one side, and of one page on the other, are ever gathered in a row.

Defined cases: null texts are empty pages; pages without a document or number are left
out; text before a document's first provision, or all of it where there is none, forms
unsectioned blocks, one a page; text between a heading of a chapter or part and the next
provision belongs to none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import ordered
from lexloom.operators import structure as S
from lexloom.plans import dims
from lexloom.sources.tables import materialized

ORDER = ["page", "pos"]
_PLACE = "struct<page: bigint, pos: int>"


def title_flags(line: Column) -> Column:
    """What a line below a heading does for its title: b blank, s ends it before, e is its
    last part, c a part."""
    x = T.stripped(line)
    like = lambda p: x.rlike("(?i)" + p)
    stop = like("^" + dims.BODY_START) | like(dims.PROVISION) | like(r"^\s*\((?:\d+|[a-z]|[ivxlcdm]+)\)\s+") | like(r"^\s*Explanation(?:\s+\d+)?\s*[:.\-—–]?") | like(r"^\s*Illustrations?\s*[:.\-—–]?\s*$")
    for p in (b for b in S.BOUNDARIES if "PREAMBLE" not in b):
        stop = stop | x.rlike(p)
    return F.when(x == "", "b").when(stop | (F.length(x) > dims.LONGEST_TITLE_LINE), "s").when(x.rlike("[.:]$"), "e").otherwise("c")


#: Of a string of flags the part that belongs to the title.
TITLE_PART = "^(?:b*c)*(?:b*e)?"


def cut_title(parts: Column) -> Column:
    return F.substring(T.stripped(F.regexp_replace(F.array_join(parts, " "), r"[ :.]+$", "")), 1, dims.LONGEST_TITLE)


def inline_body(title: Column) -> Column:
    """(title, body) of a heading's title, body empty if none begins in its line."""
    g = lambda i: F.regexp_extract(title, "(?i)" + dims.INLINE_BODY, i)
    return F.struct(F.when(g(2) != "", F.regexp_replace(T.stripped(g(1)), r"[ :.—–]+$", "")).otherwise(title).alias("title"), T.stripped(g(2)).alias("body"))


def valid_candidate(label: Column, number: Column, title: Column, kind: Column) -> Column:
    """Whether a line of a provision's form opens one of the kind."""
    year = number.rlike(r"^\d{4}$") & number.try_cast("int").between(1800, 2100)
    form = F.when(kind == "article", number.rlike(r"^\d+[A-Z]{0,3}$")).otherwise(number.rlike(r"^\d+[A-Z]{0,2}$"))
    bad = F.lit(False)
    for p in dims.NO_TITLES:
        bad = bad | title.rlike(T.uni("(?i)^" + p))
    return F.coalesce(((label == "") | (F.lower(label) == kind)) & form & ~year & ~bad & F.length(title).between(2, 600), F.lit(False))


def page_lines(pages: DataFrame) -> DataFrame:
    """(document, page, pos, line, _range, below): the lines of pages (document, page, text), a
    blank one after each page, and the next line below with something in it."""
    x = pages.where("document IS NOT NULL AND page IS NOT NULL").select("document", F.col("page").cast("long").alias("page"), F.posexplode(F.concat(F.split(T.stripped(F.coalesce("text", F.lit(""))), "\n"), F.array(F.lit("")))).alias("pos", "line"))
    x = ordered.ranged(x, "document", *ORDER).withColumn("full", F.nullif(T.stripped(F.col("line")), F.lit("")))
    return ordered.carried(x, ["document"], ORDER, {"below": "full"}, ahead=True).drop("full")


def marked_lines(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """lines with candidate (place, number, title and whether the title stands below its
    number) and boundary, both null elsewhere. A number alone takes the line below as its
    title unless that opens a provision too. kinds: (document, kind), one row a document."""
    lone = "(?i)" + dims.PROVISION.replace(r"([^\n]+)", r"\s*$")
    alone = F.col("line").rlike(lone) & ~F.coalesce(F.col("below").rlike(lone) | F.col("below").rlike("(?i)" + dims.PROVISION), F.lit(False))
    text = F.when(alone, F.concat("line", F.coalesce("below", F.lit("")))).otherwise(F.col("line"))
    g = lambda i: F.regexp_extract("_own", "(?i)" + dims.PROVISION, i)
    x = lines.join(kinds, "document").withColumn("_own", text)
    x = x.withColumn("_c", F.struct(g(1).alias("label"), T.canonical_number(g(2)).alias("number"), T.stripped(g(3)).alias("title"), alone.alias("alone")))
    good = valid_candidate(F.col("_c.label"), F.col("_c.number"), F.col("_c.title"), F.col("kind"))
    c = F.col("line")
    plain = F.lit(False)
    for p in S.BOUNDARIES:
        plain = plain | c.rlike(p)
    subject = F.coalesce(F.col("below").rlike(S.BOUNDARIES[4]) | F.col("below").rlike(S.BOUNDARIES[5]), F.lit(False))
    at = F.struct("page", "pos").cast(_PLACE)
    own = F.struct(at.alias("at"), "_c.number", "_c.title", "_c.alone")
    return x.withColumn("candidate", F.when(good, own)).withColumn("boundary", F.when(plain | (c.rlike(S.ROMAN) & subject), at)).drop("_own", "_c", "below")


def provision_blocks(pages: DataFrame, kinds: DataFrame) -> DataFrame:
    """(document, kind, start, number, title, text, pages, unsectioned): a row for each
    provision of pages (document, page, text), and for each page of unsectioned text. start is
    the place of its first line, pages the sorted pages that it stands on."""
    # Written, as all that is carried and both kinds of blocks read it: forms are told once.
    x = materialized(marked_lines(page_lines(pages), kinds), "marked")
    x = ordered.carried(x, ["document"], ORDER, {"block": "candidate", "last": "boundary"}, own=True)
    row = F.struct("page", "pos", "line")
    free = x.where("block IS NULL").groupBy("document", "kind", "page").agg(F.array_sort(F.collect_list(row)).alias("ls"))
    free = free.select(
        "document", "kind", F.struct("page", F.lit(0).alias("pos")).cast(_PLACE).alias("start"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"),
        T.stripped(F.array_join(F.transform("ls", lambda v: v["line"]), "\n")).alias("text"), F.array("page").alias("pages"), F.lit(True).alias("unsectioned"),
    ).where("text <> ''")
    inside = x.where("block IS NOT NULL AND (last IS NULL OR last <= block.at)")
    own = inside.groupBy("document", "kind", "block.at").agg(F.first("block").alias("b"), F.array_sort(F.collect_list(row)).alias("ls"))
    own = own.withColumn("inline", inline_body(F.col("b.title"))).withColumn("all", F.transform("ls", lambda v: v["line"]))
    # Lines below the heading; its title's line isn't one of them.
    rest = F.slice("all", 2, F.greatest(F.lit(1), F.size("all")))
    first = F.array_position(F.transform("rest", lambda v: T.stripped(v) != ""), True).cast("int")
    own = own.withColumn("rest", rest).withColumn("rest", F.when(F.col("b.alone"), F.slice("rest", first + 1, F.greatest(F.lit(1), F.size("rest")))).otherwise(F.col("rest")))
    closed = (F.col("inline.body") != "") | F.col("b.title").rlike("[.:]$")
    flags = F.array_join(F.transform("rest", title_flags), "")
    own = own.withColumn("n", F.when(closed, 0).otherwise(F.length(F.regexp_extract(flags, TITLE_PART, 0))))
    more = F.filter(F.transform(F.slice("rest", F.lit(1), F.col("n")), T.stripped), lambda v: v != "")
    own = own.withColumn("more", more).withColumn("title", F.when(F.col("inline.body") != "", F.substring("inline.title", 1, dims.LONGEST_TITLE)).otherwise(cut_title(F.concat(F.array("b.title"), "more"))))
    left = T.stripped(F.array_join(F.slice("rest", F.col("n") + 1, F.greatest(F.lit(1), F.size("rest"))), "\n"))
    head = F.concat("b.number", F.lit(". "), "title")
    text = (
        F.when(F.col("inline.body") != "", T.stripped(F.concat(head, F.lit("\n\n"), "inline.body", F.lit("\n"), F.array_join("rest", "\n"))))
        .when(F.size("more") > 0, T.stripped(F.concat(head, F.lit("\n\n"), left))).otherwise(T.stripped(F.array_join("all", "\n")))
    )
    own = own.select("document", "kind", F.col("at").alias("start"), F.col("b.number").alias("number"), "title", text.alias("text"), F.array_distinct(F.transform("ls", lambda v: v["page"])).alias("pages"), F.lit(False).alias("unsectioned"))
    return own.unionByName(free)


#: What a block takes over from its pages: the first value that isn't null.
INHERITED = ["chapter_number", "chapter_title", "part", "legal_topic"]
#: What of a page's findings is read here.
FOUND = [*INHERITED, "heading_only_page", "section_body_present"]


def with_page_metadata(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """blocks with the metadata of their pages: of each field the first page's value that
    isn't null, and whether headings are all that the first page holds. found: (document,
    page, found) as cleaning gives it, one row a page."""
    f = found.select("document", F.col("page").cast("long").alias("page"), *[F.col(f"found.{c}").alias(c) for c in INHERITED], F.col("found.heading_only_page").alias("bare"), F.col("found.section_body_present").alias("bodied"))
    each = blocks.select("document", "start", F.explode("pages").alias("page")).join(f, ["document", "page"])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c)
    return blocks.join(each.groupBy("document", "start").agg(*[first(c) for c in [*INHERITED, "bare", "bodied"]]), ["document", "start"], "left")


def without_heading(text: Column, number: Column) -> Column:
    """A block's text without the line of its number, before its heading is put there anew."""
    line = F.concat(F.lit(r"(?is)^\s*(?:(?:section|article)\s+)?\Q"), number, F.lit(r"\E\s*(?:\.\s*|[—–:-]\s*)[^\n]*(?:\n+|$)"))
    return T.stripped(F.when(number.isNull(), text).otherwise(F.regexp_replace(text, line, F.lit(""))))


def chunk_metadata(blocks: DataFrame, names: DataFrame) -> DataFrame:
    """blocks with the columns that chunks of a provision share: its identity, mirrors by
    kind, pages, whether it has a body, its place among the document's provisions and its
    neighbours there. names: (document, document_name, document_title, document_short_name,
    document_type)."""
    c, none = F.col, F.lit(None).cast("string")
    x = blocks.withColumn("identity", F.concat_ws("::", "document", "kind", F.coalesce("number", F.lit("unsectioned"))))
    body = S.provision_body(c("kind"), c("number"), c("title"), c("text"), c("bare"), c("bodied"))
    x = x.withColumn("body_present", F.when(c("unsectioned"), True).otherwise(F.coalesce(body, F.lit(True))))
    seq = S.provision_sequence(x.where("number IS NOT NULL").select("document", "kind", "number", F.col("start").alias("pos")))
    x = x.join(seq, ["document", "kind", "number"], "left").join(names, "document")
    mirror = lambda kind, v: F.when((c("kind") == kind) & c("number").isNotNull(), c(v)).otherwise(none)
    link = lambda v: F.when(c(v).isNotNull(), F.concat_ws("::", "document", "kind", v))
    topic = F.when(c("number").isNotNull() & (F.coalesce("title", F.lit("")) != ""), F.lower("title")).otherwise(c("legal_topic"))
    return x.withColumns({
        "document_id": c("document"), "provision_type": c("kind"), "provision_number": c("number"), "base_provision_number": c("number"), "provision_title": c("title"), "provision_identity": c("identity"),
        "section_number": mirror("section", "number"), "section_identity": mirror("section", "identity"), "article_number": mirror("article", "number"), "article_identity": mirror("article", "identity"),
        "page_start": F.array_min("pages"), "page_end": F.array_max("pages"), "page_number": F.array_min("pages"), "source_pages": F.array_sort("pages"), "spans_multiple_pages": F.size("pages") > 1,
        "heading_only_chunk": ~c("body_present"), "provision_body_present": c("body_present"), "is_unsectioned_chunk": c("unsectioned"), "legal_topic": topic,
        "provision_ordinal": c("ordinal").cast("long"), "previous_provision_number": c("previous"), "next_provision_number": c("next"),
        "previous_provision_identity": link("previous"), "next_provision_identity": link("next"),
    })


def legal_chunks(pages: DataFrame, found: DataFrame, kinds: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks of all provisions and of their child components, with the metadata that the
    audit checks, the text (chunk) and the document's own order (document_chunk_number)."""
    blocks = materialized(with_page_metadata(provision_blocks(pages, kinds), found), "blocks")
    meta = chunk_metadata(blocks, names)
    unit = F.concat_ws("/", "document", F.col("start.page"), F.col("start.pos"))
    bodies = meta.withColumn("id", unit).select("id", F.col("document_short_name").alias("short"), "kind", "number", "title", without_heading(F.col("text"), F.col("number")).alias("body"), "unsectioned")
    own = S.provision_chunks(bodies.where("NOT unsectioned").drop("unsectioned"))
    loose = S.heading_chunks(bodies.where("unsectioned").select("id", F.lit("").alias("path"), F.col("short").alias("heading"), "body"))
    parts = own.unionByName(loose).withColumn("provision_part_number", F.col("part").cast("long")).withColumn("provision_part_count", F.col("parts").cast("long")).drop("part", "parts")
    # A child's name is its path and the line of its marker, which tells equal paths apart.
    key = F.split_part("path", F.lit("@"), F.lit(1))
    path = F.when(key != "", F.split(key, r"\."))
    depth = F.size("subsection_path")
    x = parts.withColumn("line", F.coalesce(F.split_part("path", F.lit("@"), F.lit(2)).try_cast("int"), F.lit(-1))).withColumn("subsection_path", path)
    x = x.join(meta.withColumn("id", unit).drop("text"), "id").withColumns({
        "subsection_path_key": F.array_join("subsection_path", "."), "component_type": F.when(depth == 1, "subsection").when(depth == 2, "clause").when(depth > 2, "paragraph"),
        "component_label": F.concat(F.lit("("), F.element_at("subsection_path", -1), F.lit(")")),
        "_page": F.col("start.page"), "_pos": F.col("start.pos"),
    })
    order = ["_page", "_pos", "line", "provision_part_number"]
    x = ordered.ranged(x.drop("start", "path"), "document", *order)
    x = ordered.places(x, ["document"], order, "document_chunk_number")
    every = ordered.places(x.withColumn("_all", F.lit(0)), ["_all"], ["document", *order], "chunk_number")
    number = F.coalesce("number", F.lit("unsectioned"))
    named = F.concat(F.concat_ws("::", "document", "kind", number), F.lit("::part-"), "provision_part_number", F.lit("::chunk-"), "document_chunk_number")
    return every.withColumn("chunk_id", named).drop("_range", "_all", "_page", "_pos", "line", "id", "document", "kind", "number", "title", "identity", "unsectioned", "body_present", "bare", "bodied", "ordinal", "previous", "next", "pages")
