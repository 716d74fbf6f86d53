"""Text expressions: Column -> Column, all inside the engine."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.plans import dims


def normalize(c: Column) -> Column:
    """Lower case, long dashes as hyphens, other marks as single spaces."""
    x = F.translate(F.lower(c), "–—", "--")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\-\s]", " "), r"\s+", " "))


#: Tokens of two characters or more, which need no normalizing of what stands between them.
TOKEN = "[a-z0-9]{2,}(?:-[a-z0-9]+)?|[a-z0-9]-[a-z0-9]+"


def tokens(c: Column) -> Column:
    """Distinct meaningful tokens, in order of appearance."""
    found = F.regexp_extract_all(F.translate(F.lower(c), "–—", "--"), F.lit(TOKEN), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in dims.STOP_WORDS]))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether a normalized phrase stands in a normalized text, at no letter or digit."""
    edge = r"(?<![a-z0-9])"
    return text.contains(phrase) & F.regexp_like(text, F.concat(F.lit(edge + r"\Q"), phrase, F.lit(r"\E(?![a-z0-9])")))


def canonical_number(c: Column) -> Column:
    """Base number of a provision, with its suffix in upper case; null if it is none."""
    prefix = rf"(?:{dims.SECTION_PREFIX}|{dims.ARTICLE_PREFIX})"
    pattern = rf"(?i)^\s*(?:{prefix}\s*)?(\d+)(?:\s*-\s*([a-z]{{1,3}})|([a-z]{{1,3}}))?(?:\s*\(\s*[a-z0-9]+\s*\))*\s*[.,;:]*\s*$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(part(1) != "", F.concat(part(1), F.upper(F.concat(part(2), part(3)))))


def citations(c: Column, prefix: str) -> Column:
    """Canonical numbers cited with a prefix, distinct, in order."""
    n = dims.PROVISION_NUMBER
    groups = F.regexp_extract_all(c, F.lit(rf"(?i)\b{prefix}\s*({n}(?:\s*(?:,|and|or)\s*{n})*)"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(f"(?i){n}"), F.lit(0))))
    return F.array_distinct(F.filter(F.transform(numbers, canonical_number), lambda x: x.isNotNull()))


def distinct_strings(c: Column) -> Column:
    """Trimmed, non-empty, first of each."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def uni(pattern: str) -> str:
    """The pattern with classes and boundaries of all scripts, not of ASCII alone."""
    return "(?U)" + pattern


#: White space of all scripts, as \s has it in uni().
SPACES = "\t\n\x0b\x0c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: How lines end, as in text files of any origin.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
#: Characters that compatibility normalization keeps wherever they stand, as a class's inside.
STABLE = r"\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u2010\u2012-\u2016\u2018-\u2023\u20AC"
INVISIBLE = r"\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _maybe(inside: str) -> str:
    """A class of the characters of another one up to U+00FF and of all beyond: what is tested
    first, as Java looks up single characters in a table, but tries ranges and kinds of
    characters one after the other."""
    return "[^" + "".join(rf"\x{i:02x}" for i in range(256) if not re.match(f"[{inside}]", chr(i))) + "]"


def _outside(inside: str) -> str:
    """A pattern of a character outside a class."""
    return f"{_maybe('^' + inside)}(?<![{inside}])"


#: In texts without the first, normalization changes nothing; in those without the second, nor
#: does clean_whitespace(), and lines end in LF alone.
UNSTABLE, ODD = _outside(STABLE), _outside(r"\t\n -~" + STABLE.removeprefix(r"\x00-\x9F").replace(r"\u00AB-\u00AE", r"\u00AB\u00AC\u00AE"))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACES))


def split_lines(c: Column) -> Column:
    """The lines of a text; by plain search where they end in LF alone."""
    return F.when(c.rlike(ODD), F.split(c, LINE_END)).otherwise(F.split(c, "\n"))


def clean_whitespace(c: Column) -> Column:
    """Invisible characters out, hard spaces to spaces, line ends to LF."""
    x = F.regexp_replace(c, f"[{INVISIBLE}]", "")
    return F.regexp_replace(F.translate(x, "\u00a0", " "), "\r\n?", "\n")


def single_spaced(c: Column) -> Column:
    """Each run of spaces and tabs as one space."""
    return F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, r"[ \t]{2,}|\t", " ")).otherwise(c)


def substituted(c: Column, steps: list[tuple[str, str]]) -> Column:
    """c after substitutions in order; \\1 stands for a group."""
    return reduce(lambda x, s: F.regexp_replace(x, uni(s[0]), s[1].replace("\\", "$")), steps, c)


def once(c: Column, f) -> Column:
    """f(c), with c evaluated once however often f reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def counted(c: Column, steps: list[tuple[str, str]]) -> Column:
    """(t, n): the same, and how many places were substituted."""
    out = F.struct(c.alias("t"), F.lit(0).cast("long").alias("n"))
    for pattern, new in steps:
        out = _step(out, F.lit(uni(pattern)), F.lit(new.replace("\\", "$")))
    return out


def _step(out: Column, p: Column, r: Column) -> Column:
    def run(a: Column) -> Column:
        return F.when(F.regexp_like(a["t"], p), F.struct(F.regexp_replace(a["t"], p, r).alias("t"), (a["n"] + F.regexp_count(a["t"], p)).alias("n"))).otherwise(a)

    return once(out, run)


def split_words_counted(c: Column) -> Column:
    """counted() for words that a line end splits, each after a hyphen."""
    none = F.struct(c.alias("t"), F.lit(0).cast("long").alias("n"))
    return F.when(c.contains("-") & c.rlike(uni(r"-\s*\n")), counted(c, dims.SPLIT_WORDS)).otherwise(none)


#: The space and letters, most frequent ones of prose first.
FREQUENT = " etaoinshrdlucmfwygpbvkxjqz"


def rare_part(word: str) -> str:
    """The rest of a lower-case word from its rarest letter on, four characters at least. Plain
    search compares wherever the first letter stands, so that this is looked for before the word."""
    rank = lambda i: FREQUENT.find(word[i]) % len(FREQUENT)
    return word[max(range(max(1, len(word) - 3)), key=rank) :]


#: A capital of ASCII or a digit, after a letter of ASCII; two digits after one.
CAPITAL_OR_DIGIT, DIGITS = _maybe("A-Z0-9") + "(?<=[A-Za-z].)", _maybe("0-9") + uni(r"\d(?<=[A-Za-z]\d\d)")
#: Listed joined words with a space, which alone can come about where white space changes.
SPACED_REPAIRS = {w: r for w, r in dims.OCR_REPAIRS.items() if re.search(r"\s", w)}


def repairs_counted(c: Column, repairs: dict[str, str] = dims.OCR_REPAIRS) -> Column:
    """counted() for listed joined words. Those that stand in the text are told by plain search;
    a repair puts a space in a word or changes a letter, after which no other one of the list
    stands there."""
    words = F.array(*[F.struct(F.lit(rare_part(w.lower())).alias("part"), F.lit(w.lower()).alias("w"), F.lit("(?i)" + re.escape(w)).alias("p"), F.lit(r).alias("r"), F.lit(len(r) - len(w)).alias("d")) for w, r in repairs.items()])
    start = F.struct(c.alias("t"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, s: Column) -> Column:
        n = lambda new: F.when(s["d"] == 1, F.length(new) - F.length(a["t"])).otherwise(F.regexp_count(a["t"], s["p"]))
        return once(F.regexp_replace(a["t"], s["p"], s["r"]), lambda new: F.struct(new.alias("t"), (a["n"] + n(new)).cast("long").alias("n")))

    found = once(F.lower(c), lambda low: F.filter(words, lambda s: F.contains(low, s["part"]) & F.contains(low, s["w"])))
    return once(found, lambda own: F.when(F.size(own) > 0, F.aggregate(own, start, step)).otherwise(start))


def ocr_counted(c: Column) -> Column:
    """counted() for joined words, the listed ones, then those of the patterns, each of which
    adds one character a place. some: whether there are places for the first or third pattern,
    which need a capital or a digit after a letter. If there are none, and no two letters or
    digits come together anew, a second round finds SPACED_REPAIRS at most."""
    first, second, third = dims.JOINED_WORDS

    def patterns(v: Column) -> Column:
        some = v["t"].rlike(CAPITAL_OR_DIGIT)
        t = F.when(some, substituted(v["t"], [first, second, third])).otherwise(substituted(v["t"], [second]))
        return once(t, lambda t: F.struct(t.alias("t"), (v["n"] + F.length(t) - F.length(v["t"])).cast("long").alias("n"), some.alias("some")))

    return once(repairs_counted(c), patterns)


def dehyphenate(c: Column) -> Column:
    """Words and numbers that a line end has split."""
    return substituted(c, dims.SPLIT_WORDS)


#: Joined words: the listed ones, then those of the patterns.
OCR_STEPS = [(r"(?i)" + re.escape(wrong), right) for wrong, right in dims.OCR_REPAIRS.items()] + dims.JOINED_WORDS


def ocr_repair(c: Column) -> Column:
    return substituted(c, OCR_STEPS)


def strip_citation_marks(c: Column) -> Column:
    """Amendment marks within a line, in order; text they enclose stays. All but the last two
    forms hold a bracket; these hold white space after a digit or other white space."""
    marked = F.when(c.contains("[") | c.contains("]"), substituted(c, dims.CITATION_MARKS))
    return stripped(marked.when(c.rlike(_maybe(r"\d\s\x85") + _maybe(r"\s\x85")), substituted(c, dims.CITATION_MARKS[-2:])).otherwise(c))


def punct_spacing(c: Column) -> Column:
    """Spacing of marks, in order, each step where a text holds what it needs."""
    mark = "[,.;:?!]"
    needs = [
        (2, lambda t: t.rlike(uni(rf"{mark}(?:[A-Za-z]|(?<=\s{mark}))"))), (1, lambda t: t.contains("(")), (1, lambda t: t.contains(")")), (1, lambda t: t.rlike(DIGITS)),
        (1, lambda t: t.contains("  ") | t.contains("\t")), (1, lambda t: t.contains("\n\n\n")),
    ]
    out, at = c, 0
    for n, need in needs:
        out = once(out, _where(need, dims.SPACING[at : at + n]))
        at += n
    return stripped(out)


def _where(need, steps: list[tuple[str, str]]):
    return lambda t: F.when(need(t), substituted(t, steps)).otherwise(t)


def is_artifact(line: Column) -> Column:
    """Whole lines that are headers, footers or isolated marks."""
    return is_header(line) | is_footer(line) | is_mark(line)


def is_header(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(uni(f"(?i)^(?:{p})$")) for p in dims.HEADER_PATTERNS])


def is_footer(line: Column) -> Column:
    return line.rlike(uni(f"(?i)^(?:{dims.FOOTER_PATTERN})$"))


def is_mark(line: Column) -> Column:
    # One start for all: a pattern that may begin anywhere is tried at each character.
    return line.rlike(uni("^(?:" + "|".join(f"(?:{p})" for p in dims.ARTIFACT_PATTERNS) + ")$"))


def token_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s]+"))


def deterministic_id(*fields: Column) -> Column:
    """uuid5 in the URL namespace of the SHA-256 of the fields, joined by bars."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(digest, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
