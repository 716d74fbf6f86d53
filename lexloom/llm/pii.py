"""Personal data: proposed spans, boosted trees, calibrated thresholds.

For each kind, patterns propose spans in whole texts: the base pattern, whose spans stay
whenever they pass the kind's format test, and a wider one, whose spans may overlap
them. Secrets (keys and tokens) have a wider pattern only: what becomes a span of theirs
is the trees' decision alone. Boosted trees score every proposal by its format and by the words around it; a
proposal that the format test alone doesn't accept becomes a span if its calibrated
probability reaches the threshold of its kind.

Everything on the data is a DataFrame expression. A proposal's features are a few small
integers, so the training set is a table of distinct feature rows with counts, whose
size is bounded by the number of combinations (CELLS), whatever the input; the trees are
fitted on that table. Its labels are weak, since no spans are labelled: a proposal is
positive if it passes its kind's format test, a stricter one (a top-level domain of
letters, no leading zeros, an issuer's digit, a country code; digits and letters mixed
without words or paths) and doesn't stand behind a word for other numbers (order, version,
invoice, commit, checksum: the hard negatives). The features leave
these tests out but for the word before, so that the trees learn what surrounds personal
data and what it looks like.

A fourth of the documents, by a hash of the text, is held out from the trees. There the
scores are calibrated, and each kind gets the lowest threshold at which its proposals
that aren't base spans anyway are right in PRECISION of the cases; a kind that reaches
it nowhere, or has no such proposal there, adds no spans.

Patterns use possessive loops and start at the edges of a run, so a text without a match
costs time in proportion to its length.

Defined cases: a null or empty text has no spans; positions are code points, ends
exclusive; repeated rows get the same spans; an empty table gives an empty table, and
with no proposal to learn from only base spans are returned; other columns pass through,
and one named like an output column gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import column_of, documents

#: The base kinds, and one that only the method finds: keys and tokens that open accounts.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]

#: What the base spans of each kind look like; what makes a text worth searching.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched for a kind at all.
NEED = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9]\x20?\.\x20?[0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){11}", "phone": r"(?:\+|00|\()[0-9]", "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20}"}
#: Wider proposals: spelled-out addresses, bracketed or short addresses, card-like and
#: phone-like digit groups.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?\[at\]\x20?|\x20\(at\)\x20|@)[A-Za-z0-9-]++(?:(?:\.|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?\.\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[\x20.-]?[0-9]{4}+){2}+[\x20.-]?[0-9]{1,7}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00|\()[0-9][\x20()./0-9-]{6,22}+",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{20,}+={0,2}+",
}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|from|to|cc)\W{0,3}$",
    "ip": r"(?i)(?:ip|host|server|address|addr|from)\W{0,3}$",
    "card": r"(?i)(?:card|visa|credit|payment|pan|cc)\W{0,3}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|whatsapp)\W{0,3}$",
    "secret": r"(?i)(?:token|secret|key|password|passwd|pwd|bearer|auth|credential)s?\W{0,5}$",
}
#: Words before a span that speak for another kind of number.
OTHER = r"(?i)(?:order|invoice|version|release|ver|isbn|serial|tracking|ref|part|build|section|item|nr|no|commit|sha|sha1|sha256|md5|hash|checksum|digest|etag|uuid|guid)\W{0,4}$"
#: What positive labels look like beyond the format test.
STRICT = {"email": r"^[^.].*\.[A-Za-z]{2,24}$", "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$", "card": "^[2-6]", "phone": r"^[^0-9]*(?:00)?[1-9]", "secret": r"^(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^A-Za-z]*+[A-Za-z]){3})(?!.*[a-z]{9})(?!.*[/+-].*[/+-].*[/+-])"}
SIDE = 16
#: Share of a kind's added spans that must be right in the held-out documents.
PRECISION = 0.9
#: One document in so many is held out.
FOLDS = 4
ROUNDS, RATE = 40, 0.3
#: Levels of each feature, in order; their product bounds the training table.
LEVELS = {"kind": 5, "wide": 2, "size": 4, "digits": 4, "groups": 4, "context": 3, "before": 3, "after": 3}
CELLS = math.prod(LEVELS.values())


#: Matches whose places are added up together: keeps long lists of matches linear.
_BLOCK = 256
_SPAN = "array<struct<s:int,e:int,v:string,b:string,a:string>>"


def _with_matches(df: DataFrame, name: str, text: str, pattern: str, guard: str) -> DataFrame:
    """df with ``name``: matches of the pattern with their places and what stands before
    and after them, (s, e, v, b, a). The pieces between matches tell all this; places are
    summed within blocks, then blocks are moved by what lies before them."""
    t = F.col(text)
    df = df.withColumn("_lexloom_matches", F.when(F.col(guard), F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))))
    df = df.withColumn("_lexloom_pieces", F.when(F.size("_lexloom_matches") > 0, F.split(t, pattern, -1)))
    n = F.size("_lexloom_matches")
    sides = F.zip_with(F.slice("_lexloom_pieces", F.lit(1), n), F.slice("_lexloom_pieces", F.lit(2), n), lambda b, a: F.struct(F.length(b).alias("p"), F.right(b, F.lit(SIDE)).alias("b"), F.left(a, F.lit(1)).alias("a")))
    df = df.withColumn("_lexloom_pairs", F.zip_with(sides, "_lexloom_matches", lambda x, m: F.struct(x["p"].alias("p"), m.alias("v"), x["b"].alias("b"), x["a"].alias("a")))).drop("_lexloom_matches", "_lexloom_pieces")
    empty = F.array().cast(_SPAN)

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["p"]
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"), x["b"].alias("b"), x["a"].alias("a")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    blocks = F.when(F.size("_lexloom_pairs") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_lexloom_pairs") - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice("_lexloom_pairs", b * _BLOCK + 1, F.lit(_BLOCK)), start, add)))
    df = df.withColumn("_lexloom_blocks", blocks).drop("_lexloom_pairs")
    moved = F.aggregate("_lexloom_blocks", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    df = df.withColumn("_lexloom_moved", moved)
    shift = F.zip_with("_lexloom_blocks", "_lexloom_moved", lambda b, o: F.transform(b["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["v"].alias("v"), x["b"].alias("b"), x["a"].alias("a"))))
    return df.withColumn(name, F.coalesce(F.flatten(shift), empty)).drop("_lexloom_blocks", "_lexloom_moved")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.split(F.reverse(_digits(v)), "")
    total = F.aggregate(
        F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    """The format test of a kind."""
    n = F.length(_digits(v))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(v, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(13, 19) & _luhn(v)
    return n.between(9, 15)


def _plain(kind: str, v: Column) -> Column:
    """A wide proposal as the base pattern would have it."""
    if kind == "email":
        v = F.regexp_replace(F.regexp_replace(v, r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?\[dot\]\x20?", ".")
    if kind == "ip":
        v = F.regexp_replace(v, r"\x20", "")
    return v


def _level(x: Column, *bounds: int) -> Column:
    return reduce(lambda out, b: out + (x >= b).cast("int"), bounds, F.lit(0))


def _side(c: Column) -> Column:
    """0 nothing or white space, 1 a letter or digit, 2 any other mark."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"^[\p{L}\p{N}]$"), 1).otherwise(2)


def _proposals(kind: str, spans: str, wide: bool) -> Column:
    """Array of (k, s, e, base, y, code). base: a base span; own: looks like one; y: the
    weak label; code names the combination of features."""
    k = KINDS.index(kind)

    def one(x: Column) -> Column:
        v = x["v"]
        plain = _plain(kind, v) if wide else v
        if kind in BASE:
            form = "^(?:" + BASE[kind].replace(r"|\G", "") + ")$"
            ok = plain.rlike(form) & _passes(kind, plain) if wide else _passes(kind, v)
            own = v.rlike(form) & _passes(kind, v) if wide else ok
        else:
            ok, own = F.lit(True), F.lit(False)
        other = F.coalesce(x["b"].rlike(OTHER), F.lit(False))
        n = F.length(_digits(v))
        features = {
            "kind": F.lit(k), "wide": F.lit(int(wide)), "size": _level(F.length(v), 8, 13, 20), "digits": _level(n, 1, 9, 13),
            "groups": _level(F.size(F.split(v, "[^A-Za-z0-9]+", -1)), 2, 3, 5), "context": F.when(x["b"].rlike(CONTEXT[kind]), 1).when(other, 2).otherwise(0),
            "before": _side(F.right(x["b"], F.lit(1))), "after": _side(x["a"]),
        }
        code = reduce(lambda c, f: c * LEVELS[f] + features[f], features, F.lit(0))
        sure = lambda c: F.coalesce(c, F.lit(False))
        base = sure(own) if not wide else F.lit(False)
        return F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), base.alias("base"), sure(own).alias("own"), sure(ok & plain.rlike(STRICT[kind]) & ~other).alias("y"), code.cast("int").alias("code"))

    return F.transform(spans, one)


def propose(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with ``_proposed``: every proposal in each text."""
    df = docs
    for kind in KINDS:
        df = df.withColumn(f"_lexloom_need_{kind}", F.coalesce(F.col(text_col).rlike(NEED[kind]), F.lit(False)))
    parts = []
    for kind in KINDS:
        for wide, patterns in ((False, BASE), (True, WIDE)) if kind in BASE else ((True, WIDE),):
            name = f"_lexloom_{kind}_{int(wide)}"
            df = _with_matches(df, name, text_col, patterns[kind], f"_lexloom_need_{kind}")
            parts.append(_proposals(kind, name, wide))
    own = [c for c in docs.columns]
    return df.select(*own, F.concat(*parts).alias("_lexloom_proposed"))


# ---- boosted trees over the table of feature rows -------------------------------


def cell_levels() -> list[list[int]]:
    """Features of each code."""
    out = []
    for code in range(CELLS):
        row = []
        for n in reversed(LEVELS.values()):
            code, level = divmod(code, n)
            row.append(level)
        out.append(row[::-1])
    return out


class Trees:
    """Boosted trees of depth 3 (Newton steps on the logistic loss), fitted on counts of
    positive and of all proposals for each code."""

    def __init__(self, positive: dict[int, int], total: dict[int, int], rounds: int = ROUNDS):
        self.levels = np.array(cell_levels())
        codes = sorted(total)
        x = self.levels[np.array(codes, dtype=int)]
        pos = np.array([positive.get(c, 0) for c in codes], dtype=float)
        n = np.array([total[c] for c in codes], dtype=float)
        rate = min(0.99, max(0.01, pos.sum() / max(1.0, n.sum())))
        base = math.log(rate / (1 - rate))
        score, self.raw = np.full(len(codes), base), np.full(CELLS, base)
        for _ in range(rounds if codes else 0):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, pos - n * q, n * q * (1 - q), 3)
            score += self._leaves(tree, x)
            self.raw += self._leaves(tree, self.levels)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        best, split = 1e-6, None
        for f, n in enumerate(LEVELS.values()) if depth else ():
            for at in range(1, n):
                left = x[:, f] < at
                if left.any() and not left.all():
                    a, b = g[left].sum(), h[left].sum()
                    d = a * a / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)
                    if d > best:
                        best, split = d, (f, at, left)
        if split is None:
            return RATE * g.sum() / (h.sum() + 1)
        f, at, left = split
        return f, at, self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1)

    def _leaves(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, at, left, right = tree
        return np.where(x[:, f] < at, self._leaves(left, x), self._leaves(right, x))


def calibrated(trees: Trees, positive: dict[int, int], total: dict[int, int]) -> list[float]:
    """Probability of every code: isotonic regression of the labels on the trees' score,
    with one proposal of each label presumed in each step."""
    if not total:
        return [0.0] * CELLS
    raw = trees.raw
    steps: list[list[float]] = []
    for c in sorted(total, key=lambda c: (raw[c], c)):
        steps.append([raw[c], positive.get(c, 0), total[c]])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, a, b = steps.pop()
            steps[-1][1] += a
            steps[-1][2] += b
    at = np.searchsorted([s[0] for s in steps], raw + 1e-12, side="right")
    return [(steps[max(0, k - 1)][1] + 1) / (steps[max(0, k - 1)][2] + 2) for k in at]


@dataclass
class Model:
    """p: calibrated probability of each code. least: threshold of each kind, above 1 if
    it adds nothing. held: (precision, recall, right ones) of each kind's added spans in
    the held-out documents, by the weak labels."""

    p: list[float]
    least: list[float]
    held: dict[str, tuple[float, float, int]]


def threshold(p: list[float], counts: dict[int, tuple[int, int]], precision: float) -> tuple[float, float, float, int]:
    """(threshold, precision, recall, positives) for counts code -> (positive, all): the
    lowest probability from which on enough are right."""
    by_p: dict[float, list[int]] = {}
    for c, (pos, n) in counts.items():
        x = by_p.setdefault(p[c], [0, 0])
        x[0] += pos
        x[1] += n
    all_pos = sum(pos for pos, _ in counts.values())
    best, right, n = (2.0, 1.0, 0.0, all_pos), 0, 0
    for at in sorted(by_p, reverse=True):
        right, n = right + by_p[at][0], n + by_p[at][1]
        if right >= precision * n:
            best = (at, right / n, right / max(1, all_pos), all_pos)
    return best


def fit(docs: DataFrame, *, text_col: str = "text", precision: float = PRECISION) -> Model:
    """Model from the proposals of all documents."""
    text_col = column_of(docs, text_col)
    held = F.pmod(F.xxhash64(text_col), F.lit(FOLDS)) == FOLDS - 1
    # An inner explode would have all patterns evaluated once more, by an inferred filter.
    rows = propose(docs.select(text_col, held.alias("_held")), text_col).select("_held", F.explode_outer("_lexloom_proposed").alias("x"))
    # At most four rows for each of CELLS codes.
    counts = rows.groupBy("_held", "x.code", "x.own").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.y").cast("long")).alias("p")).collect()
    pos, total = ({h: dict.fromkeys([r["code"] for r in counts if r["_held"] == h and r["code"] is not None], 0) for h in (False, True)} for _ in range(2))
    added: list[dict[int, tuple[int, int]]] = [{} for _ in KINDS]
    for r in counts:
        if r["code"] is None:
            continue
        pos[r["_held"]][r["code"]] += r["p"]
        total[r["_held"]][r["code"]] += r["n"]
        if r["_held"] and not r["own"]:
            added[r["code"] // (CELLS // len(KINDS))][r["code"]] = (r["p"], r["n"])
    p = calibrated(Trees(pos[False], total[False]), pos[True], total[True])
    got = [threshold(p, a, precision) for a in added]
    return Model(p, [g[0] for g in got], {k: g[1:] for k, g in zip(KINDS, got, strict=True)})


def find_pii(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with pii_spans: array of (kind, s, e, base, p), by kind, then start."""
    text_col = column_of(docs, text_col)
    docs = docs.drop("pii_spans")
    table = F.split(F.lit(",".join(f"{p:.6g}" for p in model.p)), ",")
    least = F.array(*[F.lit(float(f"{x:.6g}")) for x in model.least])
    found = propose(docs, text_col)
    p = lambda x: F.element_at(table, x["code"] + 1).cast("double")
    taken = F.filter("_lexloom_proposed", lambda x: x["base"] | (p(x) >= F.element_at(least, x["k"] + 1)))
    # Proposals of one place stand together, a base span first, and only the first stays.
    ordered = F.array_sort(F.transform(taken, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), (~x["base"]).alias("more"), p(x).alias("p"))))
    found = found.withColumn("_lexloom_ordered", ordered)
    prev = lambda i: F.get("_lexloom_ordered", i - 1)
    spans = F.filter("_lexloom_ordered", lambda x, i: (i == 0) | (prev(i)["k"] != x["k"]) | (prev(i)["s"] != x["s"]) | (prev(i)["e"] != x["e"]))
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    out = found.withColumn("_lexloom_spans", spans)
    named = F.transform("_lexloom_spans", lambda x: F.struct(kind(x).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (~x["more"]).alias("base"), x["p"].alias("p")))
    return out.withColumn("pii_spans", named).drop("_lexloom_proposed", "_lexloom_ordered", "_lexloom_spans")


def redact(found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """found with each span of text_col replaced by its kind in brackets; spans that
    overlap become one, of the first's kind."""
    text_col = column_of(found, text_col)
    ordered = F.array_sort(F.transform("pii_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    t = F.col(text_col)
    cut = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"))),
    )
    return found.withColumn("_lexloom_cut", cut).withColumn(text_col, F.concat(F.col("_lexloom_cut.out"), F.substring(t, F.col("_lexloom_cut.at") + 1, F.length(t)))).drop("_lexloom_cut")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    found = find_pii(docs, fit(docs))
    base = F.filter("pii_spans", lambda x: x["base"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    of = lambda k: F.filter("pii_spans", lambda x: x["base"] & (x["kind"] == k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
