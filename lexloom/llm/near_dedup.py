"""MinHash near-dedup over word shingles.

1. Each text becomes its set of distinct shingles; equal sets are one class from then
   on, named by its smallest id, so copies cost nothing further.
2. Many universal hash minima make a signature; bands of it put classes into buckets.
   The number of bands follows from the similarity: a linked pair shares no bucket with
   a probability of at most MISS.
3. In each bucket every class is a candidate of the smallest one (a star, not all
   pairs). Four bits of each minimum (the sketch) come first, then the full sets decide.
4. Links give components by alternating large-star and small-star.
5. A bucket whose classes are still in several components is searched in full: each
   class outside the bucket's largest component against all others of the bucket in
   other components, in cells (block of members, block of outsiders) of bounded size, each
   pair in the first bucket that it shares. Sketches tell which classes of a cell need
   their full sets; with these the cell decides and returns the links that join
   components, so no more rows than it has. Pairs within a component can't change it, so
   nothing that could is left out.

Full sets are made for classes that a candidate pair names, and travel to cells once,
whatever the number of their pairs there; a head of many pairs is dealt to several cells.

Defined cases: texts without words (null and empty ones too) have an empty set and link
with nothing; rows that share an id are one document for linking; rows without an id
link with nothing, have no component and are kept; ids may have any type with an order;
repeated rows get the same result each; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import add_columns, as_bytes, column_of, documents, forget, mix64, small_batches, spread_join, written
from lexloom.llm.components import components

SHINGLE, PERCENT = 5, 80
MISS = 1e-6
#: Classes of a bucket that one task compares with as many others.
BLOCK = 1024
#: Rows of small cells that are handed to a task at a time.
PACK = 4096
#: Shingles of all sets that a cell of pairs aims at.
WEIGHT = 1 << 20
#: Shingles that are hashed at a time.
CHUNK = 1 << 15


class WordHash(dict):
    """Word -> 64-bit hash, forgetting when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


_POWERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)


def shingles(text: str | None, cache: WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles; words end at ASCII white space, A-Z count as a-z."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    w, n = word_hashes(words, cache), len(words) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h += w[j : j + n] * _POWERS[j % len(_POWERS)] + np.uint64(j)
        h = (h << np.uint64(7)) ^ (h >> np.uint64(57))
    return np.unique(mix64(h))


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of a band) with a miss of at most MISS at the similarity."""
    s, rows = percent / 100, 5 if percent >= 82 else 4
    return math.ceil(math.log(MISS) / math.log(1 - s**rows)), rows


def most_apart(percent: int, n: int) -> int:
    """How many of n minima differ in four bits at most in a linked pair, but for a chance
    of MISS: the quantile of a binomial distribution."""
    p, total, k = (1 - percent / 100) * 15 / 16, 0.0, -1
    while total < 1 - MISS and k < n:
        k += 1
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


_ONES = np.uint64(0x1111111111111111)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of unequal minima of sketches (rows of 64-bit words)."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _ONES).sum(axis=-1)


def as_words(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1)


class MinHash:
    """n universal hashes (a * x + b over 32 bits, a odd) and their minima."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20_240_229)
        self.bands, self.rows, n = bands, rows, bands * rows
        self.a = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """len(sets) x n; sets must not be empty."""
        out = np.empty((len(self.a), len(sets)), dtype=np.uint32)
        at = 0
        while at < len(sets):
            end, total = at, 0
            while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
                total += len(sets[end])
                end += 1
            x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
            starts = np.cumsum([0, *map(len, sets[at : end - 1])])
            y = np.empty_like(x)
            for k, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                np.multiply(x, a, out=y)
                np.add(y, b, out=y)
                out[k, at:end] = np.minimum.reduceat(y, starts)
            at = end
        return out.T

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One bucket key for each band; bands don't share keys."""
        m = minima.reshape(len(minima), self.bands, self.rows).astype(np.uint64)
        h = np.zeros(m.shape[:2], dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * _POWERS[7]
        for j in range(self.rows):
            h = mix64(h * _POWERS[1] + m[:, :, j] + np.uint64(1))
        return h.view(np.int64)

    def sketches(self, minima: np.ndarray) -> np.ndarray:
        """Four bits of each minimum, two in a byte, filled up to whole words of 64 bits."""
        low = (minima & np.uint32(15)).astype(np.uint8)
        low = np.pad(low, ((0, 0), (0, -low.shape[1] % 16)))
        return low[:, ::2] << 4 | low[:, 1::2]


def signatures(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """docs (id, t) as (id, n, s1, s2, keys, sketch): set size, name of the set, buckets."""
    bands, rows = banding(percent)
    cache, hasher = WordHash(), MinHash(bands, rows)

    def sign(texts: list) -> list[list]:
        sets = [shingles(t, cache, size) for t in texts]
        full = [s for s in sets if len(s)]
        keys: list = [None] * len(sets)
        sketches: list = [None] * len(sets)
        names = np.zeros((len(sets), 2), dtype=np.int64)
        if full:
            m = hasher.minima(full)
            for i, k, s in zip(np.flatnonzero([len(s) for s in sets]), hasher.keys(m), hasher.sketches(m), strict=True):
                keys[i], sketches[i] = k, s.tobytes()
                names[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), dtype="<i8")
        return [[len(s) for s in sets], names[:, 0], names[:, 1], keys, sketches]

    return add_columns(docs, ["t"], sign, {"n": "long", "s1": "long", "s2": "long", "keys": "array<long>", "sketch": "binary"}, without=("t",))


def _sets(docs: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(id, form): full sets of the ids that are named. Texts are joined by sorting whatever
    the number of ids, which grows with the corpus, so that small tables show what large
    ones cost."""
    cache = WordHash()
    texts = docs.join(named.select("id").distinct().hint("merge"), "id", "left_semi")
    return written(add_columns(texts, ["t"], lambda ts: [[shingles(t, cache, size).tobytes() for t in ts]], {"form": "binary"}, without=("t",)), "sets")


def linked(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets are similar enough to a."""
    sizes = np.array([len(x) for x in others])
    if not len(a) or not sizes.all():
        return np.array([bool(len(a)) and len(x) > 0 and bool(linked(a, [x], percent)[0]) for x in others]) if len(others) > 1 else np.zeros(1, dtype=bool)
    flat = np.concatenate(others)
    hit = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= percent * (len(a) + sizes - both)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """(u, v): pairs (cell, u, v) whose full sets are similar enough, but for those whose
    ends others of the same cell join already."""
    named = pairs.select("cell", F.col("u").alias("id")).unionByName(pairs.select("cell", F.col("v").alias("id"))).distinct()
    sets = _sets(docs, named, size)

    def check(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        own: dict = {}
        for i, form in zip(s["id"], s["form"], strict=True):
            own.setdefault(i, []).append(np.frombuffer(form, dtype=np.uint64))
        top = {i: i for i in own}

        def root(i):
            while top[i] != i:
                top[i] = i = top[top[i]]
            return i

        out = []
        for u, v in zip(p["u"], p["v"], strict=True):
            a, b = root(u), root(v)
            if a != b and any(linked(x, [y], percent)[0] for x in own[u] for y in own[v]):
                top[a] = b
                out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"]) if out else p[["u", "v"]].iloc[:0]

    kind = docs.schema["id"].dataType.simpleString()
    placed = named.join(sets, "id").select(F.col("cell").alias("at"), "id", "form")
    links = pairs.groupBy("cell").cogroup(placed.groupBy("at")).applyInPandas(check, f"u {kind}, v {kind}")
    out = written(links, "links")
    forget(sets)
    return out


def near_groups(docs: DataFrame, *, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of docs; component_id
    is the smallest id that links lead to, kept tells whether it is the row's own."""
    docs = docs.select(F.col(column_of(docs, id_col)).alias("id"), F.col(column_of(docs, text_col)).alias("t"))
    small_batches(docs.sparkSession)
    bands, rows = banding(percent)
    most = most_apart(percent, bands * rows)
    signed = written(signatures(docs, percent, size), "signatures")
    named = signed.where("n > 0 AND id IS NOT NULL")
    classes = written(named.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "classes")
    nodes = classes.select("rep", "n", "sketch", "keys")
    buckets = classes.select("rep", F.explode("keys").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Classes in buckets with others, each with its bucket's smallest.
    shared = written(spread_join(buckets, heads, "key", classes.count() * bands), "buckets")
    star = _star_pairs(shared, nodes, percent, most)
    links = _verified(star, docs, percent, size)
    # Rows of one id whose texts differ: their classes are one node's.
    several = named.groupBy("id").agg(F.min("s1").alias("p"), F.max("s1").alias("q")).where("p <> q").select("id")
    same = named.join(several, "id", "left_semi").join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).where("id <> rep")
    links = links.unionByName(same.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    first = written(components(links), "components")
    more = _rest_links(shared, nodes, first, docs, percent, size, most)
    forget(shared)
    comp = first if more.isEmpty() else written(components(links.unionByName(more)), "components")
    to = comp.select(F.col("id").alias("rep"), F.col("component").alias("c"))
    out = signed.select("id", "n", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"], "left").join(to, "rep", "left")
    own_comp = F.when(F.col("n") > 0, F.coalesce("c", "rep", "id")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own_comp).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _cell(weight: int, *parts: str):
    """Number of a cell: natural ones (by parts) are packed, as their weights add up."""
    return F.pmod(F.xxhash64(*parts), F.lit(max(1, -(-weight // WEIGHT))))


def _star_pairs(shared: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """(cell, u, v): classes and smallest ones of their buckets with like sketches."""
    star = shared.where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    kind = shared.schema["rep"].dataType.simpleString()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.loc[apart(as_words(b["su"]), as_words(b["sv"])) <= most, ["u", "v", "nu"]]

    for c in "uv":
        star = star.join(nodes.select(F.col("rep").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("s" + c)), c)
    fits = star.where((100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")))
    pairs = written(fits.select("u", "v", "nu", "su", "sv").mapInPandas(check, f"u {kind}, v {kind}, nu long"), "pairs")
    weight = pairs.agg(F.sum("nu")).first()[0] or 0
    # A head of many pairs is dealt to several cells; there are few such heads.
    heavy = pairs.groupBy("v").agg(F.ceil(F.sum("nu") / max(WEIGHT, weight >> 16)).alias("parts")).where("parts > 1")
    dealt = pairs.join(F.broadcast(heavy), "v", "left").withColumn("part", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))))
    return dealt.select(_cell(weight, "v", "part").alias("cell"), "u", "v")


def _met(b: pd.DataFrame, group: np.ndarray, percent: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a cell's rows each outsider, with the members that it may be linked with: in
    another component (group, which may change meanwhile), of like size and sketch, and
    first met in this bucket. Two outsiders meet once, at the larger id."""
    n, rep, words, keys = b["n"].to_numpy(), b["rep"].to_numpy(), as_words(b["sketch"]), np.stack(b["keys"].to_list())
    out, away, band = b["out"].to_numpy(bool), b["away"].to_numpy(bool), b["band"].iloc[0]
    members = np.flatnonzero(~out)
    for o in np.flatnonzero(out):
        own = members[(100 * n[members] >= percent * n[o]) & (100 * n[o] >= percent * n[members])]
        own = own[(group[own] != group[o]) & (~away[own] | (rep[own] < rep[o]))]
        own = own[apart(words[own], words[o]) <= most]
        yield o, own[(keys[own] == keys[o]).argmax(axis=1) == band]


def _rest_links(shared: DataFrame, nodes: DataFrame, comp: DataFrame, docs: DataFrame, percent: int, size: int, most: int) -> DataFrame:
    """(u, v): links between components within buckets, at least as many as join them."""
    kind = shared.schema["rep"].dataType.simpleString()
    rows = shared.select("key", "rep").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = rows.join(nodes.select("rep", "n"), "rep")
    sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    split = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("n"), F.sum("w").alias("w"), F.max("k").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda rows, weight: F.greatest(F.ceil(rows / BLOCK), F.ceil(weight / WEIGHT)).cast("int")
    plan = split.select("key", "main", "n", blocks(F.col("n"), F.col("w")).alias("mb"), blocks(F.col("n") - F.col("most"), F.col("w") * (F.col("n") - F.col("most")) / F.col("n")).alias("ob"))
    left = spread_join(rows.select("key", "rep", "component"), plan, "key", shared.count())
    left = written(left.withColumn("away", F.col("component") != F.col("main")).drop("main").join(nodes, "rep").withColumn("band", (F.array_position("keys", F.col("key")) - 1).cast("int")), "rest")

    def block(n: str):
        return F.pmod(F.hash("rep"), F.col(n)).cast("int")

    own = ["rep", "component", "n", "sketch", "keys", "band", "away"]
    member = left.select("key", block("mb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("j"), *own, F.lit(False).alias("out"))
    outside = left.where("away").select("key", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), block("ob").alias("j"), *own, F.lit(True).alias("out"))

    # Small cells are packed: each task call takes several.
    packs = max(1, -(-2 * left.count() // PACK))

    def each(b: pd.DataFrame, f) -> pd.DataFrame:
        out = pd.concat([f(x.reset_index(drop=True)) for _, x in b.groupby(["key", "i", "j"], sort=False)])
        # Columns of strings must leave as they come: one array each.
        return out.astype({c: object for c in ("rep", "component", "u", "v") if c in out and out[c].dtype.kind not in "iuO"})

    def needed(b: pd.DataFrame) -> pd.DataFrame:
        group = np.unique(b["component"].to_numpy(), return_inverse=True)[1]
        use = np.zeros(len(b), dtype=bool)
        for o, others in _met(b, group, percent, most):
            if len(others):
                use[o] = use[others] = True
        return b[use]

    def decide(b: pd.DataFrame) -> pd.DataFrame:
        group = np.unique(b["component"].to_numpy(), return_inverse=True)[1]
        rep, sets, links = b["rep"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in b["form"]], []
        for o, others in _met(b, group, percent, most):
            # A few at a time: what joins spares the rest of that component.
            for at in range(0, len(others), 32):
                few = others[at : at + 32]
                few = few[group[few] != group[o]]
                for m in few[linked(sets[o], [sets[m] for m in few], percent)] if len(few) else few:
                    if group[m] != group[o]:
                        group[group == group[o]] = group[m]
                        links.append((rep[o], rep[m]))
        return pd.DataFrame(links, columns=["u", "v"]) if links else pd.DataFrame({"u": rep[:0], "v": rep[:0]})

    columns = f"key long, i int, j int, rep {kind}, component {kind}, n long, sketch binary, keys array<long>, band int, away boolean, out boolean"
    pack = F.pmod(F.xxhash64("key", "i", "j"), F.lit(packs))
    used = written(member.unionByName(outside).groupBy(pack).applyInPandas(lambda b: each(b, needed), columns), "cells")
    sets = _sets(docs, used.select(F.col("rep").alias("id")), size)
    links = used.join(sets.withColumnRenamed("id", "rep"), "rep").groupBy(pack).applyInPandas(lambda b: each(b, decide), f"u {kind}, v {kind}")
    out = written(links, "links")
    forget(left, used, sets)
    return out


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return near_groups(docs, percent=85).withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS u, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u WHERE r.c < e.v)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM documents d JOIN r ON r.u = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
