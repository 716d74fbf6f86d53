"""Periodic runs of words: maximal repetitions in every text.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(least, 2 * q) that no neighbouring word extends. All of a text's runs are enumerated:

1. Ranks of all stretches of 1, 2, 4, ... words (by doubling) give the suffix array, and
   by comparing from the longest down, the common prefix or suffix of any two places.
2. The suffix array and its common prefixes give the longest previous factor of each
   place by one pass with a stack, and these the blocks of a Lempel-Ziv factorisation.
3. Main's extensions: a run that touches the edge of a block has a period of at most the
   two blocks' lengths, so extending from each edge for each such period, to the right and
   to the left, finds them all, with O(words) extensions.
4. A run strictly inside a block also stands in the block's source, which lies earlier.
   Runs are kept in buckets by their start; each block copies those of its source.

A text without a stretch of words whose six-grams came before at a distance within the
stretch can't hold a run and leaves at once (see may_repeat): this loses none.

A text is the work of one task; texts are independent, so nothing is shuffled. Memory for
a text with repetitions is 4 bytes a word and doubling, with the doublings of its longest
repeated stretch.

Defined cases: null and empty texts have no words and no runs; a null id is an id like
others; repeated rows get the same result each; an empty table gives an empty table; other
columns pass through, and one named like an output column gives way to it.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import add_columns, as_bytes, column_of, documents

#: Words of a run at least, whatever its period.
LEAST = 12
#: Places that are extended at a time.
CHUNK = 1 << 18


class Ranks:
    """Ranks of all stretches of 2^k words, k from 0 until all suffixes differ."""

    def __init__(self, ids: np.ndarray):
        self.n, self.levels = len(ids), []
        rank, step = ids.astype(np.int32), 1
        while len(ids) and int(rank.max()) + 1 < self.n:
            self.levels.append(rank)
            # A stretch cut by the end is unlike all others: what follows it is shorter.
            key = rank.astype(np.int64) * (self.n + 2)
            key[: self.n - step] += rank[step:] + 1
            rank, step = np.unique(key, return_inverse=True)[1].astype(np.int32), 2 * step
        self.suffixes = np.empty(self.n, dtype=np.int64)
        self.suffixes[rank] = np.arange(self.n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common stretch that starts at i and at j > i."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = i + got, j + got
            rank = self.levels[k]
            got += (np.where(b < self.n, rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)], False)) * (1 << k)
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common stretch that ends at i and at j > i; none at i < 0."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            a, b = i - got - (1 << k) + 1, j - got - (1 << k) + 1
            rank = self.levels[k]
            got += (np.where(a >= 0, rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)], False)) * (1 << k)
        return got


def previous_factors(suffixes: np.ndarray, common: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place the longest stretch that also starts earlier, and where. common[r] is
    the common prefix of the suffixes of rank r - 1 and r (0 at r = 0). On the stack stand
    places in increasing order, each with its common prefix with the one below."""
    n = len(suffixes)
    length, source = [0] * n, [-1] * n
    places, prefixes = [], []
    for at, shared in zip([*suffixes.tolist(), -1], [*common.tolist(), 0], strict=True):
        while places and at < places[-1]:
            top, below = places.pop(), prefixes.pop()
            if below >= shared:
                length[top], source[top] = below, places[-1] if places else -1
            else:
                length[top], source[top] = shared, at
            shared = min(below, shared)
        places.append(at)
        prefixes.append(shared)
    return length, source


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, p): p from 1 to counts[which]."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts) - counts)[which] + 1


def find_periods(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of small numbers, by start, then period."""
    n = len(ids)
    if n < least:
        return []
    ranks = Ranks(ids)
    order = ranks.suffixes
    common = np.zeros(n, dtype=np.int64)
    for at in range(1, n, CHUNK):
        a, b = order[at - 1 : at - 1 + CHUNK], order[at : at + CHUNK]
        a = a[: len(b)]
        common[at : at + CHUNK] = ranks.forward(np.minimum(a, b), np.maximum(a, b))
    length, source = previous_factors(order, common)
    edges = [0]
    while edges[-1] < n:
        edges.append(edges[-1] + max(1, length[edges[-1]]))

    sizes = np.diff(edges)
    after = np.append(sizes[1:], 0)
    found: dict[tuple[int, int], int] = {}
    for reach, right in ((after, True), (sizes + after, False)):
        # Edges 1 to the last: the last is the text's end.
        for lo, hi in _packs(reach):
            which, p = _steps(reach[lo:hi])
            b = np.asarray(edges[1:])[lo:hi][which]
            i = b if right else b - p
            fits = (i >= 0) & (i + p <= n)
            i, p = i[fits], p[fits]
            on, back = ranks.forward(i, i + p), ranks.backward(i - 1, i + p - 1)
            for s, e, q in zip(*(x[(on + back >= p) & (on + back + p >= least)].tolist() for x in (i - back, i + p + on, p)), strict=True):
                found[s, e] = min(q, found.get((s, e), q))

    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in found.items():
        buckets.setdefault(s, []).append((e, q))
    starts = sorted(buckets)
    for b, size in zip(edges, sizes.tolist(), strict=False):
        if size < least + 2 or source[b] < 0:
            continue
        k, shift = bisect_right(starts, source[b]), b - source[b]
        while k < len(starts) and starts[k] < source[b] + size:
            s = starts[k]
            for e, q in list(buckets[s]):
                if e < source[b] + size and (s + shift, e + shift) not in found:
                    found[s + shift, e + shift] = q
                    if s + shift not in buckets:
                        insort(starts, s + shift)
                    buckets.setdefault(s + shift, []).append((e + shift, q))
            k += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def _packs(counts: np.ndarray):
    """Ranges of consecutive edges with about CHUNK extensions each."""
    total, at = np.cumsum(counts), 0
    while at < len(counts):
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right"))
        to = max(to, at + 1)
        yield at, to
        at = to


_MIX = np.uint64(0x9E3779B97F4A7C15)


def may_repeat(words: list[bytes], least: int = LEAST) -> bool:
    """False only if no run can be there. In a run of period q and length L >= max(least, 2q)
    the L - q - g + 1 grams of g = least // 2 words from its second period on all occurred at
    most q words before, and q <= (L - q - g + 1) + g - 1. So some stretch of consecutive
    grams that all occurred before is, with g - 1 more, as long as one of its distances."""
    n, g = len(words), max(1, least // 2)
    if n < least:
        return False
    x = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    h = np.zeros(n - g + 1, dtype=np.uint64)
    for j in range(g):
        h = h * _MIX + x[j : n - g + 1 + j]
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return False
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    at, away = order[1:][same], (order[1:] - order[:-1])[same]
    by = np.argsort(at)
    at, away = at[by], away[by]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
    size = np.diff(np.append(first, len(at)))
    return bool((np.minimum.reduceat(away, first) <= size + g - 1).any())


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of words."""
    if not may_repeat(words, least):
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    return find_periods(ids, least)


def find_runs(docs: DataFrame, *, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """docs with runs (array of start, length and period, by start, then period), n_words and
    collapsed: the words that no run holds after its first period, joined by spaces."""

    def run(texts: list) -> list[list]:
        every, counts, kept = [], [], []
        for t in texts:
            words = as_bytes(t).split()
            own = runs_of(words, least)
            if own:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for s, size, q in own:
                    edge[s + q] += 1
                    edge[s + size] -= 1
                left = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                words, n = [words[i] for i in left], len(words)
            else:
                n = len(words)
            every.append([{"start": s, "length": size, "period": q} for s, size, q in own])
            counts.append(n)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return [every, counts, kept]

    out = {"runs": "array<struct<start: long, length: long, period: long>>", "n_words": "long", "collapsed": "string"}
    return add_columns(docs, [column_of(docs, text_col)], run, out)


def planted(id_: Column, text: Column) -> Column:
    """The contract's input: in one text of ten a stretch of words fills the rest of the text,
    by a hash of the id."""
    h = F.crc32(F.encode(id_.cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    own = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    # One struct in an array: words, a and p are evaluated once a text.
    filled = F.transform(F.array(own), lambda s: F.array_join(F.transform(s["w"], lambda w, i: F.when(i >= s["a"], F.get(s["w"], s["a"] + (i - s["a"]) % s["p"])).otherwise(w)), " "))
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.get(filled, F.lit(0))).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    out = found.withColumn("b", best).withColumn("lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")))
    length, period = F.col("b.length"), -F.col("b.p")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
