r"""Benchmark decontamination under edit distance.

An item leaks into a text if some stretch of the text is within a word edit distance of
``distance`` of the item's length. k edits leave at least n + 1 - 3 - 3 k of the n - 2
runs of three words of an item intact, each within k places of its own; where so many
stand in a text, of all texts and places, they open item-sized windows (an item too
short for this count opens them at each run of (n - k) / (k + 1) words, which k edits
can't all break). Windows and items are embedded by CGK random walks, which turn edit
distance into Hamming distance; bit samples of the embeddings are the keys of REPEATS
hash tables, and a window is compared with the items it meets in any table. An exact
alignment decides.

The items are a query set: they are read in blocks of bounded size, and each block is
broadcast and held against all texts.

Words are runs of ``\w``; in scripts that don't part words by spaces each character is a
word of its own, and two of them count as one towards ``min_words``. Items below
``min_words`` are found where all their words stand in a row, without an edit: by hashes
of all runs of their lengths.

Defined cases: null and empty texts and items, and items without a word, match nothing;
an item of a word or two matches every text that holds it; repeated rows and ids give
their matches each once for an id; letter case and punctuation don't count; an empty table on either side gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import column_of, documents, mix64, small_batches
from lexloom.llm.near_dedup import WordHash, word_hashes

#: Characters of scripts without spaces between words: Thai, Lao, Myanmar, Khmer, Tai,
#: Balinese, Javanese, Yi, Japanese, Bopomofo and Han; their punctuation is left out.
_UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e50-\u0e59\u0e81-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17d7\u17dc-\u17e9\u1950-\u19da\u1a20-\u1a99\u1b00-\u1b59"
    "\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3041-\u309a\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua48c\ua980-\ua9c0\ua9d0-\ua9d9\ua9e0-\ua9fe"
    "\uaa60-\uaadd\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003fffd"
)
WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
UNSPACED, JOINED = re.compile(f"[{_UNSPACED}]"), re.compile(r"\w+")
#: Edits for each word of an item; words of an item at least, below which none is allowed.
DISTANCE, MIN_WORDS = 0.2, 5
#: Hash tables and sampled places of each: a pair whose embeddings agree in a share a of
#: their places is missed with a chance of (1 - a ** SAMPLED) ** REPEATS; at a = 1/2, which
#: windows at the full distance exceed, 2 in a thousand.
REPEATS, SAMPLED = 48, 3
#: Characters of items that are broadcast at a time.
BLOCK_CHARS = 1 << 20
#: Windows that are embedded together.
FLUSH = 4096
_FILTER = 20


def words_of(text: str | None, cache: WordHash) -> np.ndarray:
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in WORD.findall((text or "").lower())], cache)


def long_enough(text: str, n: int, min_words: int) -> bool:
    """Whether an item of n words is searched for with edits."""
    return 2 * n - len(UNSPACED.findall(text.lower())) >= 2 * min_words or len(JOINED.findall(text)) >= min_words


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        out = mix64(out + h[j : j + len(out)] + np.uint64(j))
    return out


def edits(n: int, distance: float) -> int:
    return int(n * distance + 1e-9)


class Cgk:
    """Random walk of one repeat: a walk stays or moves on by a random bit of step and
    word, and writes the word it stands at, 3 n times for n words. The bucket key samples
    what it writes, at places that depend on n."""

    def __init__(self, repeat: int, longest: int):
        self.repeat = repeat
        self.seed = np.random.default_rng([repeat, 71]).integers(1, 1 << 63, 3 * longest, dtype=np.uint64)

    def sampled(self, n: int) -> np.ndarray:
        return np.sort(np.random.default_rng([n, self.repeat, 72]).choice(2 * n, SAMPLED, replace=2 * n < SAMPLED))

    def keys(self, windows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bucket keys of windows: rows of word hashes, filled up with zeros, and the
        number of words of each."""
        rows, at = np.arange(len(windows)), np.zeros(len(windows), dtype=np.int64)
        key = mix64(size.astype(np.uint64))
        places = {n: self.sampled(n) for n in np.unique(size).tolist()}
        when = np.stack([places[n] for n in size.tolist()])
        for j in range(int(when.max()) + 1):
            sym = windows[rows, at]
            for c in range(SAMPLED):
                key = np.where(when[:, c] == j, mix64(key + sym + np.uint64(j)), key)
            at = np.minimum(at + ((mix64(sym ^ self.seed[j]) >> np.uint64(17)) & np.uint64(1)).astype(np.int64), size)
        return key


def stacked(windows: list[np.ndarray], longest: int) -> np.ndarray:
    out = np.zeros((len(windows), longest + 1), dtype=np.uint64)
    for i, w in enumerate(windows):
        out[i, : len(w)] = w
    return out


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of region nearest to item: the first to end."""

    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, dtype=np.int64) if free else steps.copy()
        for w in a:
            t = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (b != w), row[1:] + 1)])
            row = np.minimum.accumulate(t - steps) + steps
        return row

    row = last_row(item, region, True)
    end = int(np.argmin(row))
    back = last_row(item[::-1], region[:end][::-1], False)
    return int(row[end]), end - int(np.argmin(back)), end


def _filter(known: dict[int, list]) -> np.ndarray:
    bits = np.zeros(1 << _FILTER, dtype=bool)
    bits[np.fromiter(known, dtype=np.uint64) >> np.uint64(64 - _FILTER)] = True
    return bits


class Items:
    """Word hashes, runs and tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], distance: float, min_words: int):
        cache = WordHash()
        self.distance = distance
        self.ids, self.words = [], []
        #: Items without edits: number of words -> run -> ids.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, t in items:
            h = words_of(t, cache)
            if long_enough(t, len(h), min_words):
                self.ids.append(i)
                self.words.append(h)
            elif len(h):
                self.short[len(h)][int(runs(h, len(h))[0])].append(i)
        self.short = {n: dict(v) for n, v in sorted(self.short.items())}
        self.short_seen = {n: _filter(v) for n, v in self.short.items()}
        self.allowed = [edits(len(h), distance) for h in self.words]
        self.longest = max(map(len, self.words), default=1)
        #: Runs that must stand at a leak.
        self.need = [max(1, len(h) + 1 - 3 - 3 * e) for h, e in zip(self.words, self.allowed, strict=True)]
        runs_of: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (h, e) in enumerate(zip(self.words, self.allowed, strict=True)):
            size = 3 if self.need[k] > 1 else min(4, -(-(len(h) - e) // (e + 1)))
            for p, r in enumerate(runs(h, size).tolist()):
                runs_of[size][r].append((k, p))
        self.runs = {s: dict(v) for s, v in runs_of.items()}
        self.seen = {s: _filter(v) for s, v in self.runs.items()}
        self.walks = [Cgk(r, self.longest) for r in range(REPEATS)]
        #: Of each repeat: key -> items.
        self.tables: list[dict[int, list[int]]] = []
        size = np.array([len(h) for h in self.words], dtype=np.int64)
        for walk in self.walks if self.words else []:
            table = defaultdict(list)
            for k, key in enumerate(walk.keys(stacked(self.words, self.longest), size).tolist()):
                table[key].append(k)
            self.tables.append(dict(table))

    def exact(self, doc: str | None, h: np.ndarray) -> Iterator[tuple]:
        """(doc, item, 0, first word, last word) of the first place of each short item."""
        r, done = np.zeros(len(h), dtype=np.uint64), 0
        for n, known in self.short.items():
            if n > len(h):
                return
            for j in range(done, n):
                r = mix64(r[: len(h) - j] + h[j:] + np.uint64(j))
            done = n
            at = np.flatnonzero(self.short_seen[n][r >> np.uint64(64 - _FILTER)])
            hashes, first = np.unique(r[at], return_index=True)
            for x, p in zip(hashes.tolist(), at[first].tolist(), strict=True):
                for i in known.get(x, ()):
                    yield doc, i, 0, p, p + n - 1

    def windows(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(size, start) of the windows that intact runs open."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, known in self.runs.items():
            r = runs(h, size)
            for p in np.flatnonzero(self.seen[size][r >> np.uint64(64 - _FILTER)]).tolist():
                for k, at in known.get(int(r[p]), ()):
                    hits[k].append((p - at, at))
        out = set()
        for k, own in hits.items():
            need, reach = self.need[k], 2 * self.allowed[k]
            if len(own) < need:
                continue
            own.sort()
            lo, inside = 0, defaultdict(int)
            for i, (start, at) in enumerate(own):
                inside[at] += 1
                while own[lo][0] < start - reach:
                    inside[own[lo][1]] -= 1
                    if not inside[own[lo][1]]:
                        del inside[own[lo][1]]
                    lo += 1
                if len(inside) >= need:
                    out.update((len(self.words[k]), max(0, s)) for s in {x for x, _ in own[lo : i + 1]})
        return out

    def opened(self, doc: str | None, h: np.ndarray) -> list[tuple]:
        """(doc, size, start, first word of the region, region) for each window."""
        out = []
        for n, s in sorted(self.windows(h)):
            lo = max(0, s - (e := edits(n, self.distance)))
            out.append((doc, n, s, lo, h[lo : s + n + e]))
        return out

    def matches(self, opened: list[tuple]) -> Iterator[tuple]:
        """(doc, item, distance, first word, last word) of windows that meet an item in
        some table and are near enough."""
        if not opened:
            return
        size = np.array([n for _, n, *_ in opened], dtype=np.int64)
        rows = stacked([region[s - lo : s - lo + n] for _, n, s, lo, region in opened], self.longest)
        met: set[tuple[int, int]] = set()
        for walk, table in zip(self.walks, self.tables, strict=True):
            for i, key in enumerate(walk.keys(rows, size).tolist()):
                met.update((i, k) for k in table.get(key, ()) if len(self.words[k]) == size[i])
        for i, k in sorted(met):
            doc, _, _, lo, region = opened[i]
            dist, a, b = align(self.words[k], region)
            if dist <= self.allowed[k]:
                yield doc, self.ids[k], dist, lo + a, lo + b - 1


def find_leaks(docs: DataFrame, items: DataFrame, *, distance: float = DISTANCE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, first_word, last_word): leaks of items into docs."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(column_of(docs, id_col)).cast("string").alias("d"), F.col(column_of(docs, text_col)).alias("t")).where("t IS NOT NULL")
    asked = items.select(F.col(column_of(items, item_col)).cast("string").alias("i"), F.col(column_of(items, item_text_col)).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    schema = "d string, item_id string, distance long, first_word long, last_word long"

    def against(block: list[tuple[str, str]]) -> DataFrame:
        held = spark.sparkContext.broadcast(Items(block, distance, min_words))

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, cache, waiting, short = held.value, WordHash(), [], []

            def found() -> Iterator[pd.DataFrame]:
                rows = [*short, *known.matches(waiting)]
                waiting.clear()
                short.clear()
                if rows:
                    yield pd.DataFrame(rows, columns=["d", "item_id", "distance", "first_word", "last_word"])

            for b in batches:
                for d, t in zip(b["d"].to_list(), b["t"], strict=True):
                    h = words_of(t, cache)
                    waiting += known.opened(d, h)
                    short += known.exact(d, h)
                    if max(len(waiting), len(short)) >= FLUSH:
                        yield from found()
            yield from found()

        return src.mapInPandas(find, schema)

    parts, block, size = [], [], 0
    for r in asked.orderBy("i", "t").toLocalIterator():
        if block and size + len(r["t"]) > BLOCK_CHARS:
            parts.append(against(block))
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    parts.append(against(block))
    found = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct("distance", "first_word", "last_word")).alias("m")
    kind, item_kind = docs.schema[column_of(docs, id_col)].dataType, items.schema[column_of(items, item_col)].dataType
    return found.groupBy(F.col("d").cast(kind).alias("doc_id"), F.col("item_id").cast(item_kind).alias("item_id")).agg(best).select("doc_id", "item_id", "m.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
