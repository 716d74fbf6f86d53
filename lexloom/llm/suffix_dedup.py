"""Exact substring dedup: strings of ``length`` bytes that start at two places or more.

Corpus side, in the manner of a sampled suffix index. Every window of ``length`` bytes
has a minimizer: the SEED bytes in it with the smallest hash. Equal windows have equal
minimizers at equal offsets, so only minimizers that stand at several places can belong
to a repeat; all others, nearly all of a corpus, drop out after one aggregation by hash.
A minimizer's windows lie in one region around it. Equal regions are one row from then
on, with the number of their places: a region of two places or more is a repeated
interval as it stands.

What is left are regions with a repeated minimizer that differ in part, at the ends of
repeats. With the minimizer as one symbol, the rows that begin with it are one block of
the corpus's transform, to which each shard brings the rows of its own texts. The
interleave of the block's rows starts as the block itself and is refined one symbol an
iteration, to the right and, over the symbols before the rows, to the left; a row leaves
once it is alone. The iteration at which neighbours part is their common prefix, so a
window that reaches o bytes to the left is repeated if its row shares the block of left
iteration o and of right iteration (rest of the window) with another row. No suffix is
sorted again. Transforms of whole shards aren't written down: the README has the figures.
Blocks of more than ``group`` rows (a passage in a third of all texts, say) would not
fit a task: their windows are counted by hash, with partial sums before the exchange,
which gives the same result.

Hashes have 64 bits for a minimizer and 64 more for what surrounds it; texts are known
by two hashes of 64 bits.

Defined cases: a null text has no bytes and stays null; a text shorter than ``length``
is kept whole; cut texts are rejoined as bytes, since a cut may fall within a character;
rows that repeat an id and a text each count, so both lose all they share; other columns
pass through, and one named like an output column gives way to it; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import add_columns, as_bytes, column_of, documents, mix64, row_keys, small_batches, spread_join, written

LENGTH, SEED = 200, 64
#: Rows of one block that a task refines, rows that a task aims at, and rows that it
#: refines at a time (whole blocks).
GROUP, TASK_ROWS, AT_ONCE = 1 << 15, 20_000, 1 << 13
U64 = np.uint64


class Rolling:
    """Hashes of all substrings of a text: prefix sums of powers, modulo 2 ** 64."""

    _rng = np.random.default_rng(8_675_309)
    TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    _powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    @classmethod
    def powers(cls, n: int, which: int) -> np.ndarray:
        if len(cls._powers[which]) < n:
            size = 1 << (n - 1).bit_length()
            x = np.full(size, (cls.BASE, cls.INVERSE)[which], dtype=np.uint64)
            x[0] = 1
            cls._powers[which] = np.multiply.accumulate(x)
        return cls._powers[which][:n]

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, dtype=np.uint8)
        self.n = len(b)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(self.TABLE[b] * self.powers(max(1, self.n), 0)[: self.n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.powers(self.n + 1, 1)[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each place on."""
        m = self.n - k + 1
        return mix64((self.sums[k:] - self.sums[:m]) * self.powers(m, 1))


def leftmost_minima(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest (the first, in ties) of each w in a row."""
    m = len(g) - w + 1
    low = np.lib.stride_tricks.sliding_window_view(g, w) if m < 64 else None
    if low is not None:
        return np.arange(m) + low.argmin(axis=1)
    # Minimum from each block's start on, and back from its end; then where it stands.
    pad = -len(g) % w
    x = np.concatenate([g, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:m], ahead[w - 1 : w - 1 + m])
    # Of runs of equal minima, the first window's place is found by hand; a minimum that
    # enters on the right or leaves on the left begins a new run.
    at = np.empty(m, dtype=np.int64)
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(change[1:], m)
    for a, b in zip(change.tolist(), ends.tolist(), strict=True):
        v = least[a]
        while a < b:
            p = a + int(np.argmax(g[a : a + w] == v))
            stop = min(b, p + 1)
            at[a:stop] = p
            a = stop
    return at


def seeds(raw: bytes, length: int = LENGTH, k: int = SEED) -> tuple[np.ndarray, ...]:
    """(h, rest, at, left, right) of each minimizer of a text: its hash, the hash of its
    region, its place, and by how much the region goes beyond it on either side."""
    if len(raw) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    r = Rolling(raw)
    g = r.grams(k)
    at = leftmost_minima(g, length - k + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    m = at[first]
    left, right = m - first, last + length - (m + k)
    rest = mix64(r.hashes(first, last + length) + (left * 4096 + right).astype(np.uint64))
    return g[m], rest, m, left, right


# ---- interleave refinement -------------------------------------------------------


def refined(block: np.ndarray, symbols: np.ndarray, steps: int) -> np.ndarray:
    """Block of each row (a column) after 0 to ``steps`` iterations (rows). symbols:
    rows x steps, -1 past a row's end, where it parts from all others. Rows that are
    alone in their block aren't looked at again."""
    n = len(block)
    out = np.empty((steps + 1, n), dtype=np.int32)
    _, now = np.unique(block, return_inverse=True)
    now = now.astype(np.int32)
    fresh = int(now.max(initial=-1)) + 1
    out[0] = now
    size = np.bincount(now, minlength=fresh)
    live = np.flatnonzero(size[now] > 1)
    for k in range(steps):
        now = now.copy()
        if len(live):
            sym = symbols[live, k]
            ended = sym < 0
            gone = live[ended]
            now[gone] = fresh + np.arange(len(gone), dtype=np.int32)
            fresh += len(gone)
            live, sym = live[~ended], sym[~ended].astype(np.int64)
            keys, inverse, count = np.unique(now[live].astype(np.int64) * 256 + sym, return_inverse=True, return_counts=True)
            now[live] = fresh + inverse.astype(np.int32)
            fresh += len(keys)
            live = live[count[inverse] > 1]
        out[k + 1] = now
    return out


def padded(parts: list[bytes], width: int) -> np.ndarray:
    out = np.full((len(parts), width), -1, dtype=np.int16)
    for i, p in enumerate(parts):
        x = np.frombuffer(p[:width], dtype=np.uint8)
        out[i, : len(x)] = x
    return out


def repeated_windows(h: np.ndarray, before: list[bytes], after: list[bytes], span: int) -> np.ndarray:
    """rows x (span + 1): whether the window that reaches o bytes to the left of the row's
    minimizer, and span - o to the right of it, stands at another row too. before: what
    precedes the minimizer, backwards."""
    left, right = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    lb, rb = refined(h, padded(before, span), span), refined(h, padded(after, span), span)
    out = np.zeros((len(h), span + 1), dtype=bool)
    for o in range(span + 1):
        own = np.flatnonzero((left >= o) & (right >= span - o))
        if len(own):
            key = lb[o][own].astype(np.int64) << 32 | rb[span - o][own]
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            out[own, o] = count[inverse] > 1
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows as disjoint runs, touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(first)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


# ---- dataflow ----------------------------------------------------------------------


def _pack(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return at << 20 | left << 10 | right


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 20, p >> 10 & 1023, p & 1023


def _seed_rows(src: DataFrame, length: int, k: int, counted: bool) -> DataFrame:
    """(h, rest, k1, k2, at): a row for each minimizer; or, counted, (h, least, most, n):
    for each that an Arrow batch holds, its number of places and its regions' extremes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [(i, *seeds(as_bytes(t), length, k)) for i, t in enumerate(b["t"])]
            parts = [p for p in parts if len(p[1])]
            if not parts:
                continue
            h, rest = (np.concatenate([p[i] for p in parts]).view(np.int64) for i in (1, 2))
            if counted:
                order = np.lexsort((rest, h))
                h, rest = h[order], rest[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n = np.diff(np.append(first, len(h)))
                yield pd.DataFrame({"h": h[first], "least": rest[first], "most": rest[first + n - 1], "n": n})
            else:
                at = np.concatenate([_pack(*p[3:]) for p in parts])
                row = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                yield pd.DataFrame({"h": h, "rest": rest, "k1": b["k1"].to_numpy()[row], "k2": b["k2"].to_numpy()[row], "at": at})

    return src.mapInPandas(rows, "h long, least long, most long, n long" if counted else "h long, rest long, k1 long, k2 long, at long")


def _squeezed(src: DataFrame) -> DataFrame:
    """(k1, k2, z): texts compressed for an exchange."""

    def run(texts: list) -> list[list]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        return [[c.compress(as_bytes(t)) for t in texts]]

    return add_columns(src, ["t"], run, {"z": "binary"}, without=("t",))


def _raw(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def repeats(src: DataFrame, length: int, k: int, group: int) -> DataFrame:
    """(k1, k2, start, end): stretches whose every window of ``length`` bytes is repeated.
    src: (k1, k2, t)."""
    span, key = length - k, ["k1", "k2"]
    # Minimizers of several places; mixed ones have different regions.
    several = _seed_rows(src, length, k, True).groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    several = written(several.where("n > 1").select("h", (F.col("least") != F.col("most")).alias("mixed")), "minimizers")
    found = written(_seed_rows(src, length, k, False).join(several, "h"), "regions")
    kinds = found.groupBy("h", "rest", "mixed").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*key, "at")).alias("rep"))
    kinds = written(kinds.select("h", "rest", "mixed", "n", "rep.*"), "kinds")
    # Whole regions that occur twice.
    whole = spread_join(found.drop("mixed"), kinds.where("n > 1").select("h", "rest", "n"), ["h", "rest"], found.count()).select(*key, "at")
    first = F.shiftright("at", 20) - F.shiftright("at", 10).bitwiseAND(1023)
    whole = whole.select(*key, first.alias("start"), (F.shiftright("at", 20) + k + F.col("at").bitwiseAND(1023)).alias("end"))
    # Regions that share their minimizer with other ones, if some of them occur once.
    blocks = kinds.where("mixed").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("rarest")).where("rarest = 1")
    rows = kinds.where("mixed").select("h", *key, "at", (F.col("n") == 1).alias("open"))
    asked = spread_join(rows, blocks.select("h", "n", (F.col("n") > group).alias("large")), "h", kinds.count())
    asked = asked.groupBy(*key).agg(F.collect_list(F.struct("h", "at", "open", "large")).alias("asked"))

    def context(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k1, k2, z, own in zip(b["k1"], b["k2"], b["z"], b["asked"], strict=True):
                raw = _raw(z)
                for r in own:
                    at, left, right = (int(x) for x in _unpack(r["at"]))
                    out.append((r["h"], k1, k2, at, r["open"], r["large"], raw[at - left : at][::-1], raw[at + k : at + k + right]))
            if out:
                yield pd.DataFrame(out, columns=["h", "k1", "k2", "at", "open", "large", "before", "after"])

    schema = "h long, k1 long, k2 long, at long, open boolean, large boolean, before binary, after binary"
    rows = written(asked.join(_squeezed(src), key).select(*key, "z", "asked").mapInPandas(context, schema), "contexts")
    small, large = rows.where("NOT large").drop("large"), rows.where("large")
    tasks = max(1, -(-small.count() // TASK_ROWS))

    def spans_of(b: pd.DataFrame, hit: np.ndarray) -> pd.DataFrame:
        i, o = np.nonzero(hit & b["open"].to_numpy(bool)[:, None])
        start = b["at"].to_numpy()[i] - o
        # Windows of a row that follow each other are one stretch.
        order = np.lexsort((start, i))
        i, start = i[order], start[order]
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (start[1:] != start[:-1] + 1)])) if len(i) else i
        return pd.DataFrame({"k1": b["k1"].to_numpy()[i[new]], "k2": b["k2"].to_numpy()[i[new]], "start": start[new], "end": start[np.append(new[1:], len(i)) - 1] + length if len(i) else start})

    def refine(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("h", kind="stable")
        ends = np.flatnonzero(np.append(b["h"].to_numpy()[1:] != b["h"].to_numpy()[:-1], True)) + 1
        out, at = [], 0
        while at < len(b):
            end = int(ends[max(np.searchsorted(ends, at + AT_ONCE, side="right") - 1, np.searchsorted(ends, at, side="right"))])
            part = b.iloc[at:end]
            out.append(spans_of(part, repeated_windows(part["h"].to_numpy(), part["before"].to_list(), part["after"].to_list(), span)))
            at = end
        return pd.concat(out)

    part = small.groupBy(F.pmod(F.xxhash64("h"), F.lit(tasks))).applyInPandas(refine, "k1 long, k2 long, start long, end long")
    return whole.unionByName(part).unionByName(_large_blocks(large, length, span))


def _large_blocks(rows: DataFrame, length: int, span: int) -> DataFrame:
    """The same as refinement for blocks that don't fit a task: windows by hash."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, k1, k2, at, open_, before, after in zip(*(b[c] for c in ("h", "k1", "k2", "at", "open", "before", "after")), strict=True):
                o = np.arange(max(0, span - len(after)), min(span, len(before)) + 1)
                if len(o):
                    x, y = Rolling(before), Rolling(after)
                    zero = np.zeros_like(o)
                    a, c = x.hashes(zero, o), y.hashes(zero, span - o)
                    yield pd.DataFrame({"w1": mix64(a + c * U64(3) + U64(h & (1 << 63) - 1) + o.astype(np.uint64)).view(np.int64), "w2": mix64(c + a * U64(5)).view(np.int64), "k1": k1, "k2": k2, "start": at - o, "open": open_})

    w = rows.select("h", "k1", "k2", "at", "open", "before", "after").mapInPandas(windows, "w1 long, w2 long, k1 long, k2 long, start long, open boolean")
    hot = w.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return w.where("open").join(hot, ["w1", "w2"], "left_semi").select("k1", "k2", "start", (F.col("start") + length).alias("end"))


def cut_repeats(docs: DataFrame, *, length: int = LENGTH, k: int = SEED, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, removed (array of (start, end) byte runs) and kept (binary: the
    bytes that stay)."""
    if not 0 < length - k < 1024:
        raise ValueError("length must exceed k by 1 to 1023")
    id_col, text_col = column_of(docs, id_col), column_of(docs, text_col)
    small_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "removed", "kept")
    keys = ["_lexloom_k1", "_lexloom_k2"]
    keyed = docs.withColumns(dict(zip(keys, row_keys(id_col, text_col), strict=True)))
    src = keyed.select(*[F.col(c).alias(c[-2:]) for c in keys], F.col(text_col).alias("t")).where("t IS NOT NULL")
    spans = repeats(src, length, k, group).distinct()
    own = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("_lexloom_spans")).toDF(*keys, "_lexloom_spans")

    def cut(texts: list, spans: list) -> list[list]:
        n, removed, kept = [], [], []
        for t, s in zip(texts, spans, strict=True):
            raw = as_bytes(t)
            runs = merged(np.array([(x["start"], x["end"]) for x in s or ()], dtype=np.int64).reshape(-1, 2))
            n.append(len(raw))
            removed.append([{"start": a, "end": b} for a, b in runs.tolist()])
            at, parts = 0, []
            for a, b in runs.tolist():
                parts.append(raw[at:a])
                at = b
            kept.append(b"".join([*parts, raw[at:]]))
        return [n, removed, kept]

    out = add_columns(keyed.join(own, keys, "left").drop(*keys), [text_col, "_lexloom_spans"], cut, {"n_bytes": "long", "removed": "array<struct<start:long,end:long>>", "kept": "binary"})
    return out.drop("_lexloom_spans")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    cut = cut_repeats(docs)
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
