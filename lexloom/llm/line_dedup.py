"""Line dedup: lines that occur in many documents go.

Distinct line hashes are counted over all documents. Those that reach the threshold
are dealt to shards by hash; each shard builds a minimal perfect hash that indexes a
compact fingerprint array and a count array. Documents probe these arrays; no line
text is joined or shuffled.

The perfect hash holds the keys that reach the threshold, so its arrays follow the
number of repeated lines; a key outside it fails the 64-bit fingerprint.

Defined cases: every row is one document, repeated rows and rows with a null or
repeated id too; a null text is one empty line and stays null; empty keys are kept
unless ``min_chars`` is 0; an empty table gives an empty table; other columns pass
through, and one named like an output column gives way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import add_columns, column_of, documents, mix64, small_batches, written

WHITE = b" \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS = 10, 1
#: Keys per shard that the shard count aims at.
SHARD_KEYS = 1 << 18
#: Arrays up to this size are broadcast; beyond it hashes travel to the shards.
BROADCAST_BYTES = 48 << 20
#: Mean keys per displacement bucket of the perfect hash.
LOAD = 4


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Raw lines and their keys (stripped, A-Z lowered) as UTF-8."""
    raw = (b"" if text is None else text.encode("utf-8", "surrogatepass")).split(b"\n")
    return raw, [x.strip(WHITE).lower() for x in raw]


def n_chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def hash128(keys: list[bytes]) -> np.ndarray:
    """n x 2 signed 64-bit words."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), dtype="<i8").reshape(-1, 2)


# ---- minimal perfect hash (hash, displace, compact ranks) ---------------------


def _slots(a: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)


def build_mph(h: np.ndarray) -> np.ndarray:
    """Seeds (one for each bucket) that send the n distinct 64-bit keys h to 0..n-1
    without collision. Buckets are placed from the largest to the smallest."""
    h = h.view(np.uint64)
    n = len(h)
    m = max(1, -(-n // LOAD))
    seeds = np.zeros(m, dtype=np.uint32)
    if not n:
        return seeds
    bucket = (mix64(h) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(m + 1))
    taken = np.zeros(n, dtype=bool)
    for b in np.argsort(-(starts[1:] - starts[:-1]), kind="stable"):
        own = h[order[starts[b] : starts[b + 1]]]
        if not len(own):
            break
        first, width = 1, 64
        while True:
            tries = np.arange(first, first + width, dtype=np.uint64)
            slots = _slots(own[None, :], tries[:, None], n).astype(np.int64)
            free = ~taken[slots].any(axis=1)
            if len(own) > 1:
                s = np.sort(slots, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if free.any():
                k = int(np.argmax(free))
                taken[slots[k]] = True
                seeds[b] = first + k
                break
            first, width = first + width, min(width * 2, 1 << 14)
    return seeds


def mph_slot(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    h = h.view(np.uint64)
    return _slots(h, seeds[(mix64(h) % np.uint64(len(seeds))).astype(np.int64)], n).astype(np.int64)


class Shard:
    """Arrays of one shard: seeds, fingerprints (the second 64 bits of a key's hash),
    counts; keys whose first 64 bits coincide stand aside in ``extra``."""

    def __init__(self, seeds: bytes, prints: bytes, counts: bytes, extra: bytes):
        self.seeds = np.frombuffer(seeds, dtype=np.uint32)
        self.prints = np.frombuffer(prints, dtype=np.uint64)
        self.counts = np.frombuffer(counts, dtype=np.int64)
        self.extra = np.frombuffer(extra, dtype=np.int64).reshape(-1, 3)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Counts of n x 2 hashes; 0 for keys outside the shard."""
        n, out = len(self.prints), np.zeros(len(h), dtype=np.int64)
        if n and len(h):
            slot = mph_slot(np.ascontiguousarray(h[:, 0]), self.seeds, n)
            out = np.where(self.prints[slot] == np.ascontiguousarray(h[:, 1]).view(np.uint64), self.counts[slot], 0)
        for h1, h2, c in self.extra:
            out[(h[:, 0] == h1) & (h[:, 1] == h2)] = c
        return out


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return ((h1.view(np.uint64) >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


# ---- dataflow ------------------------------------------------------------------


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int, text_col: str) -> DataFrame:
    """(h1, h2, n): keys in at least min_docs documents. Keys are distinct within a
    document and summed in part before the exchange, so a hot line costs a task one row."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[bytes, int] = {}
            for t in b["_t"]:
                for k in set(line_keys(t)[1]):
                    seen[k] = seen.get(k, 0) + 1
            ks = [k for k in seen if n_chars(k) >= min_chars]
            h = hash128(ks)
            yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "n": np.array([seen[k] for k in ks], dtype=np.int64)})

    small_batches(docs.sparkSession)
    lines = docs.select(F.col(text_col).alias("_t")).mapInPandas(keys, "h1 long, h2 long, n long")
    return lines.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard that has keys. ``load`` is how many probes of
    its own lines a shard has to expect."""

    def build(k: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["h1", "h2"])
        twin = b["h1"].duplicated(keep=False)
        extra = b.loc[twin, ["h1", "h2", "n"]].to_numpy(dtype=np.int64)
        b = b.loc[~twin]
        h = b["h1"].to_numpy()
        seeds = build_mph(h)
        slot = mph_slot(h, seeds, len(h)) if len(h) else h
        prints, counts = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64)
        prints[slot], counts[slot] = b["h2"].to_numpy().view(np.uint64), b["n"].to_numpy()
        row = {"shard": k[0], "load": int(b["n"].sum()), "seeds": seeds.tobytes(), "prints": prints.tobytes(), "counts": counts.tobytes(), "extra": extra.tobytes()}
        return pd.DataFrame([row])

    at = F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)).cast("int")
    return keys.groupBy(at.alias("shard")).applyInPandas(build, "shard int, load long, seeds binary, prints binary, counts binary, extra binary")


def _hits(text: str | None, min_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines, the places of those long enough to be looked up, and their hashes."""
    raw, keys = line_keys(text)
    at = np.array([i for i, k in enumerate(keys) if n_chars(k) >= min_chars], dtype=np.int64)
    return raw, at, hash128([keys[i] for i in at])


def _without(raw: list[bytes], drop: np.ndarray) -> str:
    gone = set(drop.tolist())
    return b"\n".join(x for i, x in enumerate(raw) if i not in gone).decode("utf-8", "surrogatepass")


def drop_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with repeated lines taken out of ``text_col``, and n_lines (before) and
    n_dropped. A null text stays null and counts as one empty line."""
    spark, text_col = docs.sparkSession, column_of(docs, text_col)
    keys = written(repeated_lines(docs, min_docs, min_chars, text_col), "lines")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    arrays = written(build_shards(keys, shards), "line-shards")
    size = F.sum(sum(F.length(c) for c in ("seeds", "prints", "counts", "extra")))
    if (arrays.agg(size).first()[0] or 0) > broadcast_bytes:
        return _probe_by_shard(docs, arrays, shards, min_chars, text_col)
    held = spark.sparkContext.broadcast({r["shard"]: (bytes(r["seeds"]), bytes(r["prints"]), bytes(r["counts"]), bytes(r["extra"])) for r in arrays.collect()})

    def probe(texts: list) -> list[list]:
        index = {k: Shard(*v) for k, v in held.value.items()}
        out, n_lines, n_dropped = [], [], []
        for t in texts:
            raw, at, h = _hits(t, min_chars)
            n = np.zeros(len(at), dtype=np.int64)
            shard = shard_of(np.ascontiguousarray(h[:, 0]), shards)
            for k in np.unique(shard):
                if k in index:
                    n[shard == k] = index[k].probe(h[shard == k])
            drop = at[n >= min_docs]
            out.append(t if t is None or not len(drop) else _without(raw, drop))
            n_lines.append(len(raw))
            n_dropped.append(len(drop))
        return [out, n_lines, n_dropped]

    return add_columns(docs, [text_col], probe, {text_col: "string", "n_lines": "long", "n_dropped": "long"})


#: Probes that one task takes at a time where arrays are too large to broadcast.
PROBES = 1 << 20


def _probe_by_shard(docs: DataFrame, arrays: DataFrame, shards: int, min_chars: int, text_col: str) -> DataFrame:
    """For arrays beyond the broadcast bound: hashes go to the shards and the places of
    dropped lines come back. A shard that expects many probes (it holds a hot line) is
    copied to as many salts as keep a group small; only these counts are broadcast."""
    spark = docs.sparkSession
    text = F.col(text_col)
    total = docs.select(F.sum(F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"))) + 1)).first()[0] or 0
    each = total // shards
    salts = spark.sparkContext.broadcast({r["shard"]: 1 + (r["load"] + each) // PROBES for r in arrays.select("shard", "load").toLocalIterator()})
    # Two hashes of a text: where one coincides, the other doesn't.
    key = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(1), text))]))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in zip(b["_k"], b["_t"], strict=True):
                _, at, h = _hits(t, min_chars)
                shard = shard_of(np.ascontiguousarray(h[:, 0]), shards)
                salt = [(zlib.crc32(k) + int(i)) % salts.value.get(int(s), 1) for s, i in zip(shard, at, strict=True)]
                yield pd.DataFrame({"shard": shard, "salt": np.array(salt, dtype=np.int32), "_k": [k] * len(at), "line": at, "h1": h[:, 0], "h2": h[:, 1]})

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(salt=[range(salts.value.get(s, 1)) for s in b["shard"]])
            yield b.explode("salt").astype({"salt": "int32"})[["shard", "salt", "seeds", "prints", "counts", "extra"]]

    def look(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_k": pd.Series(dtype="object"), "line": pd.Series(dtype="int64")})
        n = Shard(*b.iloc[0][["seeds", "prints", "counts", "extra"]]).probe(a[["h1", "h2"]].to_numpy())
        return a.loc[n > 0, ["_k", "line"]]

    probes = docs.select(key.alias("_k"), text.alias("_t")).dropDuplicates(["_k"]).mapInPandas(lines, "shard int, salt int, _k binary, line long, h1 long, h2 long")
    tables = arrays.mapInPandas(copies, "shard int, salt int, seeds binary, prints binary, counts binary, extra binary")
    hit = probes.groupBy("shard", "salt").cogroup(tables.groupBy("shard", "salt")).applyInPandas(look, "_k binary, line long")
    drops = hit.groupBy("_k").agg(F.collect_list("line").alias("_lexloom_drop"))
    joined = docs.withColumn("_lexloom_k", key).join(drops.withColumnRenamed("_k", "_lexloom_k"), "_lexloom_k", "left").drop("_lexloom_k")

    def cut(texts: list, drop: list) -> list[list]:
        raw = [line_keys(t)[0] for t in texts]
        return [[t if t is None or not d else _without(r, np.array(d)) for t, r, d in zip(texts, raw, drop, strict=True)], [len(r) for r in raw], [len(d or ()) for d in drop]]

    out = {text_col: "string", "n_lines": "long", "n_dropped": "long"}
    return add_columns(joined, [text_col, "_lexloom_drop"], cut, out).drop("_lexloom_drop")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", kept)


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' 	

'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
hot AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN hot h USING (key) GROUP BY doc_id
"""
