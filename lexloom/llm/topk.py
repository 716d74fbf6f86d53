"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers; each block of rows is stored as bit slices: one
bitmap for each bit of each dimension, a bit for every row. A query is scored for all
rows of a block at once: the slices of a dimension, shifted by the set bits of the
query's component, go into columns of equal weight, and full adders (bitmap AND, OR,
XOR) reduce these columns to the slices of the score. The top rows are then selected
from the most significant slice downward; the rows that tie at the k-th score are told
apart by id. Scores are exact integers at every step, so no row is lost to rounding.

Queries and rows meet in cells of bounded size (a block of queries, a block of rows).
A cell returns k rows a query, which a window reduces to the k best; nothing unbounded
is broadcast or collected.

Defined cases: null vectors, vectors with null or non-finite components and null ids
take no part; vectors meet only vectors of their own length; a repeated id is a row of
its own, and a query never meets rows of its own id; an empty table gives an empty
result; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, QUERY_STEP, SCALE = 20, 20, 64
#: Rows and queries that meet in one cell.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 14, 1 << 9


class BitSlices:
    """Bit-sliced block of integer rows (n x d)."""

    def __init__(self, rows: np.ndarray):
        self.n, self.dims = rows.shape
        self.low = rows.min(axis=0)
        above = (rows - self.low).astype(np.uint64)
        self.bits = max(1, int(above.max(initial=0)).bit_length())
        self.words = -(-self.n // 64)
        flat = np.zeros((self.dims, self.bits, self.words * 64), dtype=np.uint8)
        for b in range(self.bits):
            flat[:, b, : self.n] = ((above >> np.uint64(b)) & np.uint64(1)).T
        self.slices = np.packbits(flat, axis=2, bitorder="little").view(np.uint64)
        self.inverse = ~self.slices
        self.valid = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)

    def score(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores, least significant first, and what to add to each score.
        A negative component adds the complement of its dimension, so every addend is
        at least 0."""
        top = (1 << self.bits) - 1
        base = sum(int(x) * int(lo) for x, lo in zip(q, self.low, strict=True)) + sum(int(x) * top for x in q if x < 0)
        columns: dict[int, list[np.ndarray]] = {}
        for sign, source in ((1, self.slices), (-1, self.inverse)):
            size = np.where(q * sign > 0, q * sign, 0)
            for j in range(int(size.max(initial=0)).bit_length()):
                dims = np.flatnonzero((size >> j) & 1)
                for b in range(self.bits if len(dims) else 0):
                    columns.setdefault(b + j, []).append(source[dims, b])
        return self._added(columns), base

    def _added(self, columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
        """Carry-save addition: full adders over a whole column at a time."""
        out, w = [], 0
        while columns:
            parts = columns.pop(w, [])
            if not parts:
                out.append(np.zeros(self.words, dtype=np.uint64))
                w += 1
                continue
            x = np.concatenate(parts) if len(parts) > 1 else parts[0]
            while len(x) > 1:
                t = len(x) // 3
                if t:
                    a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                    ab = a ^ b
                    columns.setdefault(w + 1, []).append((a & b) | (ab & c))
                    x = np.concatenate([ab ^ c, x[3 * t :]])
                else:
                    columns.setdefault(w + 1, []).append((x[0] & x[1])[None])
                    x = (x[0] ^ x[1])[None]
            out.append(x[0])
            w += 1
        return out

    def top(self, slices: list[np.ndarray], k: int, besides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the rows above the k-th score and of those that have it. besides:
        rows left out."""
        sure, open_ = np.zeros_like(self.valid), self.valid if besides is None else self.valid & ~besides
        for s in reversed(slices):
            ones = open_ & s
            if int(np.bitwise_count(sure | ones).sum()) >= k:
                open_ = ones
            else:
                sure, open_ = sure | ones, open_ & ~s
        return sure, open_

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def scores_at(slices: list[np.ndarray], base: int, rows: np.ndarray) -> np.ndarray:
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    return sum((((s[word] >> bit) & np.uint64(1)).astype(np.int64) << i for i, s in enumerate(slices)), np.zeros(len(rows), np.int64)) + base


def cell_top(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query of a block, ids ascending in ties."""
    rows = rows.sort_values("id", kind="stable")
    ids = rows["id"].to_numpy()
    index = BitSlices(np.stack(rows["v"].to_list()).astype(np.int64))
    out = []
    for qid, v in zip(queries["id"], queries["v"], strict=True):
        slices, base = index.score(np.asarray(v, dtype=np.int64))
        own = np.arange(index.words * 64, dtype=np.int64)
        lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, side="right")
        own = np.packbits((own >= lo) & (own < hi), bitorder="little").view(np.uint64) if hi > lo else None
        sure, edge = index.top(slices, k, own)
        sure, edge = index.rows(sure), index.rows(edge)
        best = np.concatenate([sure, edge[: max(0, k - len(sure))]])
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[best], "score": scores_at(slices, base, best)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def exact_top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors
    with another id and the largest inner product of floor(scale * component)."""

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vec_col)
        fit = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
        v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
        return df.where(fit).select(F.col(id_col).alias("id"), v.alias("v"), F.size(x).alias("dim"))

    rows, asked = whole(vectors), whole(queries)
    n_rows = max(1, -(-rows.count() // block_rows))
    n_queries = max(1, -(-asked.count() // block_queries))

    def block(salt: int, n: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    rows = rows.withColumn("rb", block(1, n_rows)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = asked.withColumn("qb", block(2, n_queries)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    cell = ["qb", "rb", "dim"]

    kind = rows.schema["id"].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) and len(b):
            return cell_top(a, b, k)
        return pd.DataFrame({"query_id": b["id"].iloc[:0], "vec_id": b["id"].iloc[:0], "score": np.zeros(0, np.int64)})

    best = asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInPandas(run, f"query_id {kind}, vec_id {kind}, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(v, v.where(F.col("vec_id") % QUERY_STEP == 0))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
