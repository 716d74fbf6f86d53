"""Language identification in two levels.

Texts become hashed character n-gram profiles. Linear support vector machines tell the
language families apart (one against the rest); within the predicted family, one linear
machine for each pair of its languages votes, so closely related languages are separated
by machines that see nothing else.

The machines are fitted on a bounded sample, the same share of each language, chosen by
a hash of the text: SAMPLE_ROWS rows at most, or one of each language if those are more.
Prediction reads whole texts.

Defined cases: ``und`` with score 0 for null texts and texts without a letter; rows
without a language, an id or a letter aren't learned from; with one language, it is
predicted throughout, and with none, ``und``; languages that FAMILIES doesn't name are a
family each; an empty table gives an empty table; repeated rows get the same result;
other columns pass through, and one named like an output column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm._common import add_columns, column_of, documents, hash_below, share_for, small_batches

#: Languages by family (ISO 639-1).
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr"],
    "indic": ["hi", "ur", "bn", "mr", "ne", "gu", "pa"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
}
DIMS = 4096
GRAMS = (1, 2, 3, 4)
#: Labelled rows that the machines are fitted on, all languages together.
SAMPLE_ROWS = 4000

LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters count as spaces.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def profile(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, of length 1."""
    x = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", dtype=np.uint8).astype(np.uint32)
    counts, h = np.zeros(DIMS), np.zeros(len(x), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(counts)
    return (out / np.linalg.norm(out)).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Linear machine (squared hinge, L2), by accelerated gradient; y is 1 or -1. The
    last weight is the bias. Classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    w = np.zeros(x.shape[1], dtype=x.dtype)
    z, t = w, 1.0
    rate = x.dtype.type(1 / (1 + 4 * c))
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (z - 2 * c * (x.T @ (weight * gap * y)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + x.dtype.type((t - 1) / t2) * (new - w), new, t2
    return w


class Model:
    """Machines of both levels; weights stand in the rows of one matrix."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = {lang: f for f, own in FAMILIES.items() for lang in own}
        self.langs = sorted(set(langs))
        fam = np.array([family.get(a, a) for a in langs])
        self.families = sorted(set(fam))
        self.members = {f: sorted(set(langs[fam == f])) for f in self.families}
        rows: list[np.ndarray] = []
        self.family_row: dict[str, int] = {}
        for f in self.families if len(self.families) > 1 else []:
            self.family_row[f] = len(rows)
            rows.append(fit_svm(x, np.where(fam == f, 1, -1).astype(x.dtype)))
        self.pair_row: dict[tuple[str, str], int] = {}
        for own in self.members.values():
            for a, b in combinations(own, 2):
                at = (langs == a) | (langs == b)
                self.pair_row[a, b] = len(rows)
                rows.append(fit_svm(x[at], np.where(langs[at] == a, 1, -1).astype(x.dtype)))
        self.w = np.stack(rows) if rows else np.zeros((0, x.shape[1] + 1), dtype=np.float32)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        m = self.w[:, :-1] @ x + self.w[:, -1]
        sure = lambda v: float(1 / (1 + np.exp(-4 * v)))
        best, score = self.families[0], 1.0
        if self.family_row:
            best = max(self.families, key=lambda f: m[self.family_row[f]])
            score = sure(m[self.family_row[best]])
        own = self.members[best]
        votes = {a: (0, 0.0, 1.0) for a in own}
        for a, b in combinations(own, 2):
            v = float(m[self.pair_row[a, b]])
            for lang, s in ((a, v), (b, -v)):
                n, total, least = votes[lang]
                votes[lang] = (n + (s > 0), total + s, min(least, sure(s)))
        lang = max(own, key=lambda k: (votes[k][:2], k))
        return lang, round(score * votes[lang][2], 6)


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Model from rows with a language and a letter; None if there is none."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where("lang IS NOT NULL AND t IS NOT NULL").where(F.col("t").rlike(r"\p{L}"))
    # Distinct texts of each language: copies must not make the share smaller.
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("t")).alias("n")).collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    # Of each language the lowest hashes, copies once: first a share that holds about four
    # times as many as asked for, so that few rows are brought together to be cut.
    shares = train.sparkSession.createDataFrame([(k, share_for(each, n)) for k, n in sorted(counts.items())], "lang string, share double")
    some = rows.join(F.broadcast(shares), "lang").where(hash_below(F.col("t"), F.col("share")))
    once = some.groupBy("lang", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"))
    picked = once.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= each)

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "x": [profile(t).tobytes() for t in b["t"]]})

    got = picked.select("lang", "t").mapInPandas(profiles, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got])
    return Model(x, np.array([r["lang"] for r in got]))


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list[list]:
        m = held.value
        got = [m.predict(profile(t)) if m is not None and has_letter(t) else ("und", 0.0) for t in texts]
        return [[a for a, _ in got], [s for _, s in got]]

    return add_columns(docs, [column_of(docs, text_col)], run, {"lang_pred": "string", "score": "double"})


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id") != 2))
    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
