"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each text. Their votes over all
documents are counted by pattern; expectation-maximisation over these counts estimates
how each labeller votes on good and on bad texts, without any gold label. The posterior
of a text's pattern is its label for a linear scorer over hashed features, which is
fitted on all distinct texts and then scores whole texts. The scorer doesn't see what the
labellers measure: its features are n-grams of the text's shape and the distances between a
word's places. It keeps texts from the score that the posteriors of all distinct texts expect
the fewest mistakes of.

The fit starts from that of TRAIN_ROWS texts and goes on by limited-memory BFGS, each round's
loss and gradient coming from one pass of tasks over all texts. The objective is strictly
convex, so the end doesn't depend on the start; rounds go on until the weights are within
TOLERANCE of it, which the gradient's length bounds.

Defined cases: null texts and texts without a word have score 0 and are rejected; with
no text to learn from, all others have score 1; repeated rows get the same result; an
empty table gives an empty table; other columns pass through, and one named like an
output column gives way to it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import add_columns, as_bytes, column_of, documents, forget, share_for, small_batches, written

#: Texts that the fit starts from, and hashed features.
TRAIN_ROWS, DIMS = 4000, 4096
#: Distance from the best weights at which rounds end, and steps that a round looks back on.
TOLERANCE, MEMORY = 1e-4, 12
#: Tasks of a round at most: each sends a gradient of DIMS values to the driver.
ROUND_TASKS = 256
#: Bins of scores, between which texts are parted.
BINS = 1 << 16
#: Weight of the words' distances beside the shape's n-grams.
GAPS = 1.0
#: Share of the texts by which the expected mistakes may exceed the fewest.
SLACK = 0.002

_SYMBOLS = b"!#$%&*+<=>@[]^_`{|}~"
_SHAPE = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if b >= 128 or 97 <= b <= 122 else ord("0") if 48 <= b <= 57 else ord(" ") if b in b"\t\x0b\x0c\r" else b for b in range(256)
)


class Traits:
    """What the labellers look at, and the shape and words that the scorer's features are of."""

    def __init__(self, text: str | None):
        raw = as_bytes(text)
        self.raw, self.words = raw, raw.split()
        self.n = len(self.words)
        if not self.n:
            return
        shape = raw.translate(_SHAPE)
        self.shape = shape
        upper, lower = shape.count(b"A"), shape.count(b"a")
        self.letters = upper + lower
        self.upper = upper / max(1, self.letters)
        # Longest first: what is left after taking symbols out tells their number.
        self.symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / max(1, len(raw) - raw.count(b" "))
        self.alpha = self.letters / max(1, len(raw) - raw.count(b" "))
        counts = Counter(self.words)
        self.distinct = len(counts) / self.n
        self.top = max(counts.values()) / self.n
        self.again = sum(a == b for a, b in zip(self.words, self.words[1:], strict=False)) / self.n
        self.alone = sum(v for w, v in counts.items() if not w.translate(None, _SYMBOLS)) / self.n
        lines = [x for x in raw.split(b"\n") if x.strip()]
        self.copied = 1 - len(set(lines)) / max(1, len(lines))
        self.stops = raw.count(b".") + raw.count(b"?") + raw.count(b"!") - 2 * raw.count(b"!!")
        self.word_bytes = sum(map(len, self.words)) / self.n


def _between(x: float, good: float, bad: float) -> int:
    """1 on the good side, 0 on the bad, -1 between: abstains."""
    if good < bad:
        return 1 if x <= good else 0 if x >= bad else -1
    return 1 if x >= good else 0 if x <= bad else -1


#: Labellers: name and vote (1 good, 0 bad, -1 none). Those about repetition and sentences
#: abstain on texts too short to tell.
LABELLERS = [
    ("symbols", lambda t: _between(t.symbols, 0.02, 0.08)),
    ("capitals", lambda t: _between(t.upper, 0.2, 0.5)),
    ("separators", lambda t: _between(t.alone, 0.01, 0.15)),
    ("letters", lambda t: _between(t.alpha, 0.88, 0.7)),
    ("top word", lambda t: _between(t.top, 0.15, 0.3) if t.n >= 20 else -1),
    ("distinct words", lambda t: _between(t.distinct * min(1, (t.n / 200) ** 0.3), 0.25, 0.12) if t.n >= 20 else -1),
    ("word again", lambda t: _between(t.again, 0.02, 0.15) if t.n >= 10 else -1),
    ("copied lines", lambda t: _between(t.copied, 0.2, 0.5) if t.raw.count(b"\n") >= 4 else -1),
    ("sentences", lambda t: _between(t.stops / t.n, 0.02, 0.004) if t.n >= 40 else -1),
    ("word length", lambda t: 1 if 3 <= t.word_bytes <= 12 else 0 if not 2 <= t.word_bytes <= 18 else -1),
]


def votes(t: Traits) -> tuple[int, ...]:
    return tuple(f(t) for _, f in LABELLERS)


class LabelModel:
    """Class-conditional vote rates of each labeller, by expectation-maximisation over
    counted patterns. Abstaining says nothing about the class."""

    def __init__(self, patterns: dict[tuple[int, ...], int], rounds: int = 100):
        self.known = list(patterns)
        v = np.array(self.known, dtype=np.int64).reshape(len(self.known), -1)
        n = np.array([patterns[p] for p in self.known], dtype=float)
        good, bad = (v == 1).sum(axis=1), (v == 0).sum(axis=1)
        p = np.clip(np.where(bad > 0, 0.5 * good / np.maximum(1, good + bad), 0.95), 0.05, 0.95)
        for _ in range(rounds if len(v) else 0):
            self.prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
            # Rates of a good vote, on good texts (at least 1/2) and on bad ones; two
            # votes of either kind are presumed.
            self.rate = []
            for y, mean in ((p, 0.9), (1 - p, 0.4)):
                w = (n * y)[:, None]
                self.rate.append(((w * (v == 1)).sum(axis=0) + 4 * mean) / ((w * (v >= 0)).sum(axis=0) + 4))
            self.rate[0] = np.maximum(self.rate[0], 0.5)
            self.rate[1] = np.minimum(self.rate[1], self.rate[0])
            p = self._posterior(v)
        self.p = dict(zip(self.known, p, strict=True))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior))
        g, b = self.rate
        part = np.where(v == 1, np.log(g / b), np.where(v == 0, np.log((1 - g) / (1 - b)), 0.0))
        return 1 / (1 + np.exp(-np.clip(odds + part.sum(axis=1), -30, 30)))


class Sparse:
    """Rows of (places, values), held one after another."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n, sizes = len(rows), [len(at) for at, _ in rows]
        self.starts = np.cumsum([0, *sizes])
        self.at = np.concatenate([at for at, _ in rows])
        self.x = np.concatenate([x for _, x in rows])
        # So many values at a time that what is made of them stays small.
        self.cuts = [0, *(int(i) for i in np.searchsorted(self.starts, np.arange(CHUNK, self.starts[-1], CHUNK))), self.n]

    def __len__(self) -> int:
        return self.n

    def _parts(self):
        for lo, hi in zip(self.cuts, self.cuts[1:], strict=False):
            if lo < hi:
                yield lo, hi, slice(self.starts[lo], self.starts[hi])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(self.n)
        for lo, hi, own in self._parts():
            out[lo:hi] = np.add.reduceat(self.x[own] * w[self.at[own]], self.starts[lo:hi] - self.starts[lo])
        return out

    def sum(self, weights: np.ndarray) -> np.ndarray:
        """Rows times weights, added up."""
        out = np.zeros(DIMS)
        for lo, hi, own in self._parts():
            each = np.repeat(weights[lo:hi], np.diff(self.starts[lo : hi + 1]))
            out += np.bincount(self.at[own], weights=self.x[own] * each, minlength=DIMS)
        return out


#: Values of sparse rows that are multiplied at a time.
CHUNK = 1 << 18


def features(t: Traits) -> tuple[np.ndarray, np.ndarray]:
    """(places, values), of length 1: hashed n-grams of the text's shape (letters by case,
    digits, each mark), and of how long ago each word stood in the text before."""
    x = np.frombuffer(t.shape, dtype=np.uint8).astype(np.uint32)
    counts, h = np.zeros(DIMS), np.zeros(len(x), dtype=np.uint32)
    for n in (1, 2, 3, 4):
        if len(x) >= n:
            h = h[: len(x) - n + 1] * np.uint32(0x01000193) + x[n - 1 :] + np.uint32(n)
            counts += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMS)
    out = np.sqrt(counts)
    out /= np.linalg.norm(out)
    # Distances to a word's last place by powers of two; 0: it wasn't there.
    word = np.fromiter(map(hash, t.words), dtype=np.int64, count=t.n)
    order = np.argsort(word, kind="stable")
    same = word[order[1:]] == word[order[:-1]]
    ago = np.zeros(t.n, dtype=np.int64)
    ago[order[1:][same]] = np.log2((order[1:] - order[:-1])[same]).astype(np.int64) + 1
    for k, share in enumerate(np.sqrt(np.bincount(ago) / t.n)):
        out[(0x9E37 * (k + 1)) % DIMS] += GAPS * share
    at = np.flatnonzero(out)
    x = out[at]
    return at.astype(np.uint16), (x / np.linalg.norm(x)).astype(np.float32)


def _packed(row: tuple[np.ndarray, np.ndarray]) -> bytes:
    return zlib.compress(row[0].tobytes() + row[1].tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    n = len(raw) // 6
    return np.frombuffer(raw[: 2 * n], dtype=np.uint16), np.frombuffer(raw[2 * n :], dtype=np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shares(p: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Weights of texts, by the sums of p and of 1 - p over all: good and bad weigh the same."""
    return (p / max(1e-9, good) + (1 - p) / max(1e-9, bad)) / ((good > 0) + (bad > 0))


def _loss_gradient(x: Sparse, p: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    z = x.dot(w) + w[-1]
    gap = weight * (_sigmoid(z) - p)
    return float((weight * (np.logaddexp(0, z) - p * z)).sum()), np.append(x.sum(gap), gap.sum())


def fit_logistic(x: Sparse, p: np.ndarray, c: float = 1000.0, steps: int = 400) -> np.ndarray:
    """Weights and bias of a logistic scorer for soft labels p, by accelerated gradient.
    Good and bad weigh the same."""
    weight = _shares(p, p.sum(), (1 - p).sum())
    w = z = np.zeros(DIMS + 1)
    rate, t = 1 / (1 + c * 0.5), 1.0
    for _ in range(steps):
        new = z - rate * (z + c * _loss_gradient(x, p, weight, z)[1])
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit_all(start: np.ndarray, ask, c: float = 1000.0) -> np.ndarray:
    """start improved until it is within TOLERANCE of the best weights; ask(w) gives the loss
    of all texts and its gradient."""

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, g = ask(w)
        return 0.5 * w @ w + c * loss, w + c * g

    w, (f, g), past = start, objective(start), []
    # The objective is 1-strongly convex: its gradient is no shorter than the distance.
    while np.linalg.norm(g) > TOLERANCE:
        d, scale = -g, []
        for s, y in reversed(past):
            scale.append(s @ d / (s @ y))
            d = d - scale[-1] * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / (1 + c * 0.5))
        for (s, y), a in zip(past, reversed(scale), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        step = 1.0
        while True:
            new = w + step * d
            f2, g2 = objective(new)
            if f2 <= f + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 2
        if f2 >= f:  # as near as sums of floating numbers get
            break
        past = [*past, (new - w, g2 - g)][-MEMORY:]
        w, f, g = new, f2, g2
    return w


def least_score(scores: np.ndarray, p: np.ndarray, n: np.ndarray | None = None) -> float:
    """The score from which texts are kept: the lowest whose expected mistakes by the
    posteriors p (a good text lost, a bad one kept) are within SLACK of the texts of the
    fewest, since a text lost can't be made good later. n: how many texts a score stands for
    (else one each), whose posteriors' sum is p."""
    n = np.ones(len(scores)) if n is None else n
    order = np.argsort(scores, kind="stable")
    s, own, bad = scores[order], p[order], (n - p)[order]
    wrong = np.append(0, np.cumsum(own)) + np.append(np.cumsum(bad[::-1])[::-1], 0)
    cuts = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    # Equal scores can't be parted.
    apart = np.concatenate([[True], s[1:] > s[:-1], [True]])
    return float(cuts[np.flatnonzero(apart & (wrong <= wrong[apart].min() + SLACK * n.sum()))[0]])


class Scorer(NamedTuple):
    """Weights with a bias at the end, and the least score that is kept."""

    weights: np.ndarray
    keep: float

    def score(self, t: Traits) -> float:
        at, x = features(t)
        return float(1 / (1 + np.exp(-np.clip((x * self.weights[at]).sum() + self.weights[-1], -30, 30))))


def fit(docs: DataFrame, *, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Scorer | None:
    """The scorer; None if no text has a word."""
    spark, text_col = docs.sparkSession, column_of(docs, text_col)
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("t")).where("t IS NOT NULL").select("t", F.xxhash64("t").alias("h"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [(h, x) for h, x in zip(b["h"], map(Traits, b["t"]), strict=True) if x.n]
            if own:
                yield pd.DataFrame({"h": [h for h, _ in own], "v": [",".join(map(str, votes(x))) for _, x in own], "x": [_packed(features(x)) for _, x in own]})

    # A row for each distinct text: some hundred features of DIMS, 0.2 to 0.6 KB.
    seen = texts.mapInPandas(learn, "h long, v string, x binary").groupBy("h").agg(F.first("v").alias("v"), F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    seen = written(seen, "features")
    try:
        return _fit(seen, train_rows)
    finally:
        forget(seen)


def _fit(seen: DataFrame, train_rows: int) -> Scorer | None:
    """The scorer of distinct texts: (h, v, x, n), a text's hash, votes, features and number."""
    spark = seen.sparkSession
    # As many rows at most as there are patterns: 3 to the number of labellers.
    rows = seen.groupBy("v").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["v"])
    model = LabelModel({tuple(map(int, r["v"].split(","))): r["n"] for r in rows})
    known = {r["v"]: float(model.p[tuple(map(int, r["v"].split(",")))]) for r in rows}
    good, total = sum(known[r["v"]] * r["texts"] for r in rows), sum(r["texts"] for r in rows)
    # The lowest hashes, so that few rows are brought together to be cut.
    low = seen.where(F.col("h") / F.lit(2.0**64) + 0.5 < F.lit(share_for(train_rows, total)))
    got = sorted(low.orderBy("h").limit(train_rows).select("v", "x").collect(), key=lambda r: bytes(r["x"]))
    x, p = Sparse([_unpacked(r["x"]) for r in got]), np.array([known[r["v"]] for r in got])
    label = spark.sparkContext.broadcast(known)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Sparse, np.ndarray]]:
        for b in batches:
            if len(b):
                yield Sparse([_unpacked(r) for r in b["x"]]), np.array([label.value[v] for v in b["v"]])

    def ask(w: np.ndarray) -> tuple[float, np.ndarray]:
        held = spark.sparkContext.broadcast(w)

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, out = 0.0, np.zeros(DIMS + 1)
            for x, p in parts(batches):
                more, g = _loss_gradient(x, p, _shares(p, good, total - good), held.value)
                loss, out = loss + more, out + g
            yield pd.DataFrame({"loss": [loss], "g": [out.tobytes()]})

        sums = seen.select("v", "x").coalesce(ROUND_TASKS).mapInPandas(add, "loss double, g binary").collect()
        held.destroy()
        return sum(r["loss"] for r in sums), np.sum([np.frombuffer(r["g"]) for r in sums], axis=0)

    w = fit_all(fit_logistic(x, p), ask)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, good = np.zeros(BINS), np.zeros(BINS)
        for x, p in parts(batches):
            at = np.minimum(BINS - 1, _sigmoid(x.dot(w) + w[-1]) * BINS).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            good += np.bincount(at, weights=p, minlength=BINS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"at": at, "n": n[at], "p": good[at]})

    # BINS rows at most.
    cells = seen.select("v", "x").mapInPandas(binned, "at long, n double, p double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()
    at, n, p = (np.array([r[c] for r in cells], dtype=float) for c in ("at", "n", "p"))
    return Scorer(w, least_score((at + 0.5) / BINS, p, n))


def score_quality(docs: DataFrame, scorer: Scorer | None, *, text_col: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1) and quality_kept."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(texts: list) -> list[list]:
        own, scores, kept = held.value, [], []
        for t in map(Traits, texts):
            s = 0.0 if not t.n else 1.0 if own is None else own.score(t)
            scores.append(round(s, 6))
            kept.append(t.n > 0 and (own is None or s >= own.keep))
        return [scores, kept]

    return add_columns(docs, [column_of(docs, text_col)], run, {"quality_score": "double", "quality_kept": "boolean"})


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return score_quality(docs, fit(docs)).select("doc_id", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))
