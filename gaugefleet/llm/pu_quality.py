"""Quality classifier by positive-unlabelled learning.

A small network over text measurements and hashed byte n-grams is fitted by the non-negative
unbiased risk: with class prior p, trusted positives P and unlabelled documents U,
``risk = p E_P[l(+g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])``, and when the second part falls below
zero its gradient is followed upwards instead. The prior comes from P and U alone: a first network
parts P from U, and the prior is the least ratio of the shares of held-back U and P above a cut,
with the margin that the sample sizes ask for. Both samples are bounded and drawn by a hash of the
id, so they are the same on every run; all documents are scored, from their whole texts. Only texts
go to Python and only scores come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, slices, staged

SAMPLE, PRIOR_ROWS = 8_000, 2_000
FOLDS, HELD_OUT = 3, 1
HIDDEN, STEPS, RATE, DECAY, REACH = 16, 450, 0.02, 1e-4, 4.0
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&<>@=~^_\\/{}[]+"
_ENDS = b".,;:?'\"()-"
COUNTS, GRAMS, WIDTH = 17, 64, 4
FEATURES = COUNTS + GRAMS
GRAM_WEIGHT, GRAM_POSITIVES = 0.2, 1000


def gram_shares(raw: bytes) -> list[float]:
    """Shares of the text's byte n-grams in each hash bucket."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(b) - WIDTH + 1
    if n < 1:
        return [0.0] * GRAMS
    h = np.zeros(n, np.uint32)
    for j in range(WIDTH):
        h = (h + b[j : j + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (np.bincount(h % np.uint32(GRAMS), minlength=GRAMS) / n).tolist()


def measure(text: str | None) -> list[float]:
    """Shares and ratios of a text, then its n-gram shares; all zero for one without words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    size = len(raw)
    count = lambda chars: size - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper_words = sum(map(bytes.isupper, words))
    pairs = list(zip(words, words[1:], strict=False))
    return [
        upper_words / n,
        count(_UPPER) / size,
        count(_DIGITS) / size,
        count(_SYMBOLS) / n,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        count(_ENDS) / n,
        len(set(words)) / n,
        sum(a == b for a, b in pairs) / n,
        len(set(pairs)) / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
        sum(map(len, words)) / n / 10,
        max(map(len, words)) / 100,
        len(lines) / n,
        float(np.log1p(n)) / 10,
        sum(not w.isalnum() and w.isascii() for w in words) / n,
        (size - len(raw.decode("utf-8", "replace"))) / size,
        *gram_shares(raw),
    ]


def _spread(x: np.ndarray) -> np.ndarray:
    """Measurements with square roots beside them, which part small shares."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Deviations from the mean, at most ``REACH`` of them, so that no odd text is judged by one measurement."""
    return np.clip((_spread(x) - mean) / scale, -REACH, REACH)


def _scale(x: np.ndarray, positives: int) -> np.ndarray:
    """Standard deviations; n-grams, many and each of little account, weigh less, the more so the fewer positives there are."""
    weight = np.where(np.arange(x.shape[1] // 2) < COUNTS, 1.0, GRAM_WEIGHT * min(1.0, positives / GRAM_POSITIVES))
    return (x.std(axis=0) + 1e-3) / np.tile(np.maximum(weight, 1e-6), 2)


class Model:
    def __init__(self, weights: list[np.ndarray], mean: np.ndarray, scale: np.ndarray) -> None:
        self.weights, self.mean, self.scale = weights, mean, scale

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(_standard(x, self.mean, self.scale) @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 3) -> Model:
    """Minimise the non-negative risk with the logistic loss by Adam over all rows at once."""
    both = _spread(np.concatenate([positive, unlabelled]))
    mean, scale = both.mean(axis=0), _scale(both, len(positive))
    p, u = _standard(positive, mean, scale), _standard(unlabelled, mean, scale)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def back(x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        inner = g[:, None] * w[2] * (1 - h * h)
        return [x.T @ inner, inner.sum(axis=0), h.T @ g, g.sum()]

    for step in range(1, steps + 1):
        hp, hu = np.tanh(p @ w[0] + w[1]), np.tanh(u @ w[0] + w[1])
        gp, gu = hp @ w[2] + w[3], hu @ w[2] + w[3]
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        plus = -prior * (1 - sp) / len(p)
        minus_p, minus_u = -prior * sp / len(p), su / len(u)
        if negative >= 0:
            grad = [a + b for a, b in zip(back(p, hp, plus + minus_p), back(u, hu, minus_u), strict=True)]
        else:
            grad = [-a - b for a, b in zip(back(p, hp, minus_p), back(u, hu, minus_u), strict=True)]
        for i, g in enumerate(grad):
            g = g + DECAY * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(w, mean, scale)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 5, seed: int = 5) -> float:
    """The share of positives in ``unlabelled``, from the two samples alone: the median over some splits.

    Half of each sample fits a network that parts P from U; on the other half, the share of U above a
    cut over the share of P above it bounds the prior from above at every cut. The cut is chosen
    with the deviation that shares of so few rows can have.
    """
    rng, found = np.random.default_rng(seed), []
    for _ in range(rounds):
        p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
        a, b = max(1, len(p) // 2), max(1, len(u) // 2)
        parts = fit(p[:a][:PRIOR_ROWS], u[:b][:PRIOR_ROWS], 0.5, STEPS // 3)
        sp, su = np.sort(parts.logits(p[a:] if len(p) > a else p)), np.sort(parts.logits(u[b:] if len(u) > b else u))
        qp, qu = (1 - np.searchsorted(s, sp, side="left") / len(s) for s in (sp, su))
        slack = np.sqrt(np.log(40) / (2 * len(su))) + np.sqrt(np.log(40) / (2 * len(sp)))
        cut = int(np.argmin((qu + slack) / qp))
        found.append(min(1.0, qu[cut] / qp[cut]))
    return float(np.median(found))


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [measure(t) for part in slices(batch) for t in part.to_pylist()]
            yield pa.array(rows, pa.list_(pa.float64()))

    return docs.select(F.arrow_udf(run, "array<double>")("text").alias("x"))


def _drawn(rows: DataFrame, bound: int, salt: int) -> DataFrame:
    """About ``bound`` rows at most, by a hash of the id."""
    n = rows.count()
    part = min(1.0, 0.98 * bound / max(1, n))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(part * 1_000_000))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float | None = None) -> Model | None:
    """Fit on at most about ``sample`` trusted positives and ``sample`` unlabelled documents.

    Labels come only from rows outside the held-out fold, and only positive ones are used. The class
    prior is estimated unless given. Without positives or documents there is no model.
    """
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).select("doc_id").distinct()
    trusted = staged(_drawn(staged(known), sample, 1))
    seen = docs.where(fold() != HELD_OUT)
    positive = _measured(seen.join(trusted, "doc_id", "left_semi")).collect()
    unlabelled = _measured(_drawn(seen, sample, 2)).collect()
    if not positive or not unlabelled:
        return None
    p, u = (x[np.lexsort(x.T)] for x in (np.array([r["x"] for r in rows]) for rows in (positive, unlabelled)))  # in an order that no run changes
    prior = estimate_prior(p, u) if prior is None else prior
    return fit(p, u, min(0.98, max(0.02, prior)))


def score_quality(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and score and predicted for every row.

    A null text scores as an empty one; without a model every score is 0.5. Only text is an input;
    columns of ``keep`` called score or predicted give way. Repeated rows each get their row; an
    empty table gives none.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores = [np.zeros(0)]
            for part in slices(batch):
                texts = part.to_pylist()
                scores.append(given.value.scores(np.array([measure(t) for t in texts])) if given.value else np.full(len(texts), 0.5))
            yield pa.array(np.concatenate(scores))

    score = F.arrow_udf(run, "double").asNondeterministic()  # a filter on it is no second run
    names = [c for c in keep if c not in ("score", "predicted")]
    return docs.select(*names, score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
