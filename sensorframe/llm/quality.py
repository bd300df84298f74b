"""Quality scores by positive-unlabelled learning.

Documents labelled good are trusted positives; unlabelled web text is a mixture
of good and bad. A small network is trained in numpy on the non-negative
unbiased risk: with class prior p, loss l and averages over positives (P) and
unlabelled rows (U),

    p * P[l(f)] + max(0, U[l(-f)] - p * P[l(-f)]).

When the second part falls below zero on a batch, that batch moves it back up.
The prior is estimated from the same samples: for scores that tell positives
from unlabelled rows, the share of unlabelled rows above a cut over that of
positives is never below the prior, and reaches it where only positives are left.

A text is described by numbers about its characters, words and lines; labels,
language, source and id are not among them.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorframe.llm.common import map_rows, utf8_of
from sensorframe.llm.labelled import held_out, some_ids, texts_of

#: At most so many trusted positives and unlabelled rows are used to fit.
POSITIVES, UNLABELLED = 8000, 16000
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 512, 0.01
#: With fewer positives or unlabelled rows the class prior is not estimated but taken as this.
FEW, USUAL_PRIOR = 20, 0.5

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~(_UPPER | _LOWER | _DIGIT)
#: Signs that prose uses: comma, full stop, quotes, brackets, dash, colon, semicolon, question mark.
_PROSE = np.zeros(256, bool)
_PROSE[[ord(c) for c in ",.'\"()-:;?"]] = True
FEATURES = 23


def describe(text: bytes) -> list[float]:
    """The numbers that stand for a text (UTF-8); an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    odd = count[_SIGN].sum() - count[_PROSE].sum()
    solid = int(count.sum() - count[_SPACE].sum())
    letters = max(1, int(count[_UPPER].sum() + count[_LOWER].sum()))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = Counter([w[-3:] for w in words])
    return [np.log1p(n), np.log1p(len(text)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
            count[_UPPER].sum() / letters, count[_DIGIT].sum() / solid, count[_SIGN].sum() / solid,
            odd / solid, np.sqrt(odd / n), count[_PROSE].sum() / solid, count[128:].sum() / solid,
            distinct / n, np.log(distinct + 1) / np.log(n + 1), pairs / max(1, n - 1), np.log(pairs + 1) / np.log(n + 1),
            len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(map(eq, words, words[1:])) / n,
            max(Counter(lines).values()) / len(lines) if len(lines) > 1 else 0.0, (sizes <= 3).mean(),
            sum(c for w, c in ends.items() if len(set(w)) == 1) / n, sum(w[:1].isupper() for w in words) / n]


def described(docs: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Add ``x`` (array of double) of every whole text."""
    def make():
        def run(b: pa.RecordBatch) -> list:
            return [pa.array([describe(t.as_py()) for t in b.column("_text")], pa.list_(pa.float64()))]
        return run
    return map_rows(docs.select(*keep, utf8_of(text).alias("_text")), "x array<double>", keep, make)


# ------------------------------------------------------------------- training
def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Net:
    """One hidden layer; weights in one flat list for the updates."""

    def __init__(self, inputs: int, seed: int = 5):
        g = np.random.default_rng(seed)
        self.w = [g.normal(0, inputs ** -0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), g.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0

    def value(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def step(self, x: np.ndarray, slope: np.ndarray, decay: float = 1e-4) -> None:
        """One Adam step down, given the derivative of the loss by each row's value."""
        h = np.tanh(x @ self.w[0] + self.w[1])
        back = np.outer(slope, self.w[2]) * (1 - h * h)
        self.t += 1
        for a, m, v, g in zip(self.w, self.m, self.v, [x.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]):
            g = g + decay * a
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= RATE * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def _batches(n: int, m: int, g: np.random.Generator):
    """Rows of two samples, in as many batches as the larger one has."""
    for rows in np.array_split(g.permutation(m), max(1, m // BATCH)):
        yield g.integers(n, size=min(n, BATCH // 2)), rows


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 11) -> float:
    """Share of positives among unlabelled rows, between 0.05 and 0.99.

    Half of each sample trains a network that tells the two apart; on the other
    half, the least ratio of tail shares (plus a standard error) is the estimate.
    With fewer than ``FEW`` positives or unlabelled rows a half says too little:
    the prior is taken as ``USUAL_PRIOR``.
    """
    if min(len(pos), len(unl)) < FEW:
        return USUAL_PRIOR
    g, net = np.random.default_rng(seed), Net(pos.shape[1], seed)
    p, u = g.permutation(len(pos)), g.permutation(len(unl))
    p1, p2, u1, u2 = pos[p[::2]], pos[p[1::2]], unl[u[::2]], unl[u[1::2]]
    for _ in range(EPOCHS // 2):
        for a, b in _batches(len(p1), len(u1), g):
            x = np.concatenate([p1[a], u1[b]])
            s = _sigmoid(net.value(x))
            net.step(x, np.concatenate([(s[:len(a)] - 1) / len(a), s[len(a):] / len(b)]))
    sp, su = np.sort(net.value(p2)), np.sort(net.value(u2))
    best = 0.99
    for q in np.arange(0.02, 0.8, 0.02):
        cut = np.quantile(sp, q)
        a, b = (sp >= cut).mean(), (su >= cut).mean()
        spread = b / a * np.sqrt((1 - a) / (a * len(sp)) + (1 - b) / (max(b, 1e-9) * len(su)))
        best = min(best, b / a + spread)
    return float(max(0.05, best))


def fit_risk(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 3) -> Net:
    """Minimise the non-negative unbiased risk with the sigmoid loss l(z) = 1 / (1 + exp(z))."""
    g, net = np.random.default_rng(seed), Net(pos.shape[1], seed)
    for _ in range(EPOCHS):
        for a, b in _batches(len(pos), len(unl), g):
            x = np.concatenate([pos[a], unl[b]])
            s = _sigmoid(net.value(x))  # the loss of calling a row bad, 1 - s that of calling it good
            sp, su = s[:len(a)], s[len(a):]
            slope_p, slope_u = sp * (1 - sp) / len(a), su * (1 - su) / len(b)
            if su.mean() - prior * sp.mean() < 0:  # too good to be true: move the second part back up
                net.step(x, np.concatenate([prior * slope_p, -slope_u]))
            else:
                net.step(x, np.concatenate([-2 * prior * slope_p, slope_u]))
    return net


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """A model from trusted positives (``labels.quality`` = 1) and texts whose labels are not looked at.

    Only learnable rows are used, at most ``positives`` and ``unlabelled`` of them;
    of rows that share an id the one with the smallest numbers is.
    Without positives or texts the model calls everything good (score 1).
    """
    good = some_ids(labels.where("quality = 1").select("doc_id").distinct(), positives, "positive")
    some = some_ids(docs, unlabelled, "unlabelled").distinct()
    pos, unl = (np.array([r.x for r in described(texts_of(docs, ids)).groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()], float)
                for ids in (good, some))
    if not len(pos) or not len(unl):
        return {"prior": None}
    mid, scale = unl.mean(0), unl.std(0) + 1e-6
    pos, unl = (np.clip((x - mid) / scale, -8, 8) for x in (pos, unl))
    prior = estimate_prior(pos, unl)
    return {"prior": prior, "mid": mid, "scale": scale, "net": fit_risk(pos, unl, prior)}


def scores_of(x: np.ndarray, model: dict) -> np.ndarray:
    if model["prior"] is None or not len(x):
        return np.ones(len(x))
    return _sigmoid(model["net"].value(np.clip((x - model["mid"]) / model["scale"], -8, 8)))


def score(docs: DataFrame, model: dict, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) of every whole text, null ones as empty; all rows come back."""
    def make():
        def run(b: pa.RecordBatch) -> list:
            x = np.array([describe(t.as_py()) for t in b.column("_text")], float).reshape(-1, FEATURES)
            return [pa.array(scores_of(x, model))]
        return run
    return map_rows(docs.select(*keep, utf8_of(text).alias("_text")), "score double", keep, make)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``, with their columns."""
    own = docs.columns
    return score(docs.withColumn("_score_text", F.col("text")), fit(docs, labels), own, "_score_text").where(
        F.col("score") >= cut).select(*own)
