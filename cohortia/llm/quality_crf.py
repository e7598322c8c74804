"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad by features of its own and of the lines beside
it, and by the labels beside it. Forward-backward gives each line's probability of being
good; a document's score is a logistic curve over the mean of these, weighted by length.

Only documents are labelled, so lines are labelled in rounds: lines of good documents are
good; of a bad document's lines those are bad that the model so far takes to be bad, at
least its worst. Fitting uses at most ``FitBound.per_class`` labelled documents of each class, of
at most ``FitBound.lines`` lines, lowest hash of doc_id first; everything is scored in full.

Cases: null and empty texts are one empty line; a text of any length is scored whole; repeated
rows get equal scores; repeated labels count once (the larger quality); of an id's several texts the fit sees that of the
smallest hash, and each is scored by itself; a null doc_id isn't
held out; without labels of both classes each score is 0.5; an empty table gives no rows;
further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table


@dataclass(frozen=True)
class FitBound:
    per_class: int = 1500
    lines: int = 80


# Classes of bytes: upper, lower or beyond ASCII, digit, blank, stop, pipe, bang, symbol.
_KIND = np.full(256, 7, np.uint8)
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 4
_KIND[ord("|")] = 5
_KIND[ord("!")] = 6
_NOISE = np.random.default_rng(7).integers(1, 1 << 62, 256, dtype=np.uint64)
OWN = 10
WIDTH = 3 * OWN + 1
#: Bytes worked on at once.
CHUNK = 2 << 20


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x WIDTH), bytes of each line, and lines of each text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(joined == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    per_text = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    n = len(ends)
    line = np.repeat(np.arange(n, dtype=np.int32), size + 1)
    count = np.bincount(line * np.int32(8) + _KIND[joined], minlength=8 * n).reshape(n, 8).astype(float)
    count[:, 7] -= 1  # the line's end
    # words: where a byte that isn't blank follows one that is
    blank = (_KIND[joined] == 3) | (joined == 10)
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    again = np.zeros(n)
    words = np.zeros(n)
    if len(first):
        value = np.where(blank, np.uint64(0), _NOISE[joined])
        word = np.add.reduceat(value, first)
        of = line[first]
        words = np.bincount(of, minlength=n).astype(float)
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (of[1:] == of[:-1])])
        again = np.bincount(of[same], minlength=n).astype(float)
    letters = count[:, 0] + count[:, 1]
    whole = np.maximum(size, 1)
    per_word = np.maximum(words, 1)
    own = np.stack(
        [
            np.log1p(size) / 5,
            np.minimum(1, 1.5 * count[:, 0] / np.maximum(letters, 1)),
            np.minimum(1, 5 * count[:, 7] / whole),
            np.minimum(1, 5 * count[:, 2] / whole),
            np.minimum(1, 8 * count[:, 5] / whole),
            np.minimum(1, 8 * count[:, 6] / whole),
            np.minimum(1, 2 * again / per_word),
            np.minimum(2, letters / per_word / 8),
            np.minimum(1, 2 * count[:, 4] / per_word),
            (size == 0).astype(float),
        ],
        axis=1,
    )
    last = np.cumsum(per_text) - 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[last[:-1] + 1] = 0
    after[:-1] = own[1:]
    after[last] = 0
    return np.concatenate([np.ones((n, 1)), own, before, after], axis=1), size, per_text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Chains:
    """Sequences side by side: step t of all that are longer than t, longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.steps = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t


def forward_backward(unary: np.ndarray, pair: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected pairs of neighbouring labels, and the sum of log Z.

    ``unary``: lines x 2 and ``pair``: 2 x 2, both log potentials; scaled at each step."""
    e = np.exp(unary - unary.max(axis=1, keepdims=True))
    m = np.exp(pair - pair.max())
    alpha, scale = np.empty_like(e), np.empty(len(e))
    held = np.empty((0, 2))
    for t in range(chains.steps):
        at = chains.at(t)
        a = e[at] if t == 0 else (held[: len(at)] @ m) * e[at]
        s = a.sum(axis=1)
        held = a / s[:, None]
        alpha[at], scale[at] = held, s
    marginal = np.empty(len(e))
    pairs = np.zeros((2, 2))
    beta = np.ones((0, 2))
    for t in range(chains.steps - 1, -1, -1):
        at = chains.at(t)
        if len(at) > len(beta):
            beta = np.concatenate([beta, np.ones((len(at) - len(beta), 2))])
        p = alpha[at] * beta
        marginal[at] = p[:, 1] / p.sum(axis=1)
        if t:
            before = at - 1
            out = e[at] * beta / scale[at][:, None]
            pairs += m * (alpha[before].T @ out)
            beta = out @ m.T
    log_z = float(np.log(scale).sum() + unary.max(axis=1).sum() + pair.max() * (len(e) - len(chains.lengths)))
    return marginal, pairs, log_z


def _minimize(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    fx, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            d = d + (a - (y @ d) / (s @ y)) * s
        step, slope = 1.0, g @ d
        if slope > -1e-9:
            break
        while step > 1e-6:
            to = x + step * d
            fn, gn = f(to)
            if fn <= fx + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (to - x) @ (gn - g) > 1e-12:
            past = [*past[-memory + 1 :], (to - x, gn - g)]
        done = abs(fx - fn) < 1e-6 * max(1, abs(fx))
        x, fx, g = to, fn, gn
        if done:
            break
    return x


@dataclass
class QualityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    shift: float = 0.0

    def line_marginals(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        u = x @ self.weights
        return forward_backward(np.stack([np.zeros_like(u), u], axis=1), self.pair, Chains(per_text))[0]

    def means(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean P(good) of each text."""
        x, size, per_text = line_features(texts)
        p = self.line_marginals(x, per_text)
        first = np.cumsum(per_text) - per_text
        weight = size + 1.0
        return np.add.reduceat(p * weight, first) / np.add.reduceat(weight, first)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.slope * self.means(texts) + self.shift) if texts else np.zeros(0)

    @classmethod
    def fit(cls, texts: list[bytes], labels: np.ndarray, rounds: int = 4, ridge: float = 1.0) -> QualityModel:
        labels = np.asarray(labels)
        if len(set(labels.tolist())) < 2:
            return cls()
        x, size, per_text = line_features(texts)
        of = np.repeat(np.arange(len(texts)), per_text)
        chains = Chains(per_text)
        inside = np.ones(len(x), bool)
        inside[np.cumsum(per_text) - per_text] = False  # has a line before it
        good = labels[of].astype(float)
        model = cls()
        theta = np.zeros(WIDTH + 4)

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            w, pair = v[:WIDTH], v[WIDTH:].reshape(2, 2)
            u = x @ w
            p, pairs, log_z = forward_backward(np.stack([np.zeros_like(u), u], axis=1), pair, chains)
            y = good.astype(int)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
            value = log_z - u[y == 1].sum() - (seen * pair).sum() + ridge / 2 * (v @ v)
            grad = np.concatenate([x.T @ (p - good), (pairs - seen).ravel()]) + ridge * v
            return float(value), grad

        for k in range(rounds):
            theta = _minimize(loss, theta, 25 if k + 1 < rounds else 60)
            model = cls(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy())
            if k + 1 == rounds:
                break
            # which lines of bad documents are bad: by their own features, so that the chain doesn't spread one label
            p = _sigmoid(x @ model.weights)
            good = np.where(labels[of] == 1, 1.0, (p >= 0.5).astype(float))
            first = np.cumsum(per_text) - per_text
            worst = np.minimum.reduceat(p, first)
            good[(labels[of] == 0) & (p <= worst[of])] = 0.0
        mean = model.means(texts)
        z = np.stack([mean, np.ones_like(mean)], axis=1)

        def curve(v: np.ndarray) -> tuple[float, np.ndarray]:
            q = _sigmoid(z @ v)
            value = -(labels * np.log(q + 1e-12) + (1 - labels) * np.log(1 - q + 1e-12)).sum() + 1e-3 * (v @ v)
            return float(value), z.T @ (q - labels) + 2e-3 * v

        v = _minimize(curve, np.array([4.0, -2.0]), 100)
        model.slope, model.shift = float(v[0]), float(v[1])
        return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, bound: FitBound = FitBound(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on the bounded sample; only its rows (at most 2 * per_class texts) reach the driver."""
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    each = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound.per_class) for y in (0, 1)
    ]
    sample = each[0].union(each[1])
    # bounded by per_class rows a class
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "doc_id")
        .where(F.length(F.regexp_replace("text", r"[^\n]+", "")) < bound.lines)
        .select("doc_id", "y", F.col("text").cast("binary").alias("text"))
        # of an id's texts the one of the smallest hash, whatever the order of rows
        .groupBy("doc_id", "y")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    )
    got = sorted(((r["doc_id"], r["y"], bytes(r["text"])) for r in rows.toLocalIterator()), key=lambda r: r[:2])
    if not got:
        return QualityModel()
    y = np.array([y for _, y, _ in got])
    model = QualityModel.fit([t for _, _, t in got], y)
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if 0 < y.sum() < len(y):  # the sample has the classes in other shares than the labels
        model.shift += float(np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_column(model: QualityModel, text: Column) -> Column:
    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, held, size = [], [], 0
            for t in batch:
                held.append(t or b"")
                size += len(held[-1])
                if size >= CHUNK:
                    out.append(model.scores(held))
                    held, size = [], 0
            out.append(model.scores(held))
            yield pd.Series(np.concatenate(out))

    return score(text.cast("binary"))


def score_quality(docs: DataFrame, labels: DataFrame, bound: FitBound = FitBound(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_quality(docs, labels, bound, id_col, text_col, label_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        score_column(model, F.col(text_col)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, bound: FitBound = FitBound()) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    model = fit_quality(docs, labels, bound)
    return docs.where(score_column(model, F.col("text")) >= 0.5)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
