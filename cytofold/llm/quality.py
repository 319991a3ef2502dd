"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm.sampling import labelled

_CAPITALS, _DIGITS, _SPACES = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\r\x0b\x0c"
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,'\"-?;:()")
BASE = 12


def _line(line: str, seen: bool) -> tuple[float, ...]:
    """What one line shows by itself: shares of capitals, digits and odd marks, repetition, word and line lengths."""
    b = line.encode()
    n = len(b)
    if not n:
        return (1.0,) + (0.0,) * (BASE - 1)
    ws = b.split()
    m = len(ws)
    solid = max(1, n - (n - len(b.translate(None, _SPACES))))
    share = lambda kind: (n - len(b.translate(None, kind))) / solid
    marks = share(_MARKS)
    again = sum(map(eq, ws[1:], ws)) / max(1, m - 1)
    apart = len(set(ws)) / max(1, m)
    mean = (solid / m if m else 0.0) / 12
    return (0.0, share(_CAPITALS), min(1.0, 4 * marks), float(marks > 0.02), share(_DIGITS), again, float(again > 0.25), (1 - apart) * min(1.0, m / 20), min(2.0, mean), min(1.0, m / 50), float(b[-1:] in b".!?\"'"), float(seen))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths): each line's own features, its neighbours', and a constant. Lines are parted by \\n; an empty text is one empty line."""
    lines = text.split("\n")
    known: set[str] = set()
    own = np.empty((len(lines), BASE), dtype=np.float64)
    for i, x in enumerate(lines):
        own[i] = _line(x, x in known)
        if len(x) > 20:
            known.add(x)
    none = np.zeros((1, BASE))
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    return np.hstack([own, before, after, np.ones((len(lines), 1))]), np.array([len(x) for x in lines], dtype=np.float64)


class Chain:
    """A linear-chain conditional random field with states 0 (bad) and 1 (good): a weight per feature for good against bad, and 2 x 2 transition weights."""

    def __init__(self, n_features: int):
        self.w, self.t = np.zeros(n_features), np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    @staticmethod
    def _walk(e: np.ndarray, start: np.ndarray, size: np.ndarray, t: np.ndarray, pairs: bool = False):
        """P(good) of each line of many chains laid end to end, by forward-backward in log odds form, all chains a step at a time.

        Chains are ordered by length, so a step touches only those that reach it. e: log odds of good from the features.
        """
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        longest = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        fwd, back = np.empty_like(e), np.zeros_like(e)
        # log odds pass through a transition: log(e^(t01) + e^(t11+x)) - log(e^(t00) + e^(t10+x)), the first index being where it comes from
        ahead = lambda x, t: np.logaddexp(t[0, 1], t[1, 1] + x) - np.logaddexp(t[0, 0], t[1, 0] + x)
        for i in range(longest):
            at = start[: live[i]] + i
            fwd[at] = e[at] + (ahead(fwd[at - 1], t) if i else 0)
        for i in range(longest - 2, -1, -1):
            at = start[: live[i + 1]] + i
            back[at] = ahead(e[at + 1] + back[at + 1], t.T)
        p = 1 / (1 + np.exp(-np.clip(fwd + back, -40, 40)))
        if not pairs:
            return p
        first = np.ones(len(e), dtype=bool)
        first[start] = False
        b = np.nonzero(first)[0]
        a = b - 1
        f, g = fwd[a], e[b] + back[b]
        z = np.stack([np.full(len(a), t[0, 0]), t[0, 1] + g, t[1, 0] + f, t[1, 1] + f + g], 1)
        z = np.exp(z - z.max(1, keepdims=True))
        return p, (z / z.sum(1, keepdims=True)), a, b

    def marginals(self, x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self._walk(x @ self.w, start, size, self.t)

    def fit(self, x, start, size, y, penalty: float = 1.0, steps: int = 60, rate: float = 0.25) -> None:
        """Maximum likelihood of the line labels y with a ridge, by Adam; deterministic."""
        w = np.concatenate([self.w, self.t.ravel()])
        m, v, n = np.zeros_like(w), np.zeros_like(w), len(size)
        for s in range(1, steps + 1):
            p, z, a, b = self._walk(x @ w[:-4], start, size, w[-4:].reshape(2, 2), pairs=True)
            real = np.bincount(y[a].astype(int) * 2 + y[b].astype(int), minlength=4)
            g = np.concatenate([x.T @ (p - y), z.sum(0) - real]) / n + penalty * w / n
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - rate * (1 - 0.9 * s / steps) * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.99**s)) + 1e-8)
        self.w, self.t = w[:-4], w[-4:].reshape(2, 2)

    @staticmethod
    def aggregate(p: np.ndarray, length: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The mean P(good) of a document's lines, weighted by length + 1."""
        weight = length + 1
        return np.add.reduceat(p * weight, start) / np.add.reduceat(weight, start) if len(start) else np.zeros(0)

    def documents(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x, length, start, size = stacked(texts)
        share = self.aggregate(self.marginals(x, start, size), length, start)
        return 1 / (1 + np.exp(-np.clip(self.slope * _odds(share) + self.shift, -40, 40)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.005, 0.995)
    return np.log(p / (1 - p))


def stacked(texts: list[str]):
    parts = [features(t) for t in texts]
    size = np.array([len(n) for _, n in parts])
    return np.vstack([x for x, _ in parts]), np.concatenate([n for _, n in parts]), np.cumsum(size) - size, size


def fitted(texts: list[str], labels: np.ndarray, rounds: int = 3, longest: int = 400) -> Chain:
    """A field learnt from document labels.

    A good document's lines are good. Which lines of a bad one are bad isn't known: all are at first, and after each fit
    those that the field itself finds bad, and at least the worst. Last, a logistic curve, which rises, is laid over the aggregate so that the score is the probability of label 1.
    A document of over `longest` lines is fitted as several chains, so that the steps of a fit don't grow with the longest document; scores are by whole chains.
    """
    chain = Chain(3 * BASE + 1)
    if not len(labels) or len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        chain.slope, chain.shift = 0.0, float(np.log(share / (1 - share)))
        return chain
    x, length, start, size = stacked(texts)
    row = np.repeat(np.arange(len(size)), size)
    part = np.concatenate([np.arange(s, s + n, longest) for s, n in zip(start, size, strict=True)])
    parts = np.diff(np.append(part, len(row)))
    y = labels[row].astype(np.float64)
    for r in range(rounds):
        chain.fit(x, part, parts, y)
        p = chain.marginals(x, start, size)
        if r < rounds - 1:
            worst = np.minimum.reduceat(p, start)
            y = np.where(labels[row] == 1, 1.0, ((p > 0.5) & (p > worst[row])).astype(np.float64))
    z = np.column_stack([_odds(chain.aggregate(p, length, start)), np.ones(len(size))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        d = np.linalg.solve((z * (q * (1 - q) + 1e-9)[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (q - labels))
        w -= d * min(1.0, 2 / (np.abs(d).max() + 1e-12))
        if np.abs(d).max() < 1e-7:
            break
    chain.slope, chain.shift = max(float(w[0]), 1e-3), float(w[1])
    return chain


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, limit: int = 6000, longest: int = 400) -> Chain:
    """Fitted on the driver on at most `limit` labelled documents that aren't held out; `longest` is as in fitted()."""
    rows = labelled(docs, labels, "quality", limit, ~held_out(F.col("doc_id"))).select("doc_id", "label", "text")
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in rows.collect())
    return fitted([t for _, _, t in got], np.array([y for _, y, _ in got], dtype=np.float64), longest=longest)


def quality(docs: DataFrame, chain: Chain, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability, by its lines, that a whole text is of good quality. Null and empty texts are one empty line. No shuffle.

    A very long text is one chain of all its lines. Repeated rows are scored one by one and alike. No rows: no rows. Other columns pass through; one that is called as `into` is replaced.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            ts = texts.fillna("").tolist()
            yield pd.Series(np.concatenate([chain.documents(ts[i : i + 500]) for i in range(0, len(ts), 500)] or [np.zeros(0)]))

    return docs.withColumn(into, run(F.col(text_col)))


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    out = quality(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
