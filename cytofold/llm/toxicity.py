"""Toxicity by a classifier chain over word features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cytofold.llm.common import drop_durable, durable
from cytofold.llm.sampling import labelled

#: ASCII characters that are neither letters nor digits become spaces.
_SPACED = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
PREFIXES = (3, 4, 5, 6)


def words(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_SPACED).split())


def _hash(feature: bytes) -> int:
    return int.from_bytes(blake2b(feature, digest_size=8).digest(), "little", signed=True)


def shown(word: bytes) -> list[int]:
    """A word's features, hashed to 64 bits: itself, and its beginnings of several lengths, which an inflected word shares with others."""
    return [_hash(word), *(_hash(b"^" + word[:n]) for n in PREFIXES if len(word) >= n)]


def several(features: np.ndarray) -> np.ndarray:
    """The features of texts in which at least two distinct words show one of `features`, which then are beginnings."""
    return ((features.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


class Features:
    """The distinct features of a text: words, beginnings of words, and beginnings of several of its words; words are remembered up to `room` of them."""

    def __init__(self, room: int = 150_000):
        self.known, self.room = {}, room

    def __call__(self, text: str) -> np.ndarray:
        ws = words(text)
        if new := {w for w in ws if w not in self.known}:
            if len(self.known) > self.room:
                self.known.clear()
                new = ws
            self.known.update((w, shown(w)) for w in new)
        once, n = np.unique(np.array([f for w in ws for f in self.known[w]], dtype=np.int64), return_counts=True)
        return np.concatenate([once, several(once[n > 1])])


def telling(sample: DataFrame, folds: int, most: int) -> dict[int, list[int]]:
    """The features that tell the label, for each fold from the documents outside it, and under -1 from all of `sample` (label, fold, mark, fs).

    Those that are commoner in documents with the label, of at least two documents, by the likelihood ratio, the clearest first and `most` at most; of features of the same documents, one. Counts are made by
    the executors, and only what is chosen reaches the driver. How many there are doesn't depend on the size of the sample: what they are worth is left to the models' penalty and to what is seen outside the folds.
    """
    of = {r["fold"]: (r["n"], r["y"]) for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()}
    n, y = (sum(v[k] for v in of.values()) for k in (0, 1))
    parts = [(-1, n, y), *((k, n - of.get(k, (0, 0))[0], y - of.get(k, (0, 0))[1]) for k in range(folds))]
    told = {k: [] for k, _, _ in parts}
    pairs = sample.select("label", "fold", "mark", F.explode("fs").alias("f"))
    sums = {"a": F.col("label"), "n": F.lit(1), "m": F.col("mark")}
    within = [F.sum(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{c}_{k}") for k in range(folds) for c, v in sums.items()]
    counts = durable(pairs.groupBy("f").agg(*[F.sum(v).alias(c) for c, v in sums.items()], *within).where("n >= 2"), "toxicity-counts")
    out = [F.struct(F.lit(k).alias("part"), *[(F.col(c) - F.col(f"{c}_{k}") if k >= 0 else F.col(c)).alias(c) for c in sums], F.lit(float(yy)).alias("n1"), F.lit(float(nn - yy)).alias("n0")) for k, nn, yy in parts if 0 < yy < nn]
    if not out:
        return told
    a, b, n1, n0 = F.col("a"), F.col("n") - F.col("a"), F.col("n1"), F.col("n0")
    share = F.col("n") / (n1 + n0)
    term = lambda seen, mean: F.when(seen > 0, seen * F.log(seen / mean)).otherwise(0.0)
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (term(a, n1 * share) + term(b, n0 * share) + term(n1 - a, n1 * (1 - share)) + term(n0 - b, n0 * (1 - share)))))
    rows = counts.select("f", F.explode(F.array(*out)).alias("s")).select("f", "s.*").where("n >= 2 and a * (n1 + n0) > n * n1").withColumn("z", z)
    rows = rows.groupBy("part", "a", "n", "m", "z").agg(F.min("f").alias("f"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("z"), "f"))).where(F.col("rank") <= most)
    for r in sorted(rows.select("part", "rank", "f").collect()):
        told[r["part"]].append(r["f"])
    drop_durable(counts)
    return told


def themes(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """The cluster, from 0, of each row of 0s and 1s by spherical k-means; rows of zeros get -1. The first centre is the commonest row's, each further one the row least like those so far."""
    size = np.sqrt(x.sum(1))
    own = np.nonzero(size)[0]
    at = np.full(len(x), -1)
    if not len(own):
        return at
    u = x[own] / size[own][:, None]
    centres = [u[int((u @ u.mean(0)).argmax())]]
    while len(centres) < min(k, len(u)):
        centres.append(u[int((u @ np.array(centres).T).max(1).argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        got = (u @ c.T).argmax(1)
        new = np.array([u[got == j].sum(0) if (got == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    at[own] = (u @ c.T).argmax(1)
    return at


class Chain:
    """Linear models, one per category, in a fixed order; each also sees the log-odds of the categories before it.

    While fitting, the earlier log-odds that a link sees are out-of-fold predictions, by models whose features, and categories where these are learnt, too come from outside the fold, so that it
    learns how far to trust them on documents that they weren't fitted on. Documents with a category weigh `weight` times those without. From out-of-fold predictions of the last link follows
    how far its odds are shifted down, if at all, so that of the documents without the label no more than a share `clean` would be taken for such with it.
    """

    def __init__(self, names: Sequence[str], penalty: float = 0.3, weight: float = 3.0, clean: float = 0.005):
        self.names, self.penalty, self.weight, self.clean = list(names), penalty, weight, clean
        #: What is remembered of words: those without a feature, and the features of the others.
        self.silent, self.telling = set(), {}

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, penalty: float, weight: float = 1.0, steps: int = 25) -> np.ndarray:
        """Ridge logistic regression by Newton's method; the last column is the intercept, which is hardly shrunk."""
        w, v = np.zeros(x.shape[1]), np.where(y > 0, weight, 1.0)
        ridge = np.full(x.shape[1], penalty)
        ridge[-1] = 1e-3
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (v * (p - y)) + ridge * w
            h = (x * (v * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            d = np.linalg.solve(h, g)
            w -= d * min(1.0, 5 / (np.abs(d).max() + 1e-12))
            if np.abs(d).max() < 1e-4:
                break
        return w

    def _link(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A fitted link; without both values of y it predicts the share of 1 for all."""
        if 0 < y.sum() < len(y):
            return self._fit(x, y, self.penalty, self.weight)
        w = np.zeros(x.shape[1])
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w

    def fit(self, held: np.ndarray, features: list[int], chosen: dict[int, list[int]], labels: dict[int, np.ndarray], fold: np.ndarray) -> Chain:
        """held: documents x features, 0 or 1; chosen: the features of each fold's models, and under -1 of the final ones; labels: likewise, a column of 0 and 1 per category, of which a fold's own rows aren't looked at."""
        n, k = labels[-1].shape
        place = {f: i for i, f in enumerate(features)}
        self.vocabulary = {f: i for i, f in enumerate(chosen[-1])}
        columns = {part: [place[f] for f in fs] for part, fs in chosen.items()}
        self.links: list[np.ndarray] = []
        odds, one = np.zeros((n, 0)), np.ones((n, 1))
        for j in range(k):
            w, out = self._link(np.hstack([held[:, columns[-1]], odds, one]), labels[-1][:, j]), np.zeros(n)
            for f in np.unique(fold):
                at, own = fold == f, np.hstack([held[:, columns[f]], odds, one])
                out[at] = own[at] @ self._link(own[~at], labels[f][~at, j])
            if j == k - 1 and (none := labels[-1][:, j] == 0).any():
                w[-1] -= max(0.0, float(np.quantile(out[none], 1 - self.clean, method="higher")))
            self.links.append(w)
            odds = np.hstack([odds, np.clip(out, -15, 15)[:, None]])
        #: For each beginning that several words may show, the place of that feature.
        self.twice: dict[int, int] = {}
        return self

    def _own(self, word: bytes) -> list[int]:
        """The word's features that count by themselves, or once another word shows them."""
        out = []
        fs = shown(word)
        for f, g in zip(fs, several(np.array(fs, dtype=np.int64)).tolist(), strict=True):
            if g in self.vocabulary:
                self.twice[f] = self.vocabulary[g]
            if f in self.vocabulary or f in self.twice:
                out.append(f)
        return out

    def _matrix(self, docs: list[set[bytes]]) -> np.ndarray:
        x = np.zeros((len(docs), len(self.vocabulary)))
        for r, ws in enumerate(docs):
            seen: set[int] = set()
            for w in ws - self.silent:
                if w not in self.telling:
                    if own := self._own(w):
                        self.telling[w] = own
                    else:
                        if len(self.silent) > 300_000:
                            self.silent.clear()
                        self.silent.add(w)
                        continue
                for f in self.telling[w]:
                    if f in self.vocabulary:
                        x[r, self.vocabulary[f]] = 1
                    if f in seen and f in self.twice:
                        x[r, self.twice[f]] = 1
                    seen.add(f)
        return x

    def __getstate__(self) -> dict:
        return self.__dict__ | {"silent": set(), "telling": {}}

    def scores(self, docs: list[set[bytes]]) -> np.ndarray:
        """Probabilities of word sets, a column per category."""
        x, out = self._matrix(docs), []
        for w in self.links:
            z = np.clip(np.hstack([x, np.ones((len(docs), 1))]) @ w, -15, 15)
            x = np.hstack([x, z[:, None]])
            out.append(1 / (1 + np.exp(-z)))
        return np.array(out).T.reshape(len(docs), len(self.links))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = (), n_themes: int = 2, limit: int = 8000, folds: int = 5, features: int = 250, where: Column | None = None) -> Chain:
    """A chain over `categories`, which are columns of labels with 0 and 1, and last the label `toxic` itself, fitted on the driver on at most `limit` labelled documents.

    Without categories they are themes learnt here: the documents labelled toxic fall into n_themes clusters by the telling features that they hold, and theme_1, theme_2, ...
    say whether a document is a toxic one of that cluster; a fold's models get themes made without its documents. Documents of equal features and labels count once. What the driver gets is the chosen features,
    at most `features` for each fold and for the whole, and which of those the sample's documents hold.
    """
    more = list(categories)

    def run(batches):
        of = Features()
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in ("doc_id", "label", *more)}, "fs": [of(t) for t in b["text"]]})

    kinds = ", ".join(f"`{c}` int" for c in ("label", *more))
    rows = labelled(docs, labels, "toxic", limit, where, more).mapInPandas(run, f"doc_id long, {kinds}, fs array<long>")
    once = rows.groupBy("fs", "label", *more).agg(F.min("doc_id").alias("doc_id"))
    sample = durable(once.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int").alias("fold"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)).alias("mark")), "toxicity-sample")
    chosen = telling(sample, folds, features)
    every = np.unique(np.array([f for fs in chosen.values() for f in fs], dtype=np.int64))

    def held(batches):
        for b in batches:
            yield pd.DataFrame({**{c: b[c] for c in ("doc_id", "fold", "label", *more)}, "at": [np.nonzero(np.isin(every, np.asarray(fs, dtype=np.int64)))[0].astype(np.int32) for fs in b["fs"]]})

    got = sample.mapInPandas(held, f"doc_id long, fold int, {kinds}, at array<int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"]))
    drop_durable(sample)
    x = np.zeros((len(got), len(every)), dtype=np.uint8)
    for i, r in enumerate(got):
        x[i, r["at"]] = 1
    toxic, fold = np.array([r["label"] for r in got], dtype=float), np.array([r["fold"] for r in got], dtype=int)
    if more:
        names = more
        fixed = np.column_stack([*[np.array([r[c] or 0 for r in got], dtype=float) for c in more], toxic]) if got else np.zeros((0, len(more) + 1))
        of = dict.fromkeys(chosen, fixed)
    else:
        names, of = [f"theme_{k + 1}" for k in range(n_themes)], {}
        for part in sorted(chosen):  # -1 first: the others' clusters are named after those of all
            own = _themed(x, toxic, (fold != part) if part >= 0 else np.ones(len(got), dtype=bool), np.searchsorted(every, np.array(chosen[part], dtype=np.int64)), n_themes)
            if part >= 0:
                own = own[:, _matched(own, of[-1][:, :-1])]
            of[part] = np.column_stack([own, toxic])
    return Chain([*names, "toxic"]).fit(x, every.tolist(), chosen, of, fold)


def _themed(x: np.ndarray, toxic: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int) -> np.ndarray:
    """A column of 0 and 1 per theme: which of k clusters, made of the given rows and columns alone, a toxic document is of."""
    out = np.zeros((len(x), k))
    mine = np.nonzero(rows & (toxic == 1))[0]
    if len(mine) and len(columns):
        theme = themes(x[np.ix_(mine, columns)].astype(float), k)
        out[mine[theme >= 0], theme[theme >= 0]] = 1
    return out


def _matched(own: np.ndarray, names: np.ndarray) -> list[int]:
    """For each column of `names` the column of `own` with which it has most in common, each used once, the largest overlaps first."""
    common = own.T @ names
    out = [0] * common.shape[1]
    for _ in range(len(out)):
        i, j = np.unravel_index(int(common.argmax()), common.shape)
        out[j] = int(i)
        common[i, :], common[:, j] = -1, -1
    return out


def toxicity(docs: DataFrame, chain: Chain, text_col: str = "text", into: str = "_toxicity") -> DataFrame:
    """docs with a struct of the probability of each category, in the chain's order, `toxic` last.

    Whole texts; null and empty ones have no words and get the intercepts. A very long text is scored whole, as one row. Repeated rows are scored one by one and alike. No rows: no rows.
    No shuffle. Other columns pass through; one that is called as `into` is replaced.
    """
    fields = ", ".join(f"{n}: double" for n in chain.names)
    names = chain.names

    @F.pandas_udf(f"struct<{fields}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            ts = texts.fillna("").tolist()
            yield pd.DataFrame(np.vstack([chain.scores([words(t) for t in ts[i : i + 500]]) for i in range(0, len(ts), 500)] or [np.zeros((0, len(names)))]), columns=names)

    return docs.withColumn(into, run(F.col(text_col)))


def digest(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    chain = train(docs, labels)
    out = toxicity(docs.select("doc_id", "text"), chain)
    return out.select("doc_id", *(F.col(f"_toxicity.{n}").alias(f"p_{n}") for n in chain.names), (F.col("_toxicity.toxic") >= threshold).cast("int").alias("predicted"))
