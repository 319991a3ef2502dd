"""Runs: maximal periodic stretches of words, from a suffix automaton whose end-position sets are merged small to large."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of the pieces by which places that can't be in a run are told.
PIECE = 8
FOUND = "struct<start: array<bigint>, length: array<bigint>, period: array<bigint>, n_words: bigint, text: string>"


class Automaton:
    """A suffix automaton over integer symbols, in flat arrays: a state is a class of strings that end at the same places.

    size: the longest string of a state; link: the state of the longest of its suffixes that ends at more places. A state's first transition is kept in arrays, further ones in
    a dictionary by (state, symbol), as most states of repetitive words have one.
    """

    def __init__(self, symbols: list[int], n_symbols: int):
        self.size, self.link = array("q", [0]), array("q", [-1])
        #: The states of the prefixes, in order.
        self.prefix = array("q")
        self._symbol, self._to, self._more, self._others = array("q", [-1]), array("q", [-1]), {}, {}
        self._n = n_symbols
        self._build(symbols)

    def _next(self, state: int, c: int) -> int:
        return self._to[state] if self._symbol[state] == c else self._more.get(state * self._n + c, -1)

    def _set(self, state: int, c: int, to: int) -> None:
        if self._symbol[state] in (c, -1):
            self._symbol[state], self._to[state] = c, to
        else:
            self._more[state * self._n + c] = to
            self._others.setdefault(state, set()).add(c)

    def _state(self, size: int) -> int:
        self.size.append(size)
        self.link.append(0)
        self._symbol.append(-1)
        self._to.append(-1)
        return len(self.size) - 1

    def _build(self, symbols: list[int]) -> None:
        size, link, last = self.size, self.link, 0
        for c in symbols:
            new, p = self._state(size[last] + 1), last
            self.prefix.append(new)
            while p >= 0 and (q := self._next(p, c)) < 0:
                self._set(p, c, new)
                p = link[p]
            if p >= 0:
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    twin = self._state(size[p] + 1)
                    self._symbol[twin], self._to[twin], link[twin] = self._symbol[q], self._to[q], link[q]
                    for x in self._others.get(q, ()):
                        self._set(twin, x, self._more[q * self._n + x])
                    while p >= 0 and self._next(p, c) == q:
                        self._set(p, c, twin)
                        p = link[p]
                    link[q] = link[new] = twin
            last = new


def _ordered_by_size(size: array, least: int) -> list[int]:
    """The states of at least that size, the longest first."""
    s = np.frombuffer(size, dtype=np.int64)
    some = np.nonzero(s >= least)[0]
    return some[np.argsort(-s[some], kind="stable")].tolist()


def runs_of(symbols: list[int], n_symbols: int, min_words: int, times: int) -> dict[tuple[int, int], int]:
    """{(start, period): end} of the runs of length >= max(min_words, times x period), times being at least 2.

    States give their ends to their links, the longest states first; the smaller set's ends go into the larger, ordered one. Ends that thereby become neighbours
    in the set of a state have exactly its size as their common suffix, so at a distance d of at most the size they seed a square, of which d is the smallest period. The run that it lies in starts where the common suffix does.
    Of a run, the last two ends that are d apart meet at a state of size length - d and are neighbours there, so the last seed of (start, d) ends where
    the run ends; and seeds with less than (times - 1) x d, or min_words - d, in common aren't needed for any run that counts.
    """
    a = Automaton(symbols, n_symbols)
    size, link = a.size, a.link
    least = max(1, min(max((times - 1) * d, min_words - d) for d in range(1, min_words + 1)))
    # Ends are kept negated: along a chain of ever shorter states ends get ever earlier, and so go to the end of the list.
    ends: dict[int, list[int]] = {}
    for i, s in enumerate(a.prefix):
        if size[s] >= least:
            ends[s] = [-i]
    # For each state: the set of its largest part so far with that part's name, and which part each of the other ends came in.
    base: dict[int, int] = {s: s for s in ends}
    came: dict[int, dict[int, int]] = {}
    out: dict[tuple[int, int], int] = {}
    for state in _ordered_by_size(size, least):
        own, n = ends.pop(state), size[state]
        if parts := came.pop(state, None):
            first, last = base[state], len(own) - 1
            for e, part in parts.items():
                k = bisect_left(own, e)
                pairs = []
                if k and parts.get(own[k - 1], first) != part:
                    pairs.append((own[k - 1], e))
                if k < last and own[k + 1] not in parts:
                    pairs.append((e, own[k + 1]))
                for x, y in pairs:
                    d = y - x
                    if d * (times - 1) <= n and n + d >= min_words:
                        key = (1 - y - n, d)
                        if out.get(key, 0) < 1 - x:
                            out[key] = 1 - x
        base.pop(state, None)
        up = link[state]
        if size[up] < least:
            continue
        held = ends.get(up)
        if held is None:
            ends[up], base[up] = own, state
            continue
        parts = came.setdefault(up, {})
        if len(held) < len(own):
            was = base[up]
            came[up] = parts = {e: parts.get(e, was) for e in held}
            ends[up], base[up] = own, state
            held, own = own, held
        else:
            parts.update(dict.fromkeys(own, state))
        for e in own:
            held.insert(bisect_left(held, e), e)
    return {k: e for k, e in out.items() if e - k[0] >= max(min_words, times * k[1])}


def stretches(words: list[bytes], min_words: int) -> list[tuple[int, int]]:
    """The stretches of words outside of which no run can be.

    Every PIECE words of a run of at least max(24, 3 periods) also stand one period before or after, so a word none of whose pieces occurs twice is in no run. Pieces are
    compared by hashes: of equal pieces these are equal, and others that happen to be are sorted out by the automaton.
    """
    n = len(words)
    if n < min_words:
        return []
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    piece = np.zeros(n - PIECE + 1, dtype=np.uint64)
    for k in range(PIECE):
        piece = piece * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(piece)]
    order = np.sort(piece)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return []
    at = np.searchsorted(twice, piece)
    at[at == len(twice)] = 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], twice[at] == piece, [False]]).astype(np.int8)))
    return [(s, e + PIECE - 1) for s, e in edge.reshape(-1, 2).tolist() if e + PIECE - 1 - s >= min_words]


def runs(words: list[bytes], min_words: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, period, length) of every run of the words, in order."""
    if min_words < 3 * PIECE or times < 3:
        parts = [(0, len(words))] if len(words) >= min_words else []
    else:
        parts = stretches(words, min_words)
    out = []
    for s, e in parts:
        code: dict[bytes, int] = {}
        symbols = [code.setdefault(w, len(code)) for w in words[s:e]]
        out += [(s + start, d, end - start) for (start, d), end in runs_of(symbols, len(code), min_words, times).items()]
    return sorted(out)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for s, d, n in found:
        depth[s + d] += 1
        depth[s + n] -= 1
    gone = np.cumsum(depth[:-1]) > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def _words(text: str | None) -> list[bytes]:
    """The maximal runs of other than ASCII white space, as UTF-8 (bytes.split parts at just those)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def periodic_runs(docs: DataFrame, text: Column | str = "text", into: str = "_runs", min_words: int = 24, times: int = 3) -> DataFrame:
    """docs with a struct `into`: start, length and period of every run of its words by start, then period; n_words; and text, the words that no run contains after its first period, joined by one space.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length >= max(min_words, times x q), times being 2 or more, that no neighbouring word extends keeping q.
    Words are maximal runs of other than ASCII white space. No shuffle; each text is a task's own, and its automaton takes some ten numbers for each word that stands in a repeated stretch, also of very long texts.
    Null and empty texts have no words and no runs. Repeated rows are each treated alike. No rows: no rows. Other columns pass through; one that is called as `into` is replaced.
    """

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = _words(t)
            found = runs(words, min_words, times)
            a = np.array(found, dtype=np.int64).reshape(-1, 3)
            rows.append((a[:, 0], a[:, 2], a[:, 1], len(words), b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["start", "length", "period", "n_words", "text"])

    return docs.withColumn(into, run(F.col(text).cast("string") if isinstance(text, str) else text))


def repeated_tail(doc_id: int | None, text: str | None) -> str | None:
    """The text of one document in ten (by h) with its words from a on replaced by a repetition of p of them: the contract's own planting. Null ids have no h and stay as they are."""
    if doc_id is None:
        return text
    h = crc32(str(doc_id).encode())
    if h % 10:
        return text
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    whole, rest = divmod(n - a, p)
    return b" ".join(words[:a] + cycle * whole + cycle[:rest]).decode("utf-8", "surrogatepass")


def planted(ids: Column, texts: Column) -> Column:
    @F.pandas_udf("string")
    def run(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([repeated_tail(None if pd.isna(i) else int(i), t) for i, t in zip(ids, texts, strict=True)], dtype=object)

    return run(ids, texts)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns: counts, the run of greatest exact length / period, and hashes of all runs and of the kept words."""
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = periodic_runs(of.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), into="r").select("doc_id", "r")
    each = F.arrays_zip("r.start", "r.length", "r.period")
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])  # noqa: E731  ties stay with the earlier, as runs come by start, then period
    best = F.aggregate(each, F.get(each, F.lit(0)), lambda b, x: F.when(better(x, b), x).otherwise(b))
    lines = F.array_join(F.transform(each, lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    rows = out.select("doc_id", F.size("r.start").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("r.text"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
