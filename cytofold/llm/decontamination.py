"""Benchmark decontamination: passages of benchmark items in documents, by the q-gram lemma and banded alignment."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytofold.llm.common import batches_of, drop_durable, durable, free

#: ASCII characters that are neither letters nor digits become spaces.
_SPACED = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))
#: Code points of ASCII words, 128 standing for all above, and the scripts (first and last code point) that put no space between words.
_WORD = np.array([x < 128 and chr(x).isalnum() for x in range(129)])
_UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
LEAK = "array<struct<item_id: bigint, edits: int, lo: bigint, hi: bigint>>"


def normal(text: str) -> str:
    """Lower case, with one space for whatever parts words: what is compared."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()).decode("utf-8", "surrogatepass")


def letters(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _in_word(x: np.ndarray) -> np.ndarray:
    return _WORD[np.minimum(x, 128)]


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q numbers (bytes or code points) from each place on, made by doubling: a hash of 2n is one of n and the next n."""
    c = [0x9E3779B97F4A7C15]
    one = b.astype(np.uint64)
    one = (one + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    have, total, size, need, bit, done = one, None, 0, q, 1, 0
    with np.errstate(over="ignore"):
        while need:
            if need & 1:
                n = len(b) - q + 1
                if n <= 0:
                    return np.zeros(0, dtype=np.uint64)
                part = have[done : done + n]
                total = part.copy() if total is None else total * np.uint64(pow(c[0], bit, 1 << 64)) + part
                done += bit
            need >>= 1
            if need:
                have = have[:-bit] * np.uint64(pow(c[0], bit, 1 << 64)) + have[bit:]
                bit *= 2
        total ^= total >> np.uint64(31)
        return total * np.uint64(0xBF58476D1CE4E5B9)


def _parted(a: str, b: str) -> bool:
    """Whether a word may end between two characters: one of them is in no word, or of a script that puts no space between words."""
    word = lambda c: unicodedata.category(c)[0] in "LMN"
    return not (word(a) and word(b)) or any(lo <= ord(c) <= hi for c in (a, b) for lo, hi in _UNSPACED)


class Exact:
    """Items too short for edits, found verbatim where they start and end at word boundaries. They are looked up by their first 1, 2, 4 or 8 characters, then compared."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.groups = []
        for n, top in ((1, 2), (2, 4), (4, 8), (8, None)):
            own = [(i, b) for i, b in items if n <= len(b) and (top is None or len(b) < top)]
            if not own:
                continue
            hashes = np.array([grams(b[:n], n)[0] for _, b in own], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            size = np.array([len(own[x][1]) for x in order], dtype=np.int64)
            table = np.zeros((len(own), int(size.max())), dtype=np.uint32)
            for r, x in enumerate(order.tolist()):
                table[r, : size[r]] = own[x][1]
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.groups.append((n, np.array([own[x][0] for x in order], dtype=np.int64), size, table, *np.unique(hashes[order], return_index=True, return_counts=True), seen))

    def __call__(self, text: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, lo, hi) of the first place of each item in each document. Documents have zeros behind them."""
        before = np.append(np.uint32(0), text[:-1])
        begin = ~_in_word(before) | (text >= 128)
        for n, ids, size, table, hashes, first, count, seen in self.groups:
            h = grams(text, n)
            at = np.nonzero(begin[: len(h)] & seen[(h >> np.uint64(48)).astype(np.int64)])[0]
            row = np.searchsorted(hashes, h[at])
            row[row == len(hashes)] = 0
            at, row = at[hashes[row] == h[at]], row[hashes[row] == h[at]]
            held: set[tuple[int, int]] = set()
            for s in range(0, len(at), 1 << 14):
                a, r = at[s : s + (1 << 14)], row[s : s + (1 << 14)]
                c = count[r]
                where = np.repeat(a, c)
                item = np.repeat(first[r] - np.cumsum(c) + c, c) + np.arange(len(where))
                same = np.zeros(len(where), dtype=bool)
                lane = np.arange(table.shape[1])
                for t in range(0, len(where), 1 << 16):
                    x = slice(t, t + (1 << 16))
                    got = text[np.minimum(where[x, None] + lane, len(text) - 1)]
                    same[x] = ((got == table[item[x]]) | (lane >= size[item[x], None])).all(axis=1)
                where, item = where[same], item[same]
                doc = np.searchsorted(start, where, side="right") - 1
                after = text[where + size[item]]
                plain = np.isin(before[where], (0, 32)) & np.isin(after, (0, 32))
                maybe = ~(_in_word(after) & _in_word(text[where + size[item] - 1]))
                for w, i, d, sure in zip(where[maybe].tolist(), item[maybe].tolist(), doc[maybe].tolist(), plain[maybe].tolist(), strict=True):
                    if (d, i) in held:
                        continue
                    hi = w + int(size[i])
                    if sure or self._word(text, w, hi):
                        held.add((d, i))
                        yield d, int(ids[i]), w - int(start[d]), hi - int(start[d])

    def _word(self, text: np.ndarray, lo: int, hi: int) -> bool:
        say = lambda x: chr(int(text[x])) if 0 <= x < len(text) else "\0"
        return _parted(say(lo - 1), say(lo)) and _parted(say(hi - 1), say(hi))


class Index:
    """The q-grams of probes: of each item as a whole or, if it is longer than `window`, of windows that overlap by half, and beside those of each item's excerpts, windows of `excerpt` characters that overlap by half.

    A probe of m characters may be edited in k = m * rate places. By the q-gram lemma an alignment of at most k edits keeps
    m - q + 1 - k * q of the probe's q-grams, on diagonals that differ by k at most. The excerpts see whatever holds 3/2 `excerpt` characters of an item in one piece; the longer
    probes see what has more edits than an excerpt may have in one place. Items of under `least` characters can't be told from prose once edited, so they count verbatim, between word boundaries.
    """

    def __init__(self, items: list[tuple[int, str]], q: int = 10, rate: float = 0.08, window: int = 256, least: int = 40, excerpt: int = 100):
        self.q, probes, ids, short = q, [], [], []
        for i, text in items:
            b = letters(normal(text))
            if len(b) < least:
                if len(b):
                    short.append((i, b))
                continue
            for w in (window, excerpt):
                if w == excerpt and len(b) <= min(window, excerpt):
                    continue
                starts = [0] if len(b) <= w else [*range(0, len(b) - w, w // 2), len(b) - w]
                for s in starts:
                    probes.append(b[s : s + w])
                    ids.append(i)
        self.exact = Exact(short)
        self.probes, self.ids = probes, np.array(ids, dtype=np.int64)
        self.size = np.array([len(p) for p in probes], dtype=np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), np.maximum(0, (self.size - q) // q))
        self.need = np.maximum(1, self.size - q + 1 - self.edits * q)
        self.longest = int(self.size.max(initial=1))
        hashes = [grams(p, q) for p in probes]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        probe = np.repeat(np.arange(len(probes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.probe, self.place = probe[order].astype(np.int32), place[order].astype(np.int32)
        self.hash, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(16, int(len(flat)).bit_length() + 7))
        self.seen = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.seen[(self.hash >> self.shift).astype(np.int64)] = True

    def _regions(self, text: np.ndarray, start: np.ndarray, most: int = 1 << 23) -> np.ndarray:
        """(document, probe, lowest diagonal) of the diagonal bands that hold enough of a probe's q-grams. Bands are 2k + 2 wide and overlap by half."""
        h = grams(text, self.q)
        at = np.nonzero(self.seen[(h >> self.shift).astype(np.int64)])[0]
        row = np.searchsorted(self.hash, h[at])
        row[row == len(self.hash)] = 0
        real = self.hash[row] == h[at]
        at, row = at[real], row[real]
        # all entries of a common q-gram at once would take memory without bound, so probes are gone through in ranges and places in steps
        count = self.count[row]
        steps = list(batches_of(count, most))
        ranges = -(-int(count.sum()) // most)
        found = [np.zeros((3, 0), dtype=np.int64)]
        for r in range(ranges):
            lo, hi = (len(self.probes) * k // ranges for k in (r, r + 1))
            parts = []
            for s, t in steps:
                n = count[s:t]
                where = np.repeat(at[s:t], n)
                entry = np.repeat(self.first[row[s:t]] - np.cumsum(n) + n, n) + np.arange(len(where))
                own = (self.probe[entry] >= lo) & (self.probe[entry] < hi)
                parts.append((where[own], self.probe[entry[own]], self.place[entry[own]]))
            found.append(self._bands(*(np.concatenate(x) for x in zip(*parts, strict=True)), start))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def _bands(self, at: np.ndarray, probe: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The same of q-grams of some probes, given by their places in text and probe."""
        doc = np.searchsorted(start, at, side="right") - 1
        diagonal = at - start[doc] - place + self.longest
        half = self.edits[probe] + 1
        key = doc * np.int64(len(self.probes)) + probe
        found = []
        for grid in (0, 1):
            band = (diagonal + grid * half) // (2 * half)
            # a q-gram of the probe counts once in a band, however often the document repeats it
            span = np.int64(1 << 22)
            both = np.stack([key, band * span + place])
            order = np.lexsort(both[::-1])
            k, b = both[:, order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
            k, b = k[new], b[new] // span
            edge = np.ones(len(k), dtype=bool)
            edge[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
            first = np.nonzero(edge)[0]
            enough = np.diff(np.append(first, len(k))) >= self.need[k[first] % len(self.probes)] if len(first) else np.zeros(0, dtype=bool)
            k, b = k[first][enough], b[first][enough]
            d, p = k // len(self.probes), k % len(self.probes)
            found.append(np.stack([d, p, b * 2 * (self.edits[p] + 1) - grid * (self.edits[p] + 1) - self.longest]))
        return np.concatenate(found, axis=1)

    def _align(self, text, start, size, d, p, low):
        """(edits, end) of the best alignment of each whole probe p in document d, on diagonals from low - k to low + 3k + 2; the ends of the document's part are free.

        Cells of a row are diagonals. Insertions run along the row, and their minimum is a running minimum less the diagonal.
        """
        k = self.edits[p]
        width = int((4 * k + 3).max())
        base = low - k
        lane = np.arange(width)
        off = lane[None, :] > (4 * k + 2)[:, None]
        big = np.int32(1 << 20)
        padded = np.zeros((len(p), self.longest), dtype=np.uint32)
        for r, x in enumerate(p.tolist()):
            padded[r, : self.size[x]] = self.probes[x]
        cost = np.where(off, big, 0).astype(np.int32)
        best, end = np.full(len(p), big, dtype=np.int64), np.zeros(len(p), dtype=np.int64)
        for i in range(int(self.size[p].max())):
            where = base[:, None] + lane[None, :] + i
            inside = (where >= 0) & (where < size[d][:, None])
            letter = text[np.where(inside, where + start[d][:, None], 0)]
            step = cost + ((letter != padded[:, i : i + 1]) | ~inside)
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - lane, axis=1) + lane
            cost = np.where(off, big, cost).astype(np.int32)
            over = np.nonzero(self.size[p] == i + 1)[0]
            if len(over):
                best[over] = cost[over].min(axis=1)
                end[over] = base[over] + cost[over].argmin(axis=1) + i + 1
        return best, end

    def __call__(self, texts: list[str], block: int = 1 << 20) -> list[list[tuple[int, int, int, int]]]:
        """For each normalised text its leaks (item, edits, lo, hi): for each item the longest probe found and of those the fewest edits, and the passage's place in the normalised text.

        Texts over `block` characters are gone through in parts that overlap by more than a probe; what is within `margin` of a cut is left to the part that holds it whole.
        """
        out: list[list] = [[] for _ in texts]
        if not self.probes and not self.exact.groups:
            return out
        margin = 8
        step = max(1, block - self.longest - int(self.edits.max(initial=0)) - 64 - 2 * margin)
        parts = [(i, s, min(len(t), s + block), s + block >= len(t)) for i, t in enumerate(texts) for s in range(0, max(1, len(t) if len(t) <= block else len(t) - block + step), step)]
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for lo_, hi_ in batches_of(np.array([e - s for _, s, e, _ in parts], dtype=np.int64), block):
            own = parts[lo_:hi_]
            size = np.array([e - s for _, s, e, _ in own], dtype=np.int64)
            start = np.cumsum(size + self.q) - size - self.q
            text = letters("".join(texts[i][s:e] + "\0" * self.q for i, s, e, _ in own))

            def add(d: int, item: int, rank: int, edits: int, lo: int, hi: int, own=own) -> None:
                i, base, end, last = own[d]
                if (base and lo < margin) or (not last and hi > end - base - margin):
                    return
                new = (rank, edits, lo + base, hi + base)
                best[i, item] = min(best.get((i, item), new), new)

            for d, item, lo, hi in self.exact(text, start):
                add(d, item, lo - hi, 0, lo, hi)
            d, p, low = self._regions(text, start) if self.probes else np.zeros((3, 0), dtype=np.int64)
            order = np.argsort(self.size[p], kind="stable")
            d, p, low = d[order], p[order], low[order]
            for s in range(0, len(d), 256):
                x = slice(s, s + 256)
                edits, end = self._align(text, start, size, d[x], p[x], low[x])
                for dd, pp, e, hi in zip(d[x].tolist(), p[x].tolist(), edits.tolist(), end.tolist(), strict=True):
                    if e <= self.edits[pp]:
                        add(dd, int(self.ids[pp]), -int(self.size[pp]), e, max(0, hi - int(self.size[pp])), hi)
        for (i, item), leak in sorted(best.items()):
            out[i].append((item, *leak[1:]))
        return out


_INDEXES: dict[str, Index] = {}


def _index(name: str, held, options: dict) -> Index:
    """The index of a slice of the benchmark, made once in a Python worker; the last one is kept."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(held.value, **options)
    return _INDEXES[name]


def _search(held, options: dict):
    name = uuid.uuid4().hex

    @F.pandas_udf(LEAK)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index(name, held, options)
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "edits", "lo", "hi"), x, strict=True)) for x in leaks] for leaks in index([normal(t) for t in texts.fillna("")])])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "_leaks", slice_bytes: int = 32 << 20, **options) -> DataFrame:
    """docs with an array of the benchmark items that leak into each whole text: struct(item_id, edits, lo, hi), lo and hi in the normalised text.

    The benchmark is sent to the executors in slices of about slice_bytes (an item is in one slice), one slice after another: between two, documents and what was found are written to the shared folder, so that what is
    sent and indexed at once is bounded however large the benchmark is. Documents are never shuffled. Null and empty texts have no leaks; items that are null or hold no letter or digit are left out, and
    repeated items are one. A very long text is searched whole, as one row; repeated rows are searched one by one. No documents: no rows; no items: no leaks. Other columns pass through; one that is called as `into` is replaced.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    if slices > 1:
        items = durable(items, "benchmark-items")
    out, last = docs.drop(into) if into in docs.columns else docs, None
    more = free(docs.columns, "_more")
    for s in range(slices):
        part = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s).orderBy("item_id", "text").collect()]
        held = docs.sparkSession.sparkContext.broadcast(part)
        found = _search(held, options)(F.col(text_col))
        out = out.withColumn(into, found) if not s else out.withColumn(more, found).withColumn(into, F.concat(into, more)).drop(more)
        if s < slices - 1:
            out = durable(out, "benchmark-slice")
            held.unpersist()
            drop_durable(last)
            last = out
    return out


def digest(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.array_distinct(F.transform("_leaks", lambda x: x["item_id"])))
    return out.select("doc_id", (F.size("_leaks") > 0).cast("int").alias("contaminated"), ids.alias("item_ids"), F.array_min(F.transform("_leaks", lambda x: x["edits"])).alias("least_edits"))
