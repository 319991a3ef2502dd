"""Suffix order and common prefixes of a byte string by induced sorting with queues that spill to disk.

The order is right to `depth` bytes, which is all that matching strings of that length needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: A text's last byte, what parts its strings, what stands after a string that is over, and how far bytes are moved to make room: UTF-8 has none above 0xF4.
LAST, STOP, END, SHIFT = 0, 1, 0xFF, 2


def joined(parts: list[bytes]) -> np.ndarray:
    """Strings of UTF-8 bytes as one text: bytes moved by SHIFT, STOP after each, LAST at the end."""
    raw = np.frombuffer(b"\0".join(parts) + b"\0\0", dtype=np.uint8) + np.uint8(SHIFT)
    raw[np.cumsum([len(p) + 1 for p in parts]) - 1 if parts else np.zeros(0, dtype=np.int64)] = STOP
    raw[-1] = LAST
    return raw if parts else raw[-1:]


class Spool:
    """A priority queue over first bytes: for each, a queue of suffix tuples (place, common prefix with the one before).

    Induced sorting adds tuples to a byte's queue in their order, so within a byte first in is first out. Above `budget` bytes in memory, whole queues
    go to files under `folder`, block by block, and come back, about `step` tuples at a time, when their byte's turn comes.
    """

    def __init__(self, folder: str, budget: int, step: int = 1 << 17):
        self.folder, self.budget, self.step, self.held, self.files = folder, budget, step, 0, 0
        self.blocks: list[list] = [[] for _ in range(256)]
        self.store = None

    def push(self, c: int, place: np.ndarray, lcp: np.ndarray) -> None:
        if len(place):
            self.blocks[c].append((place, lcp))
            self.held += place.nbytes + lcp.nbytes
            if self.held > self.budget:
                self._spill()

    def _spill(self) -> None:
        from pyarrow import fs

        if self.store is None:
            self.store, self.base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
            self.base = f"{self.base}/{uuid.uuid4().hex}"
            self.store.create_dir(self.base, recursive=True)
        for blocks in self.blocks:
            for i, b in enumerate(blocks):
                if not isinstance(b[0], str):
                    name = f"{self.base}/{self.files}"
                    with self.store.open_output_stream(name) as f:
                        f.write(np.ascontiguousarray(b[0]).tobytes())
                        f.write(np.ascontiguousarray(b[1]).tobytes())
                    blocks[i] = (name, len(b[0]))
                    self.files += 1
        self.held = 0

    def _read(self, b) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(b[0], str):
            return b
        with self.store.open_input_stream(b[0]) as f:
            raw = f.read()
        n = b[1]
        return np.frombuffer(raw[: 8 * n], dtype=np.int64), np.frombuffer(raw[8 * n :], dtype=np.uint8)

    def _forget(self, b) -> None:
        if isinstance(b[0], str):
            self.store.delete_file(b[0])
        else:
            self.held -= b[0].nbytes + b[1].nbytes

    def _some(self, blocks: list) -> int:
        """How many of the first blocks are taken together."""
        n = k = 0
        while k < len(blocks) and (not k or n < self.step):
            b = blocks[k]
            n += b[1] if isinstance(b[0], str) else len(b[0])
            k += 1
        return k

    @staticmethod
    def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return parts[0] if len(parts) == 1 else (np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))

    def pop(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The byte's tuples in order, some blocks at a time; those that are added meanwhile come too."""
        while self.blocks[c]:
            k = self._some(self.blocks[c])
            own, self.blocks[c] = self.blocks[c][:k], self.blocks[c][k:]
            out = self._joined([self._read(b) for b in own])
            for b in own:
                self._forget(b)
            yield out

    def back(self, c: int, keep: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The byte's tuples from the last part to the first, each part in order; they stay if `keep` says so."""
        left = list(self.blocks[c])
        while left:
            k = self._some(left[::-1])
            own, left = left[-k:], left[:-k]
            out = self._joined([self._read(b) for b in own])
            if not keep:
                self.blocks[c] = left
                for b in own:
                    self._forget(b)
            yield out

    def close(self) -> None:
        if self.store is not None:
            self.store.delete_dir(self.base)


def _chunk(t: np.ndarray, start: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """Bytes at..at+8 of each string, END where it is over, as a number of the same order."""
    out = np.zeros(len(start), dtype=np.uint64)
    for j in range(at, at + 8):
        b = np.where(j < size, t[np.minimum(start + j, len(t) - 1)], END)
        out = out << np.uint64(8) | b.astype(np.uint64)
    return out


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank by place) by keys, the first being the most significant."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def _names(t: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks of strings of t; of two, one the beginning of the other, the shorter is larger, as its last byte is of type S and the longer's, at that place, of type L."""
    _, rank = _ranked(_chunk(t, start, size, 0))
    at = 8
    while True:
        open_ = np.zeros(int(rank.max(initial=0)) + 1, dtype=bool)
        open_[rank[size > at]] = True
        some = np.nonzero(open_[rank] & (np.bincount(rank)[rank] > 1))[0]
        if not len(some):
            return rank
        order, _ = _ranked(rank[some], _chunk(t, start[some], size[some], at))
        r, c = rank[some][order], _chunk(t, start[some], size[some], at)[order]
        new = np.append(False, (r[1:] != r[:-1]) | (c[1:] != c[:-1]))
        within = np.zeros(len(rank), dtype=np.int64)
        within[some[order]] = np.cumsum(new)
        _, rank = _ranked(rank, within)
        at += 8


def _seeds(t: np.ndarray, star: np.ndarray, depth: int) -> np.ndarray:
    """S* places in suffix order, right to `depth` bytes: names of S* strings, then names of pairs of names, of pairs of those, and so on.

    Each step is the reduced problem of the last; S* places are two bytes apart at least, so 2^j names reach over 2^(j+1) bytes.
    """
    size = np.diff(np.append(star, len(t) - 1)) + 1
    rank = _names(t, star, size)
    reach = 1
    while 2 * reach < depth:
        count = np.bincount(rank)
        tied = np.nonzero(count[rank] > 1)[0]
        if not len(tied):
            break
        ahead = np.where(tied + reach < len(rank), rank[np.minimum(tied + reach, len(rank) - 1)], -1)
        order = np.lexsort((ahead, rank[tied]))
        r, a = rank[tied][order], ahead[order]
        # a tied group's ranks go on from the group's first place
        first, i = np.cumsum(count) - count, np.arange(len(r))
        group = np.append(True, r[1:] != r[:-1])
        new = group | np.append(True, a[1:] != a[:-1])
        inside = np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        full = first[rank]
        full[tied[order]] = first[r] + inside
        _, rank = _ranked(full)
        reach *= 2
    return star[np.argsort(rank, kind="stable")]


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of the suffixes at a and b, up to depth."""
    out = np.zeros(len(a), dtype=np.uint8)
    live = np.arange(len(a))
    n = len(t)
    for j in range(0, depth, 8):
        x, y = a[live][:, None] + np.arange(j, min(j + 8, depth)), b[live][:, None] + np.arange(j, min(j + 8, depth))
        same = (t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)]) & (x < n) & (y < n)
        share = np.minimum.accumulate(same, axis=1).sum(axis=1)
        out[live] += share.astype(np.uint8)
        live = live[share == same.shape[1]]
        if not len(live):
            break
    return out


class _Targets:
    """For each byte the least common prefix since its queue last got a tuple."""

    def __init__(self, depth: int):
        self.depth, self.pending = depth, np.zeros(256, dtype=np.uint8)

    def induce(self, place: np.ndarray, lcp: np.ndarray, t: np.ndarray, wanted: np.ndarray, to: Spool) -> None:
        """Adds the suffixes one place before those given, where `wanted` has them. Two that follow each other in a queue share one byte more than the least between their sources."""
        before = place - 1
        ok = np.nonzero((before >= 0) & wanted[before])[0]
        least = int(lcp.min())
        if not len(ok):
            np.minimum(self.pending, least, out=self.pending)
            return
        c = t[before[ok]]
        order = np.argsort(c, kind="stable")
        ok, c = ok[order], c[order]
        head = np.nonzero(np.append(True, c[1:] != c[:-1]))[0]
        tail = np.append(head[1:], len(c))
        pending = np.minimum(self.pending, least)
        for a, b in zip(head.tolist(), tail.tolist(), strict=True):
            x, byte = ok[a:b], int(c[a])
            cuts = np.append(0, x + 1)
            whole = cuts[-1] < len(lcp)
            got = np.minimum.reduceat(lcp, cuts if whole else cuts[:-1])
            got, after = (got[:-1], got[-1]) if whole else (got, self.depth)
            got = got.copy()
            got[0] = min(got[0], self.pending[byte])
            pending[byte] = after
            to.push(byte, before[x], np.minimum(got + 1, self.depth).astype(np.uint8))
        self.pending = pending


def ordered(t: np.ndarray, folder: str, depth: int = 100, budget: int = 256 << 20, step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, common prefix with the one before) of all suffixes of t in order, both up to depth bytes. t is as joined() makes it.

    L suffixes are induced from the S* ones going up, S suffixes from the L ones going down. Types, a bit a byte, and the text stay in memory; tuples,
    nine bytes each, are in the queues.
    """
    n = len(t)
    if not n:
        return
    change = np.append(np.nonzero(t[1:] != t[:-1])[0], n - 1)
    run = np.diff(np.append(-1, change))
    up = np.append(t[change[:-1]] < t[change[:-1] + 1], True)
    small = np.repeat(up, run)
    star = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    seeds = _seeds(t, star, depth + 1) if len(star) else star
    shared = np.append(0, common(t, seeds[:-1], seeds[1:], depth)).astype(np.uint8) if len(seeds) else np.zeros(0, dtype=np.uint8)
    seed_edges = np.searchsorted(t[seeds], np.arange(257)) if len(seeds) else np.zeros(257, dtype=np.int64)
    queue, large, low = (Spool(folder, budget // 3, step) for _ in range(3))
    try:
        target, last = _Targets(depth), None
        wanted = ~small
        wanted[-1] = False

        def feed(place, lcp, wanted, queue):
            for s in range(0, len(place), step):
                target.induce(place[s : s + step], lcp[s : s + step], t, wanted, queue)

        for c in range(256):
            fresh = True
            for place, lcp in queue.pop(c):
                if fresh:
                    lcp = lcp.copy()
                    lcp[0] = 0
                    fresh = False
                feed(place, lcp, wanted, queue)
                large.push(c, place, lcp)
                last = place[-1:]
            a, b = int(seed_edges[c]), int(seed_edges[c + 1])
            if a < b:
                lcp = shared[a:b].copy()
                lcp[0] = 0 if fresh else common(t, last, seeds[a : a + 1], depth)[0]
                feed(seeds[a:b], lcp, wanted, queue)
        # going down, a tuple's common prefix is with the one above it
        queue.close()
        target, queue, wanted = _Targets(depth), Spool(folder, budget // 3, step), small
        for c in range(255, -1, -1):
            fresh = True
            for place, lcp in queue.pop(c):
                if fresh:
                    lcp = lcp.copy()
                    lcp[0] = 0
                    fresh = False
                feed(place, lcp, wanted, queue)
                low.push(c, place, lcp)
                last = place[-1:]
            after = None
            for place, lcp in large.back(c, keep=True):
                down = np.append(lcp[1:], 0 if after is None else after)[::-1].copy()
                back = place[::-1]
                if after is None:
                    down[0] = 0 if fresh else common(t, last, back[:1], depth)[0]
                feed(back, down, wanted, queue)
                fresh, after = False, lcp[0]
        low.push(LAST, np.array([n - 1]), np.zeros(1, dtype=np.uint8))
        for c in range(256):
            last = None
            for place, lcp in large.pop(c):
                yield place, lcp
                last = place[-1:]
            # the parts of S suffixes come from the last, which is the least; a tuple's prefix is with the one above, so going up it belongs to the next one
            before = None
            for place, lcp in low.back(c, keep=False):
                back = place[::-1]
                first = before if before is not None else 0 if last is None else common(t, last, back[:1], depth)[0]
                yield back, np.append(first, lcp[:0:-1]).astype(np.uint8)
                before = lcp[0]
    finally:
        for s in (queue, large, low):
            s.close()
