"""Personal data in texts: fixed patterns, and beside them a character-level bidirectional LSTM with CRF transitions, trained here in numpy from labelled spans."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns and what a match has to hold.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The same matches in time that grows with the text: an address is looked for from its @, a network's number only from where digits begin, and digits of a card are never given back.
_AT = re.compile("@" + EMAIL.partition("@")[2])
_PATTERNS = {1: re.compile("(?<![0-9])" + IP), 2: re.compile(r"[0-9](?:[\x20-]?[0-9])++"), 3: re.compile(PHONE)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What every span of any kind holds at least one of. Where a text has none, nothing is decoded.
_SIGN = re.compile("[0-9@]")
FOUND = "struct<kind: array<int>, start: array<int>, end: array<int>, base: array<boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _holds(kind: int, s: str, least_card: int) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in re.findall("[0-9]+", s))
    d = _digits(s)
    return least_card <= len(d) <= 19 and luhn(d) if kind == 2 else 8 <= len(d) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap others of their kind; those that don't hold go, and what they covered isn't searched again."""
    if not _SIGN.search(text):
        return []
    out, end = [], 0
    for m in _AT.finditer(text):
        s = m.start()
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            end = m.end()
            out.append((0, s, end))
    return out + [(k, m.start(), m.end()) for k, p in _PATTERNS.items() for m in p.finditer(text) if _holds(k, m[0], 16)]


# Characters as the model sees them: letters are alike but for a few that addresses hold often, digits are all alike, so that it learns shapes and no numbers.
_ASCII = [0] * 128
for _i in range(128):
    _c = chr(_i)
    _ASCII[_i] = 1 if _c.isdigit() else 2 if _c.islower() else 3 if _c.isupper() else 4 if _c in "\t\n\x0b\x0c\r" else 5 + "@.-+() _%/:,;#*&$!?\"'=[]{}<>|~^`\\".find(_c) if _c in "@.-+() _%/:,;#*&$!?\"'=[]{}<>|~^`\\" else 0
N_CLASSES = max(_ASCII) + 2
_CLASS = np.array([*_ASCII, N_CLASSES - 1], dtype=np.int64)
#: 0 is outside, 1 + 2k begins a span of kind k and 2 + 2k goes on with one.
N_TAGS = 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)]


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number: a span goes on only after its own kind."""
    t = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        t[:, 2 + 2 * k] = -1e4
        t[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return t


def tags(n: int, spans: Iterable[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for k, s, e in spans:
        if not out[s:e].any():
            out[s:e] = 2 + 2 * k
            out[s] = 1 + 2 * k
    return out


class Tagger:
    """Scores of tags for each character by two LSTMs, one a direction, and a chain of tags over them with learnt transitions.

    All arrays are (steps, rows, numbers), so that each step is a product over all windows. A character's class goes straight to the gates by table.
    """

    def __init__(self, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        f = np.float32
        self.p = {
            **{f"x{d}": (rng.standard_normal((N_CLASSES, 4 * h)) * 0.3).astype(f) for d in "fb"},
            **{f"h{d}": (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(f) for d in "fb"},
            "out": (rng.standard_normal((2 * h, N_TAGS)) / np.sqrt(2 * h)).astype(f),
            "bias": np.zeros(N_TAGS, dtype=f),
            "trans": np.zeros((N_TAGS, N_TAGS), dtype=f),
        }
        for d in "fb":
            self.p[f"x{d}"][:, h : 2 * h] += 1  # remember at first
        self.allowed = _allowed()

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """(steps, rows, hidden) of one direction over classes x (steps, rows). Gates: in, forget, out by logistic curves, the candidate by tanh."""
        h, (steps, rows) = self.hidden, x.shape
        wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
        out = np.empty((steps, rows, h), dtype=np.float32)
        state, cell, kept = np.zeros((rows, h), dtype=np.float32), np.zeros((rows, h), dtype=np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[t]]
            z += state @ wh
            z[:, : 3 * h] *= 0.5
            np.tanh(z, out=z)
            z[:, : 3 * h] += 1
            z[:, : 3 * h] *= 0.5
            before, cell = cell, z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            squashed = np.tanh(cell)
            if keep:
                kept.append((t, z, before, squashed, state))
            state = z[:, 2 * h : 3 * h] * squashed
            out[t] = state
        return out, kept

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, g: np.ndarray, into: dict) -> None:
        h = self.hidden
        wh, every = self.p[f"h{d}"], np.empty((*x.shape, 4 * h), dtype=np.float32)
        gh, gc = np.zeros_like(g[0]), np.zeros_like(g[0])
        for t, z, before, squashed, state in reversed(kept):
            gh = gh + g[t]
            i, f, o, c = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            gc = gc + gh * o * (1 - squashed * squashed)
            gz = every[t]
            gz[:, :h], gz[:, h : 2 * h], gz[:, 2 * h : 3 * h], gz[:, 3 * h :] = gc * c * i, gc * before * f, gh * squashed * o, gc * i * (1 - c * c)
            gz[:, : 3 * h] *= 1 - z[:, : 3 * h]
            into[f"h{d}"] += state.T @ gz
            gh, gc = gz @ wh.T, gc * f
        flat, shown = every.reshape(-1, 4 * h), x.ravel()
        order = np.argsort(shown, kind="stable")
        kinds, first = np.unique(shown[order], return_index=True)
        into[f"x{d}"][kinds] += np.add.reduceat(flat[order], first, axis=0)

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, kf = self._lstm(x, "f", keep)
        b, kb = self._lstm(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["out"] + self.p["bias"], both, kf, kb

    def _step(self) -> np.ndarray:
        return self.p["trans"].astype(np.float64) + self.allowed

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y a window, and its gradients."""
        e, both, kf, kb = self.emissions(x, keep=True)
        e = e.astype(np.float64)
        steps, rows, _ = e.shape
        step, start = self._step(), self.allowed[0]
        fwd, back = np.empty_like(e), np.zeros_like(e)
        fwd[0] = e[0] + start
        ahead_of = np.exp(step)

        def through(a: np.ndarray, m: np.ndarray) -> np.ndarray:
            """log(exp(a) m), rows shifted by their maxima."""
            top = a.max(1, keepdims=True)
            return np.log(np.exp(a - top) @ m + 1e-300) + top

        for t in range(1, steps):
            fwd[t] = e[t] + through(fwd[t - 1], ahead_of)
        for t in range(steps - 2, -1, -1):
            back[t] = through(e[t + 1] + back[t + 1], ahead_of.T)
        z = through(fwd[-1], np.ones((N_TAGS, 1)))[:, 0]
        r = np.arange(rows)
        real = start[y[0]] + sum(e[t, r, y[t]] for t in range(steps)) + sum(step[y[t - 1], y[t]] for t in range(1, steps))
        ge = np.exp(fwd + back - z[None, :, None])
        ge[np.arange(steps)[:, None], r, y] -= 1
        ahead, top = e[1:] + back[1:], fwd[:-1].max(2, keepdims=True)
        pairs = np.exp(fwd[:-1] - top).reshape(-1, N_TAGS).T @ np.exp(np.minimum(ahead + top - z[None, :, None], 600)).reshape(-1, N_TAGS)
        gt = pairs * ahead_of - np.bincount((y[:-1] * N_TAGS + y[1:]).ravel(), minlength=N_TAGS * N_TAGS).reshape(N_TAGS, N_TAGS)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        ge = (ge / rows).astype(np.float32)
        g["trans"] += (gt / rows).astype(np.float32)
        g["bias"] += ge.sum((0, 1))
        g["out"] += both.reshape(-1, both.shape[2]).T @ ge.reshape(-1, N_TAGS)
        gb = ge @ self.p["out"].T
        self._lstm_back(x, "f", kf, gb[:, :, : self.hidden], g)
        self._lstm_back(x, "b", kb, gb[:, :, self.hidden :], g)
        return float((z - real).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 10, batch: int = 100, rate: float = 0.015, seed: int = 1, tries: int = 4, enough: float = 1.0) -> Tagger:
        """Adam over shuffled windows (steps, windows); the same at every run.

        What is kept are the weights after the round of least mean loss. Where that isn't under `enough` a window, as when long steps threw the gates out of range, all begins again with half the rate, `tries` times at most.
        """
        first, best, least = {k: a.copy() for k, a in self.p.items()}, self.p, np.inf
        for k in range(tries):
            self.p = {name: a.copy() for name, a in first.items()}
            for loss in self._rounds(x, y, rounds, batch, rate / 2**k, seed):
                if loss < least:
                    best, least = {name: a.copy() for name, a in self.p.items()}, loss
                elif loss > 4 * least and loss > enough:
                    break
            if least < enough:
                break
        self.p = best
        return self

    def _rounds(self, x: np.ndarray, y: np.ndarray, rounds: int, batch: int, rate: float, seed: int) -> Iterator[float]:
        rng, n = np.random.default_rng(seed), x.shape[1]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, last = 0, rounds * -(-n // batch)
        for _ in range(rounds):
            order, losses = rng.permutation(n), []
            for s in range(0, n, batch):
                rows = order[s : s + batch]
                loss, g = self.loss(x[:, rows], y[:, rows])
                losses.append(loss)
                step += 1
                size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k, a in g.items():
                    a = a * min(1.0, 5 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.99 * v[k] + 0.01 * a * a
                    warm = min(1.0, step / 30) * (1 - 0.95 * step / last)
                    self.p[k] -= (rate * warm * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            yield float(np.mean(losses))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, scores) of windows (steps, rows): the best chain of each, and what each character's tag gains over being outside, its transition counted in."""
        e = self.emissions(x)[0].astype(np.float64)
        steps, rows, _ = e.shape
        step, r = self._step(), np.arange(rows)
        best, came = e[0] + self.allowed[0], np.empty((steps, rows, N_TAGS), dtype=np.int8)
        for t in range(1, steps):
            a = best[:, :, None] + step
            came[t] = a.argmax(1)
            best = np.take_along_axis(a, came[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        y = np.empty((steps, rows), dtype=np.int64)
        y[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            y[t - 1] = came[t, r, y[t]]
        gain = e[np.arange(steps)[:, None], r, y] - e[:, :, 0]
        gain[1:] += step[y[:-1], y[1:]] - step[0, 0]
        return y, gain


def starts(n: int, width: int) -> np.ndarray:
    """Where the windows of a text of n characters begin: half a width apart, so that all but the outer characters are in two."""
    return np.arange(0, max(1, n - width // 2), width // 2)


def windows(text: str, width: int, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, classes of width x windows), `room` windows at a time, of those that hold a digit or an @; each span has one, so the others have nothing to find. Past the end of a text there are line ends."""
    if not _SIGN.search(text):
        return
    at = starts(len(text), width)
    signs = np.fromiter((m.start() for m in _SIGN.finditer(text)), dtype=np.int64)
    at = at[np.searchsorted(signs, at + width) > np.searchsorted(signs, at)]
    for b in range(0, len(at), room):
        own = at[b : b + room]
        out = np.full((width, len(own)), _ASCII[10], dtype=np.int64)
        for k, s in enumerate(own.tolist()):
            c = classes(text[s : s + width])
            out[: len(c), k] = c
        yield own, out


def reconciled(found: Sequence[tuple[float, int, int, int]], base: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of candidates (score, kind, start, end) from all windows of a text those that overlap neither each other nor a base span, with the greatest sum of scores; of equal sums the one whose last span ends earlier."""
    taken = sorted((s, e) for _, s, e in base)
    bs, be = np.array([s for s, _ in taken], dtype=np.int64), np.maximum.accumulate(np.array([e for _, e in taken], dtype=np.int64)) if taken else np.zeros(0, dtype=np.int64)
    own: dict[tuple[int, int, int], float] = {}
    for score, k, s, e in found:
        at = int(np.searchsorted(bs, e))
        if not (at and be[at - 1] > s):
            own[k, s, e] = max(score, own.get((k, s, e), score))
    spans = sorted(own, key=lambda x: (x[2], x[1], x[0]))
    ends = np.array([x[2] for x in spans], dtype=np.int64)
    best, back = [0.0], []
    for i, x in enumerate(spans):
        before = int(np.searchsorted(ends[:i], x[1], side="right"))
        with_it = best[before] + own[x]
        back.append(before if with_it > best[-1] else -1)
        best.append(max(with_it, best[-1]))
    out, i = [], len(spans)
    while i:
        if back[i - 1] < 0:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = back[i - 1]
    return out[::-1]


def _trimmed(text: str, kind: int, s: int, e: int) -> tuple[int, int] | None:
    """The span less what no span of its kind begins or ends with; None if what is left can't be one."""
    edge = re.compile(r"[A-Za-z0-9._%+-]" if kind == 0 else "[0-9+(]" if kind == 3 else "[0-9]")
    last = re.compile("[A-Za-z0-9]" if kind == 0 else "[0-9]")
    while s < e and not edge.match(text[s]):
        s += 1
    while s < e and not last.match(text[e - 1]):
        e -= 1
    x = text[s:e]
    near = text[s - 1 : s] + text[e : e + 1]
    if kind == 0:
        parts = re.fullmatch(r"[^@]*[A-Za-z0-9][^@]*@[^@]*[A-Za-z0-9][^@]*", x)
        return (s, e) if parts and re.search(r"[A-Za-z0-9][^@A-Za-z0-9]*\.|\W(dot)\W", x[x.index("@") :]) else None
    if re.search("[A-Za-z0-9]", near) or re.search("[A-Za-z@]", x):
        return None
    if kind == 1 and len(re.findall("[0-9]+", x)) != 4:
        return None
    return (s, e) if _holds(kind, x, 13) else None


class Finder:
    """A tagger with the width of its windows and the score from which a span counts."""

    def __init__(self, tagger: Tagger, width: int, least: float):
        self.tagger, self.width, self.least = tagger, width, least

    def candidates(self, texts: Sequence[str], room: int = 2048) -> Iterator[tuple[int, float, int, int, int]]:
        """(text, score, kind, start, end) of what the windows show, those of many texts at a time. A span cut by a window's edge is left to the next window."""
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        count = 0
        for i, t in enumerate(texts):
            for at, x in windows(t, self.width, room):
                held.append((i, at, x))
                count += len(at)
                if count >= room:
                    yield from self._decoded(texts, held)
                    held, count = [], 0
        if held:
            yield from self._decoded(texts, held)

    def _decoded(self, texts: Sequence[str], held: list) -> Iterator[tuple[int, float, int, int, int]]:
        x = np.concatenate([c for _, _, c in held], axis=1)
        of, at = np.concatenate([np.full(len(a), i) for i, a, _ in held]), np.concatenate([a for _, a, _ in held])
        y, gain = self.tagger.decode(x)
        b, w = np.nonzero((y.T % 2 == 1))[::-1]
        for t, r in zip(b.tolist(), w.tolist(), strict=True):
            kind, u, n = int(y[t, r] - 1) // 2, t + 1, len(texts[of[r]]) - int(at[r])
            while u < self.width and y[u, r] == 2 + 2 * kind:
                u += 1
            if (t == 0 and at[r] > 0) or (u == self.width and n > self.width):
                continue
            score = float(gain[t:u, r].sum())
            if score >= self.least:
                yield int(of[r]), score, kind, int(at[r]) + t, int(at[r]) + min(u, n)

    def spans(self, texts: Sequence[str]) -> list[list[tuple[int, int, int, bool]]]:
        """(kind, start, end, whether a base pattern found it) of each text, by kind, then start."""
        found: dict[int, list] = {}
        for i, score, k, s, e in self.candidates(texts):
            if cut := _trimmed(texts[i], k, s, e):
                found.setdefault(i, []).append((score, k, *cut))
        out = []
        for i, t in enumerate(texts):
            base = base_spans(t)
            more = reconciled(found[i], base) if i in found else []
            out.append(sorted([(*x, True) for x in base] + [(*x, False) for x in more]))
        return out


def redrawn(text: str, spans: Sequence[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans rewritten, and where they are then: digits and letters drawn anew, and some in the ways in which people disguise or vary them.

    Addresses: spaces around the @. Numbers of networks: (.) or [.] for dots. Cards: other spacing. Telephones: no + or 00 in its place, other punctuation.
    """
    digit = lambda m: str(rng.integers(0, 10))
    letter = lambda m: chr(97 + rng.integers(0, 26))
    out, at, told = [], 0, []
    for k, s, e in sorted(spans, key=lambda x: x[1]):
        if s < at:
            continue
        x = re.sub("[0-9]", digit, text[s:e])
        way = int(rng.integers(0, 4))
        if k == 0:
            x = re.sub("[a-z]", letter, x)
            if way == 0:
                x = x.replace("@", str(rng.choice([" @ ", "@ ", " @"])))
            elif way == 1:
                x = re.sub(r"[^@]+$", lambda m: "".join(letter(None) for _ in range(rng.integers(3, 10))) + "." + str(rng.choice(["com", "org", "net", "co.uk", "de", "io"])), x)
        elif k == 1:
            x = ".".join(str(rng.integers(0, 256)) for _ in range(4))
            if way == 0:
                x = x.replace(".", str(rng.choice(["[.]", "(.)", " . "])))
        elif k == 2:
            d = _digits(x)[: int(rng.integers(13, 20))]
            if way == 0:
                sep = str(rng.choice([" ", "-", ".", "  ", "/"]))
                d = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
            x = d
        else:
            d = _digits(x)
            if way == 0:
                x = str(rng.choice(["00", "0", ""])) + x[1:]
            elif way == 1:
                sep = str(rng.choice([" ", ".", "-", "/"]))
                x = str(rng.choice(["+", "00", ""])) + sep.join([d[:2], d[2:5], d[5:8], d[8:]]).rstrip(sep)
        out.append(text[at:s])
        told.append((k, sum(map(len, out)), sum(map(len, out)) + len(x)))
        out.append(x)
        at = e
    out.append(text[at:])
    return "".join(out), told


def decoy(text: str, rng: np.random.Generator) -> str:
    """The text with something beside it that holds digits and is none of the kinds: a date, an amount, a version, a hexadecimal token, a count."""
    n = lambda a, b: str(rng.integers(a, b))
    kinds = [
        lambda: f"{n(1900, 2030)}-{n(10, 13)}-{n(10, 29)}",
        lambda: f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}",
        lambda: f"{n(1, 29)}/{n(1, 13)}/{n(1900, 2030)} {n(10, 24)}:{n(10, 60)}",
        lambda: f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}",
        lambda: f"v{n(1, 9)}.{n(0, 20)}.{n(0, 20)}",
        lambda: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, int(rng.integers(8, 41)))),
        lambda: n(0, 10_000_000),
        lambda: f"{n(1900, 2030)}-{n(1900, 2030)}",
        lambda: f"@{'abcdefgh'[: int(rng.integers(3, 8))]}",
        lambda: f"{n(1, 99)} {n(1, 99)} {n(1, 99)}",
        lambda: f"{n(10**11, 10**12)}",
    ]
    at = [m.end() for m in re.finditer(" ", text)]
    if not at:
        return text
    k = at[int(rng.integers(0, len(at)))]
    return f"{text[:k]}{kinds[int(rng.integers(0, len(kinds)))]()} {text[k:]}"


def examples(texts: Sequence[str], width: int, n: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags), each width x n: windows of texts with their base spans as labels, half of them as they are and half redrawn; windows without spans, and decoys, beside them."""
    rng = np.random.default_rng(seed)
    x, y = np.full((width, n), _ASCII[10], dtype=np.int64), np.zeros((width, n), dtype=np.int64)
    rich = [(t, base_spans(t)) for t in texts]
    marked = [(t, s) for t, s in rich if s]
    for k in range(n):
        if marked and k % 4 != 3:
            t, spans = marked[int(rng.integers(0, len(marked)))]
            _, s, e = spans[int(rng.integers(0, len(spans)))]
            lo = max(0, s - int(rng.integers(0, max(1, width - (e - s)))))
            hi = lo + width
            own = [(kind, a - lo, b - lo) for kind, a, b in spans if a >= lo and b <= hi]
            # a span cut by the window's edge is left out whole, so that no part of one is called clean
            for _, a, b in spans:
                if a < lo < b:
                    own, lo = [(kind, p - (b - lo), q - (b - lo)) for kind, p, q in own if p >= b - lo], b
                elif lo <= a < hi < b:
                    hi = a
            part = t[lo:hi]
            own = [o for o in own if o[2] <= len(part)]
            if k % 2:
                part, own = redrawn(part, own, rng)
        elif rich:
            t = rich[int(rng.integers(0, len(rich)))][0]
            lo = int(rng.integers(0, max(1, len(t) - width)))
            part = decoy(t[lo : lo + width // 2], rng)
            own = base_spans(part)
            own = [o for o in own if all(o is p or o[2] <= p[1] or o[1] >= p[2] for p in own)]
        else:
            continue
        own = [o for o in own if o[2] <= width]
        c = classes(part[:width])
        x[: len(c), k], y[: len(c), k] = c, tags(len(c), own)
    return x, y


def train(docs: DataFrame, text_col: str = "text", limit: int = 1500, n: int = 3000, width: int = 96, hidden: int = 16, least: float = 3.0, longest: int = 1000) -> Finder:
    """A finder fitted on the driver: labelled spans are those of the base patterns in a bounded sample of at most `limit` texts that hold some, and windows of theirs, redrawn or not, `n` in all.

    The sample is that of the least hashes of texts, the same at every run, each text once; of longer ones a piece of `longest` characters around a span goes to the driver. How low a hash has to be follows
    from the number of texts that hold spans, so that only about twice `limit` texts are looked at again and meet in one place, whatever the size of the table. Texts without any span anywhere: a finder that finds nothing new.
    """

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, h in zip(b["text"], b["h"], strict=True):
                if spans := base_spans(t):
                    s = max(0, min(spans[h % len(spans)][1] - longest // 2, len(t) - longest))
                    rows.append((t[s : s + longest], h))
            yield pd.DataFrame(rows, columns=["text", "h"])

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[bool(base_spans(t)) for t in b["text"]], ["h"]] if len(b) else b[["h"]]

    some = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    holding = some.mapInPandas(marked, "h long").agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share = min(1.0, 2 * limit / max(1, holding))
    low = some.where(F.col("h") <= int(min(2**63 - 1, -(2**63) + share * 2**64)))
    rows = low.mapInPandas(near, "text string, h long").dropDuplicates(["h"]).orderBy("h", "text").limit(limit).collect()
    tagger = Tagger(hidden)
    if rows:
        x, y = examples([r["text"] for r in rows], width, n)
        tagger.fit(x, y)
    return Finder(tagger, width, least if rows else float("inf"))


def personal_data(docs: DataFrame, finder: Finder, text_col: str = "text", into: str = "_personal") -> DataFrame:
    """docs with a struct `into` of all spans of personal data, by kind (a place in KINDS), then start: kind, start, end (code points, end exclusive) and whether a base pattern found it.

    Base spans are what the patterns say. Beside them the tagger reads overlapping windows of the whole text, those that hold a digit or an @, as every span does; candidates of all windows
    are reconciled over the text by the greatest sum of scores without overlaps, none over a base span. A candidate also has to be possible: cards of 13 to 19 digits that pass
    Luhn, four parts of at most 255, 8 to 15 digits of a telephone, an @ and a dot after it.

    No shuffle. Null and empty texts hold nothing. Very long texts are gone through 2,048 windows at a time; a span longer than half a window is seen by the base patterns alone. Repeated rows are each treated alike. No rows: no rows. Other columns pass through; one that is called as `into` is replaced.
    """

    @F.pandas_udf(FOUND)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = finder.spans(texts.fillna("").tolist())
        return pd.DataFrame([[np.array([x[c] for x in f], dtype=kind) for c, kind in enumerate((np.int32, np.int32, np.int32, bool))] for f in found], columns=["kind", "start", "end", "base"])

    return docs.withColumn(into, run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns; n_email to n_phone count the base spans, n_added those of the tagger."""
    of = docs.select("doc_id", "text")
    out = personal_data(of, train(of), into="p").select("doc_id", F.arrays_zip("p.kind", "p.start", "p.end", "p.base").alias("s"))
    names = F.array(*map(F.lit, KINDS))
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["base"])
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("s")).alias("spans"), F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_added"))
