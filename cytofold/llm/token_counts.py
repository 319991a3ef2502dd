"""Token counts under a unigram vocabulary, without making the tokens.

The counts are those of `tokenizers` with the model Unigram(vocabulary, unk_id) behind the pre-tokenizer Metaspace, whose
words (a mark for a space, then what follows) are counted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: Below the lowest score, as fixed by the model.
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts the pieces of the best segmentation of words; counts are remembered, up to `room` of them.

    An Aho-Corasick automaton finds, end by end, every piece that ends there, longest first; the recurrence carries the best score, the
    piece count and whether the last piece is unknown. A later candidate must be strictly better, so of equal ones the longest piece wins, which
    is the model's rule. A character that is no piece itself may be unknown, and unknown neighbours are one piece.

    New words are searched as one string and advance together, place by place; a long word goes alone. Line ends that no piece
    holds part a word into runs that are counted on their own.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]], unk_id: int = 0, room: int = 600_000, long: int = 400):
        import ahocorasick

        self.find, self.known, self.runs, self.room, self.long = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}, {}, room, long
        for i, (piece, _) in enumerate(vocabulary):
            if piece:
                self.find.add_word(piece, i)
        self.find.make_automaton()
        self.unk_id = unk_id
        self.size = np.array([len(p) for p, _ in vocabulary], dtype=np.int64)
        self.score = np.array([s for _, s in vocabulary], dtype=np.float64)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        held = {c for p, _ in vocabulary for c in p}
        self.apart = "".join(c for c in "\n\r\t" if c not in held)
        self.stop = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in held)

    def word(self, word: str) -> tuple[int, bool, bool]:
        """(pieces, whether the first is unknown, whether the last is) of one word, in plain steps."""
        n, unknown = len(word), self.unknown
        score, count, first, last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        matches: list[list | None] = [None] * (n + 1)
        for end, i in self.find.iter(word):
            if matches[end + 1] is None:
                matches[end + 1] = [i]
            else:
                matches[end + 1].append(i)
        for end in range(1, n + 1):
            best, single = None, False
            for i in matches[end] or ():
                start, value = end - int(self.size[i]), float(self.score[i])
                single |= start == end - 1
                if best is None or value + score[start] > best:
                    best, at, is_unk = value + score[start], start, i == self.unk_id
            if not single and (best is None or unknown + score[end - 1] > best):
                best, at, is_unk = unknown + score[end - 1], end - 1, True
            score[end], last[end] = best, is_unk
            count[end] = count[at] + (not (is_unk and last[at]))
            first[end] = is_unk if at == 0 else first[at]
        return count[n], first[n], last[n]

    def words(self, words: list[str]) -> list[tuple[int, bool, bool]]:
        """The same for many words that hold no line end of `apart`, which go on together."""
        n = len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.find.iter(self.stop.join(words))), dtype=np.int64)
        total = int(sizes.sum()) + n
        end, piece = found[::2] + 1, found[1::2]
        size = self.size[piece]
        # places that no piece of one character covers may be unknown
        bare = np.ones(total + 1, dtype=bool)
        bare[end[size == 1]] = False
        bare[start] = False
        bare = np.nonzero(bare)[0]
        # matches come end by end, longest first; a stable sort by the place in the word keeps that
        owner = np.repeat(np.arange(n), sizes + 1)
        begin = np.append(start[owner], total)
        far = (np.arange(total + 1) - begin).astype(np.uint16)
        order = np.argsort(far[end], kind="stable")
        end, piece, size = end[order], piece[order], size[order]
        value, unk, step = self.score[piece], piece == self.unk_id, far[end]
        bare = bare[np.argsort(far[bare], kind="stable")]
        score, count = np.zeros(total + 1), np.zeros(total + 1, dtype=np.int64)
        first, last = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        longest = int(sizes.max(initial=0))
        edges = np.searchsorted(step, np.arange(1, longest + 2))
        loose = np.searchsorted(far[bare], np.arange(1, longest + 2))

        def settle(to, of, best, is_unk):
            score[to], last[to] = best, is_unk
            count[to] = count[of] + ~(is_unk & last[of])
            first[to] = np.where(of == begin[of], is_unk, first[of])

        score[bare] = -np.inf
        for a, b, c, d in zip(edges[:-1].tolist(), edges[1:].tolist(), loose[:-1].tolist(), loose[1:].tolist(), strict=True):
            if a < b:
                e, at = end[a:b], end[a:b] - size[a:b]
                cand = value[a:b] + score[at]
                head = np.nonzero(np.append(True, e[1:] != e[:-1]))[0]
                best = np.maximum.reduceat(cand, head)
                where = np.where(cand == np.repeat(best, np.diff(np.append(head, b - a))), np.arange(b - a), b - a)
                pick = np.minimum.reduceat(where, head)
                settle(e[head], at[pick], best, unk[a:b][pick])
            if c < d:
                e = bare[c:d]
                cand = score[e - 1] + self.unknown
                better = cand > score[e]
                e = e[better]
                settle(e, e - 1, cand[better], np.ones(len(e), dtype=bool))
        done = start + sizes
        return list(zip(count[done].tolist(), first[done].tolist(), last[done].tolist(), strict=True))

    def _learn(self, new: set[str]) -> None:
        parted = {w: (MARK + w).split(self.apart[0]) if len(self.apart) == 1 else _split(MARK + w, self.apart) for w in new}
        runs = {r for parts in parted.values() for r in parts if r and r not in self.runs}
        if len(self.runs) + len(runs) > self.room:
            self.runs.clear()
            runs = {r for parts in parted.values() for r in parts} - {""}
        short = [r for r in runs if len(r) <= self.long and self.stop not in r]
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            self.runs.update(zip(some, self.words(some), strict=True))
        for r in runs:
            if r not in self.runs:
                self.runs[r] = self.word(r)
        for w, parts in parted.items():
            if len(parts) == 1:
                self.known[w] = self.runs[parts[0]][0]
                continue
            total, open_ = 0, False
            for k, r in enumerate(parts):
                if k and not open_:
                    total, open_ = total + 1, True
                if r:
                    n, first, last = self.runs[r]
                    total, open_ = total + n - (open_ and first), last and (n > 1 or not open_ or first)
            self.known[w] = total

    def __call__(self, texts: Sequence[str]) -> list[int]:
        """The number of pieces of each text."""
        split = []
        for t in texts:
            words = t.replace(" ", MARK).split(MARK) if t else []
            split.append(words[1:] if words and not words[0] else words)
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = {w for words in split for w in words}
        self._learn(new)
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]


def _split(word: str, apart: str) -> list[str]:
    parts = [word]
    for c in apart:
        if c in word:
            parts = [p for x in parts for p in x.split(c)]
    return parts


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model, without its control and byte pieces; the unknown piece comes first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    unk = sp.unk_id()
    own = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if i != unk and not sp.is_control(i) and not sp.is_byte(i) and not sp.is_unused(i)]
    return [(sp.id_to_piece(unk), 0.0), *own]


@lru_cache(maxsize=2)
def counter(model: str) -> UnigramCounter:
    """One to a Python worker, so that tasks share what is remembered."""
    return UnigramCounter(vocabulary(model))


def token_counts(docs: DataFrame, model: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text, as a long. Null and empty texts have none; no shuffle.

    A very long text is counted whole, as one row. Repeated rows are counted one by one. No rows: no rows. Other columns pass through; one that is called as `into` is replaced.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model)
        for texts in batches:
            ts = texts.fillna("").tolist()
            yield pd.Series([n for i in range(0, len(ts), 500) for n in count(ts[i : i + 500])], dtype="int64")

    return docs.withColumn(into, run(F.col(text_col)))


def digest(spark, docs: DataFrame, model: str) -> DataFrame:
    return token_counts(docs, model).select("doc_id", "n_tokens")
