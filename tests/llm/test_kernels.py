"""Kernels of the text operators against plain computations."""

import numpy as np
import pytest

from cytofold.llm import suffix_dedup
from cytofold.llm.common import roots
from cytofold.llm.decontamination import Index, normal
from cytofold.llm.embedding_dedup import Quantised, plan
from cytofold.llm.minhash_dedup import linked_sets, mix, shingles, signatures
from cytofold.llm.packing import Encoder, cut, fill
from cytofold.llm.suffix import joined, ordered
from cytofold.llm.token_counts import UnigramCounter, vocabulary

TEXTS = ["", " ", "a", " x", "a  b", "a \nb ", "it's 'tis we'll <|endoftext|> x", "don 't", "é ñ 😀😀 ß", "日本語 テキスト", "x" * 1500, "a\n\n\nb\t c", "word,word. (word)\nNext; line"]


def test_chunks_are_what_the_tokenizer_says():
    import public_tokenizers

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert Encoder(path)(TEXTS) == [np.asarray(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in TEXTS]


def test_counts_are_those_of_the_unigram_model():
    import public_tokenizers

    from tokenizers import Tokenizer, models, pre_tokenizers

    v = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(v, 0))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = [*TEXTS, "▁x ▁▁y", "\n日\n日 日日\n", "the cat\nsat 漢字漢"]
    assert UnigramCounter(v)(texts) == [len(t.encode(x).ids) for x in texts]
    ties = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0)]
    t = Tokenizer(models.Unigram(ties, 0))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = ["ab", "aba abab", "bbab", "xab xx", "axxb"]
    assert UnigramCounter(ties)(texts) == [len(t.encode(x).ids) for x in texts]


def test_pieces_and_windows():
    for n in (1, 255, 1023, 1024, 1025, 5000):
        parts = cut(n, 1024, 256)
        assert sum(m for _, m in parts) == n and [s for s, _ in parts] == np.cumsum([0, *[m for _, m in parts][:-1]]).tolist()
    sizes = np.random.default_rng(0).integers(1, 257, 700)
    got = fill(sizes, 1024)
    load = np.bincount(got, weights=sizes)
    assert load.max() <= 1024 and len(load) <= -(-sizes.sum() // 1024) + 3
    assert fill(np.array([1024, 1024, 1]), 1024).tolist() != [0, 0, 0]


def test_signature_is_the_sequential_one():
    m, h = 64, np.random.default_rng(0).integers(1 << 62, size=40, dtype=np.uint64)
    best = [float("inf")] * m
    for x in h.tolist():
        p = list(range(m))
        for j in range(m):
            r = mix(np.array([x], dtype=np.uint64) ^ mix(np.full(1, j + 1, dtype=np.uint64)))
            k = j + int(((r & np.uint64(0xFFFFFF)) * np.uint64(m - j) >> np.uint64(24))[0])
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], j + float(r[0] >> np.uint64(24)) * 2.0**-40)
    assert signatures([h, h[:3]], m)[0].tolist() == best


def test_shingle_sets():
    a, b, c, d, e = shingles(["A b c d e f", "a  B\tc d\ne f", "a b", "", " \x0b\n"])
    assert a.tolist() == b.tolist() and (len(a), len(c), len(d), len(e)) == (2, 1, 0, 0)
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["ab", "ba", "Ab\u00a0", "a" * 3000, "a" * 3001, "\u3000", ""], n)) for n in rng.integers(0, 60, 200)]
    words = [t.encode().lower().split() for t in texts]
    want = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()} for w in words]
    got = shingles(texts)
    assert [len(x) for x in got] == [len(x) for x in want]
    assert all(len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j]) for i in range(0, 200, 7) for j in range(200))


def test_a_large_set_is_signed_block_by_block():
    h = np.random.default_rng(0).integers(1 << 62, size=3000, dtype=np.uint64)
    assert (signatures([h, h[:5]], 64) == signatures([h, h[:5]], 64, block=700)).all()


def test_sets_are_joined_as_all_pairs_say():
    rng = np.random.default_rng(0)
    base = rng.integers(1 << 62, size=60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 60 - k], rng.integers(1 << 62, size=k, dtype=np.uint64)])) for k in rng.integers(0, 14, 60)]
    sets += [base[:40], base[:30], np.sort(base)[:45]]  # 45 of 60: right at the threshold
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - k)]
    want = roots(len(sets), *np.array(pairs).T)
    for side in (7, 1024):
        assert (roots(len(sets), *linked_sets([np.sort(s) for s in sets], 75, side=side)) == want).all()
    assert 1 < len(set(want.tolist())) < len(sets)


@pytest.mark.parametrize("budget", [64, 1 << 20])
def test_suffix_order_and_prefixes(tmp_path, budget):
    rng = np.random.default_rng(0)
    for n in range(1, 60):
        parts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, n))).astype(np.uint8)) for _ in range(int(rng.integers(0, 4)))]
        t = joined(parts)
        s, depth = t.tobytes(), int(rng.choice([3, 100]))
        blocks = list(ordered(t, str(tmp_path), depth, budget))
        order, lcp = (np.concatenate([b[k] for b in blocks]).tolist() for k in (0, 1))
        assert sorted(order) == list(range(len(s)))
        cutoff = [s[i : i + depth] for i in order]
        assert cutoff == sorted(cutoff)
        share = lambda a, b: next((k for k in range(depth) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), depth)
        assert lcp == [0, *[share(a, b) for a, b in zip(cutoff, cutoff[1:], strict=False)]]


def test_leaks_are_found_and_others_left():
    rng = np.random.default_rng(0)
    words = ["alpha", "bravo", "carol", "delta", "echo", "fox", "golf", "hotel", "india", "kilo", "lima", "mike"]
    say = lambda n: " ".join(rng.choice(words, n))
    item = say(30)
    edited = item[:50] + "Q" + item[52:120].replace("echo", "eco", 1) + item[120:]
    index = Index([(7, item), (8, "too short"), (9, say(200))])
    got = index([normal(t) for t in (say(50) + " " + item.upper() + " " + say(20), say(80) + " " + edited, say(400), "", item[: len(item) // 2])])
    assert [[x[0] for x in leaks] for leaks in got] == [[7], [7], [], [], []]
    assert got[0][0][1] == 0 and got[1][0][1] > 0


def test_excerpts_and_short_items_are_leaks():
    rng = np.random.default_rng(1)
    say = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    long, mid = say(120), say(40)
    index = Index([(1, long), (2, mid), (3, "Short, but whole!"), (4, "\u65e5\u672c\u8a9e"), (5, "\u00e9t\u00e9"), (6, "q"), (7, "?!")])
    texts = [say(30) + " " + part + " " + say(30) for part in (long[200:350], mid[20:170], mid[:150].replace(mid[80:82], "0"))]
    texts += ["it is SHORT but\nwhole.", "short but wholesome", "\u3053\u308c\u306f\u65e5\u672c\u8a9e\u3067\u3059", "un \u00e9t\u00e9 chaud", "r\u00e9p\u00e9t\u00e9", "a q.", "aq qa", "", "q", mid[:80]]
    got = index([normal(t) for t in texts])
    assert [[x[0] for x in leaks] for leaks in got] == [[1], [2], [2], [3], [], [4], [5], [], [6], [], [], [6], []]
    assert got[3] == [(3, 0, 6, 21)]
    for cut in range(0, len(long) - 150, 37):
        assert index([normal(say(20) + " \n" + long[cut : cut + 150] + ". " + say(20))])[0][0][:2] == (1, 0)


def test_an_item_stays_found_where_edits_crowd():
    rng = np.random.default_rng(2)
    item = "".join(chr(97 + x) for x in rng.integers(0, 26, 256))
    edited = list(item)
    for x in (*range(60, 100, 5), *range(160, 200, 5), 230, 240):
        edited[x] = "0"
    assert [x[:2] for x in Index([(1, item)])([normal("before " + "".join(edited) + " after")])[0]] == [(1, 18)]


def test_int8_bounds_lose_no_pair():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 32))
    x[150:] = x[:150] + rng.normal(0, 0.25, (150, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = Quantised(x).pairs(slice(0, 300), slice(0, 300), 0.95)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if a < b}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > 50


def test_more_tables_for_more_bits():
    assert plan(1000, 0.95)[1] < plan(10**9, 0.95)[1]


def test_parcels_cost_what_their_regions_do():
    """What a chunk sends doesn't grow with the number of shards, and comes back whole."""
    rng = np.random.default_rng(0)
    n = 3000
    size = rng.integers(100, 180, n)
    regions = np.empty(n, dtype=suffix_dedup.REGION)
    for name in regions.dtype.names:
        regions[name] = rng.integers(0, 1000, n)
    texts = rng.integers(0, 256, int(size.sum()), dtype=np.uint8).tobytes()
    copies = rng.integers(0, 9, (50, 3))
    sent = {}
    for shards in (7, 79, 4768, 10**6):
        to, again = (rng.integers(0, shards, k) for k in (n, 50))
        squeeze = suffix_dedup.Squeezer()
        rows = suffix_dedup.parcels(4, to, regions, texts, size, again, copies, squeeze)
        assert rows["shard"].is_unique and len(rows) <= n + 50
        sent[shards] = int(sum(rows[c].str.len().sum() for c in ("meta", "text", "copies")))
        start = np.cumsum(size) - size
        for _, g in list(rows.groupby("shard"))[:20]:
            (c, doc, row, lo, k, text, h, more) = suffix_dedup._shard(g, squeeze)[0]
            own = np.nonzero(to == g["shard"].iloc[0])[0]
            assert c == 4 and doc.tolist() == regions["doc"][own].tolist() and h.tolist() == regions["h"][own].tolist() and (row.tolist(), lo.tolist(), k.tolist()) == tuple(regions[x][own].tolist() for x in ("row", "lo", "n"))
            assert text == b"".join(texts[start[i] : start[i] + size[i]] for i in own) and more.T.tolist() == copies[again == g["shard"].iloc[0]].tolist()
    assert max(sent.values()) < 1.1 * min(sent.values())
