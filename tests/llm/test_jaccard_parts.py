"""The hashes and bounds of the n-gram Jaccard join against plain Python."""
import random

import numpy as np

from commitlens.llm import jaccard as J


def test_words_are_told_apart_by_all_their_bytes():
    r = random.Random(1)
    made = {bytes(r.choice(b"ab\x00\xc3z") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 24, 255, 256, 257, 300]))) for _ in range(5000)}
    made = sorted(made)
    h = J.words(b" \n" + b"\t".join(made) + b"\r")
    assert len(set(h.tolist())) == len(made)
    assert [J.words(w)[0] for w in made[:500]] == h[:500].tolist()
    assert [len(J.words(t)) for t in (b"", b" ", b"\x0b\x0c \n")] == [0, 0, 0]


def test_shingle_sets_have_the_size_of_plain_sets():
    r = random.Random(2)
    for n in (0, 1, 3, 4, 5, 400):
        w = [r.choice("a b c dd EE".split()).lower() for _ in range(n)]
        plain = {tuple(w[i:i + 4]) for i in range(n - 3)} if n >= 4 else {tuple(w)} if w else set()
        s = J.shingles(" ".join(w))
        assert len(s) == len(plain) and (np.diff(s) > 0).all()


def test_wide_bitmaps_admit_every_link():
    r = np.random.default_rng(3)
    admits, exact = J._admits(85), J._exact(85)
    rejected = 0
    for _ in range(400):
        base = r.integers(1, 1 << 63, r.integers(1, 700), dtype=np.uint64)
        other = np.unique(np.append(base[r.random(len(base)) > r.random() * 0.3], r.integers(1, 1 << 63, r.integers(0, 60), dtype=np.uint64)))
        base = np.unique(base)
        a, b = J.wide(base), J.wide(other)
        if exact(base.tobytes(), other.tobytes()):
            assert admits(a, b)
        rejected += not admits(a, b)
    assert rejected > 50


def test_places_in_the_common_order_bound_the_overlap_at_the_first_shared_shingle():
    r = np.random.default_rng(4)
    levels = r.integers(0, 5, 1 << 10).astype(np.uint8)

    def order(x):
        return int(levels[x % len(levels)]) << 56 | x >> 8

    linked = 0
    for _ in range(300):
        base = np.unique(r.integers(1, 1 << 63, r.integers(1, 300), dtype=np.uint64))
        other = np.unique(np.append(base[r.random(len(base)) > 0.08], r.integers(1, 1 << 63, r.integers(0, 20), dtype=np.uint64)))
        if not len(other):
            continue
        sets, first = (base, other), []
        for s in sets:
            tokens, places = J.prefix(s, levels)
            ranks = sorted(order(x) for x in s.tolist())
            assert [ranks.index(order(x)) for x in tokens.tolist()] == places.tolist()
            first.append(dict(zip(tokens.tolist(), places.tolist(), strict=True)))
        both = len(np.intersect1d(*sets))
        if 100 * both >= 85 * (len(base) + len(other) - both):
            linked += 1
            t = min(first[0].keys() & first[1].keys(), key=order)
            rest = min(len(s) - f[t] for s, f in zip(sets, first, strict=True))
            assert rest >= both and rest * 185 >= 85 * (len(base) + len(other))
    assert linked > 50
