"""Periodic runs, ranked search and sequence packing against brute force; then the queries on the smallest data."""
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as E
from commitlens.llm import packing, periodic, search
from commitlens.llm.tokens import public_vocabulary

COLUMNS = ("doc_id long, text string, n_words string, runs string, collapsed int, key string, piece string, start string, length string, "
           "ids string, ids_crc32 string, sequence_id string, offset string, n string, terms string, rank string, score string")
LONG = " ".join(f"word{i % 97} next{i}" for i in range(400))
TEXTS = [(1, "a b " * 9), (2, None), (3, ""), (4, " \t\n"), (5, "x"), (6, LONG), (6, LONG), (None, "alpha beta gamma " * 8), (8, "one two three"), (8, "one two three"),
         (9, "Ünï cödé ✓ " * 30), (10, "no runs in here at all"), (11, "A B A B A B A B a B"), (12, "end  of\n\n text \n  odd　 white  space " * 40)]


def docs(spark, rows):
    clash = (None,) * 15
    return spark.createDataFrame([(i, t, *clash) for i, t in rows], COLUMNS)


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words):
    kept = [True] * len(words)
    for s, n, q in brute_runs(words):
        kept[s + q:s + n] = [False] * (n - q)
    return b" ".join(w for w, k in zip(words, kept) if k).decode()


def test_cover_meets_every_distance():
    d = {(a - b) % periodic.PERIOD for a in periodic.COVER for b in periodic.COVER}
    assert d == set(range(periodic.PERIOD))


def test_extensions_equal_a_scan():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 30):
        words = rng.integers(1, letters + 1, 700).astype(np.int32)
        words[300:600] = words[:300]
        words = np.append(words, letters + 1).astype(np.int32)
        ext = periodic.Extensions(words)
        a = rng.integers(0, 699, 3000)
        b = rng.integers(a + 1, 701)
        want = [next(k for k in range(701) if words[i + k] != words[j + k]) for i, j in zip(a.tolist(), b.tolist())]
        assert ext.lce(a, b).tolist() == want


def test_runs_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(7)
    for held in (1 << 20, 1):
        monkeypatch.setattr(periodic, "HELD", held)
        for case in range(30):
            texts = []
            for _ in range(int(rng.integers(1, 5))):
                words = [f"w{x}" for x in rng.integers(0, rng.integers(1, 8), int(rng.integers(0, 260)))]
                for _ in range(3 if len(words) > 10 else 0):
                    a = int(rng.integers(0, len(words)))
                    p = int(rng.integers(1, max(2, (len(words) - a) // 4 + 1)))
                    for i in range(a, int(rng.integers(a, len(words)))):
                        words[i] = words[a + (i - a) % p]
                texts.append(" ".join(words))
            n, runs, collapsed = periodic._described(texts)
            for t, k, r, c in zip(texts, n, runs, collapsed):
                words = t.encode().split()
                assert k == len(words) and [tuple(x) for x in r.tolist()] == brute_runs(words) and c.decode() == brute_collapsed(words)


def test_runs_of_a_very_long_text():
    n, runs, collapsed = periodic._described([" ".join(f"x{i % 1000}" for i in range(300_000)), "a " * 200_000])
    assert n == [300_000, 200_000] and runs[0].tolist() == [[0, 300_000, 1000]] and runs[1].tolist() == [[0, 200_000, 1]] and collapsed[1] == b"a"


def test_runs_of_hostile_rows(spark):
    out = periodic.with_runs(docs(spark, TEXTS))
    assert out.columns == [c for c in COLUMNS.replace(",", "").split()[::2] if c not in ("n_words", "runs", "collapsed")] + ["n_words", "runs", "collapsed"]
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out.collect())
    split = lambda t: (t or "").encode().split()
    assert got == Counter((i, len(split(t)), tuple(brute_runs(split(t))), brute_collapsed(split(t))) for i, t in TEXTS)
    assert periodic.with_runs(docs(spark, [])).count() == 0


def test_run_query_equals_its_contract(spark, sf_small):
    got = {r.doc_id: tuple(r)[1:] for r in E.queries()["op11_periodic_runs"](spark, sf_small).collect()}
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        words = (r.text or "").encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 800:
            continue
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert got[r.doc_id] == (len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(),
                                 sha256(brute_collapsed(words).encode()).hexdigest())


def brute_search(rows, items, k):
    table = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
    split = lambda t: (t or "").encode().translate(table).lower().split()
    bags = [(i, Counter(split(t))) for i, t in rows]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, t in {(i, t) for i, t in items if t}:
        scores = []
        for i, b in bags:
            m = 75 + 25 * b.total() * n_docs // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w in split(t) if w in b)
            if s:
                scores.append((-s, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda: f"t{min(int(rng.zipf(1.3)), 60)}"
    rows = [(int(i), " ".join(word() for _ in range(int(rng.integers(0, 40))))) for i in rng.permutation(400)]
    rows += [(i, rows[0][1]) for i in range(1000, 1030)] + TEXTS + [(None, "t3 t3 only, HERE"), (7, "t5;T5_t5"), (7, "t5;T5_t5")]
    items = [(k, " ".join(word() for _ in range(int(rng.integers(1, 12))))) for k in range(12)] + [
        (50, None), (51, ""), (52, "?!"), (53, "nowhere"), (54, "t1 t1 t1 t2"), (54, "t1 t1 t1 t2"), (54, "other t2 text"), (55, LONG), (None, "t9 cödé")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for chunk, group, block, k in ((1 << 20, 4 << 20, 4 << 20, 20), (300, 2000, 4000, 5), (1, 1, 4 << 20, 1)):
        monkeypatch.setattr(search, "CHUNK_POSTINGS", chunk)
        monkeypatch.setattr(search, "GROUP_BYTES", group)
        got = search.ranked(docs(spark, rows).repartition(3), bench, k, block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute_search(rows, items, k)
    assert search.ranked(docs(spark, []), bench).count() == 0 and search.ranked(docs(spark, rows), bench.limit(0)).count() == 0


def test_search_stops_making_accumulators():
    rng = np.random.default_rng(2)
    n, common = 5000, np.arange(5000)
    rare = np.sort(rng.choice(n, 40, False))
    terms = np.concatenate([np.zeros(len(rare), np.int32), np.ones(n, np.int32)])
    doc = np.concatenate([rare, common])
    order = np.lexsort((terms, doc))
    chunk = search.Chunk(np.full(n, 10), np.bincount(doc, minlength=n), terms[order], np.ones(len(doc), np.int32), n, 10 * n, 2)
    found, scores = chunk.best([(0, 5000), (1, 3)], 0, 20)
    assert found.tolist() == rare.tolist() and (scores == 5000 * chunk.impact[0] + 3 * chunk.impact[-1]).all()


def test_byte_encoder_equals_the_library():
    encoder = packing.ByteEncoder(public_vocabulary("byte_bpe_50k.json"))
    rng = np.random.default_rng(4)
    letters = list(" \n\ta.b'1é　\x00\x85sREd,!✓日")
    texts = [None, "", " ", "  ", "a  b", " a", "a \n b", "a\n \nb", "it's WE'RE don't", "<|endoftext|> a", "a  <|endoftext|>b", "x\x1c y", "tail \n", LONG[:5000],
             *("".join(rng.choice(letters, int(rng.integers(1, 30)))) for _ in range(4000))]
    for x, ids in zip(texts, encoder.encode(pa.array(texts, pa.string()))):
        assert np.array_equal(ids, encoder.by_library(x)), x
        assert np.array_equal(encoder.encode(pa.array([x], pa.string()))[0], ids)


def brute_packing(lengths, capacity):
    """Sum of squares over the open gaps, written out."""
    gaps, places = [], []
    for n in lengths:
        count = Counter(g for g in gaps if g)

        def total(g):
            after = count.copy()
            after[g] -= 1
            after[g - n] += g > n
            return sum(c * c for c in after.values())

        fits = sorted(g for g in count if g >= n)
        if fits:
            g = min(fits, key=lambda g: (total(g), g))
            places.append(capacity - g)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            places.append(0)
            gaps.append(capacity - n)
    return places, len(gaps)


def test_packing_equals_the_rule():
    rng = np.random.default_rng(6)
    for capacity in (7, 20, 64):
        for _ in range(20):
            lengths = np.sort(rng.integers(1, capacity + 1, int(rng.integers(1, 60))))[::-1]
            sequence, offset = packing.sum_of_squares(lengths, capacity)
            places, made = brute_packing(lengths.tolist(), capacity)
            assert offset.tolist() == places and sequence.max() + 1 == made
    for n in (1, 5, 6, 7, 12, 13, 30):
        parts = packing.cut(n, 6)
        assert sum(z for _, z in parts) == n and all(z == 6 for _, z in parts[1:]) and [a for a, _ in parts] == np.cumsum([0, *(z for _, z in parts[:-1])]).tolist()


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_packing_of_hostile_rows(spark):
    vocabulary = public_vocabulary("byte_bpe_50k.json")
    encoder = packing.ByteEncoder(vocabulary)
    parts = packing.pieces(docs(spark, TEXTS).repartition(3), vocabulary, 50)
    for task_pieces in (10**6, 100):
        placed = packing.packed(parts, 50, task_pieces)
        rows = placed.collect()
        check_sequences(rows, 50)
        whole = packing.sequences(parts, placed).collect()
        held = {r.key: np.frombuffer(r.ids, "<u2") for r in parts.collect()}
        assert len(held) == len(rows) and len(whole) == len({r.sequence_id for r in rows})
        for s in whole:
            ids = np.frombuffer(s.ids, "<u2")
            assert len(ids) == s.length == sum(d.length for d in s.docs)
        texts = defaultdict(list)
        for r in sorted(rows, key=lambda r: r.key):
            assert r.ids_crc32 == zlib.crc32(held[r.key].astype("<u4").tobytes()) and r.length == len(held[r.key])
            if r.piece == 0:
                texts[r.doc_id].append([])
            assert r.start == sum(map(len, texts[r.doc_id][-1]))
            texts[r.doc_id][-1].append(held[r.key])
        got = Counter((i, np.concatenate(t).tobytes()) for i, all_ in texts.items() for t in all_)
        assert got == Counter((i, np.append(encoder.by_library(t), 0).astype("<u2").tobytes()) for i, t in TEXTS)
    none = packing.packed(packing.pieces(docs(spark, []), vocabulary))
    assert none.count() == 0


def test_packing_query(spark, sf_small):
    rows = E.queries()["op13_sum_of_squares_packing"](spark, sf_small).collect()
    used = check_sequences(rows, packing.CAPACITY)
    least = -(-sum(r.length for r in rows) // packing.CAPACITY)
    assert used <= max(least + 1, 1.01 * least)
    encoder = packing.ByteEncoder(public_vocabulary("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by[r.doc_id].append(r)
    for d in spark.read.parquet(f"{sf_small}/documents.parquet").collect():
        ids = np.append(encoder.by_library(d.text), 0).astype("<u4")
        own = by.pop(d.doc_id)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == packing.CAPACITY for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert not by


@pytest.mark.parametrize("name", ["op12_lexical_search"])
def test_query_equals_its_sql(spark, sf_small, name):
    from compare import compare, duck

    assert compare(spark, sf_small, name, E.queries()[name], E.oracle_sql()[name], duck(sf_small))["status"] == "match"
