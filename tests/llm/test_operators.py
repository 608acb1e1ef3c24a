"""Each operator on small hostile tables, against brute force; then its query on the smallest data."""
import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha1, sha256
from itertools import combinations

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from commitlens.llm import chat, decontaminate, jaccard, lattice, mixing, quality, sharding, tokens, urls, warc

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, th string"
LETTERS = str.maketrans("0123456789", "abcdefghij")
LONG = " ".join(f"word{i % 997} next{i}" for i in range(15_000))


def docs(spark, rows):
    """Rows (doc_id, text, source) under the table's columns and some whose names clash."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], COLUMNS)


BASE = " ".join(f"tok{i}" for i in range(200))
NEAR = BASE.replace("tok100 ", "other ")
ROWS = [(1, BASE, "a"), (2, BASE, "a"), (3, NEAR, "b"), (4, None, None), (5, "", "b"), (6, "one two", ""), (6, "one two", ""), (None, "ONE two", "c"),
        (7, LONG, "a"), (8, "  \t\n ", "c"), (9, "Ünï cödé ✓ " * 30, None)]


@pytest.fixture(scope="module")
def hostile(spark):
    return docs(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def words(text):
    return (text or "").encode().split()


def test_sharding(spark, hostile, none):
    tree, grown = sharding.even_topology(24), sharding.even_topology(25)
    out = sharding.with_slots(sharding.with_shards(sharding.with_shards(hostile, tree), grown, into="grown"), order=("doc_id",)).collect()
    assert len(out) == len(ROWS) and all(r.grown in (r.shard, 24) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.with_slots(sharding.with_shards(none, tree)).count() == 0
    many = sharding.with_shards(spark.range(20_000).toDF("doc_id"), tree)
    many = sharding.with_shards(many, grown, into="grown").collect()
    assert all(r.grown in (r.shard, 24) for r in many)
    sizes = Counter(r.shard for r in many)
    assert len(sizes) == 24 and max(sizes.values()) < 1.25 * min(sizes.values())


def test_weights_move_keys_only_into_the_grown_subtree(spark):
    before = sharding.even_topology(8)
    after = [[[(s, 3.0 if s == 5 else w) for s, w in rack] for rack in region] for region in before]
    rows = sharding.with_shards(sharding.with_shards(spark.range(5000).toDF("doc_id"), before), after, into="then").collect()
    moved = [r for r in rows if r.shard != r.then]
    assert moved and all(r.then // 4 == 1 for r in moved)


def test_mixing(spark, hostile, none):
    rows = mixing.sized(hostile)
    out = mixing.mix(rows, mixing.cuts(rows)).collect()
    size = defaultdict(int)
    for _, t, s in ROWS:
        size[s] += len(words(t))
    total, names = sum(size.values()), sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * total
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]} or set()
        goal |= {s: 2.0 * size[s] for s in full} or {s: weight[s] * level for s in open_}
        left -= sum(2 * size[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.target == pytest.approx(goal[r.source])
    assert all(abs(taken[s] - goal[s]) <= 2 for s in names) and len(out) == len(ROWS)
    assert mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(hostile)
    assert mixed.columns == hostile.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_quality(spark, hostile, none):
    def brute(t):
        w = words(t)
        seen = Counter(zip(w, w[1:], w[2:]))
        return len({j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)})

    for t in (None, "", "a b a b a b", "a a a a", LONG[:3000], BASE):
        assert quality.measure(t)[0][4] == brute(t)
    assert quality.judged(hostile).count() == len(ROWS) and quality.judged(none).count() == 0
    boiler = "All rights reserved by the owners of this page and of all others here"
    body = lambda i, n: "\n".join(" ".join(f"w{i}x{j}x{k}".translate(LETTERS) for k in range(20)) for j in range(n))
    rows = [(i, body(i, 5) + "\n" + boiler, "h") for i in range(30)]
    rows += [(100, "\n".join([boiler] * 9) + "\n" + body(100, 1), "h")] + [(200 + i, body(7, 5), "h") for i in range(60)]
    got = {r.doc_id: r for r in quality.judged(docs(spark, rows)).collect()}
    assert not got[100].kept and all(r.kept for i, r in got.items() if i != 100)
    cleaned = {r.doc_id: r.text for r in quality.clean_documents(docs(spark, rows)).collect()}
    assert 100 not in cleaned and boiler not in cleaned[3] and cleaned[205] == body(7, 5)


def test_quality_counts_lines_of_pages_that_are_mostly_boilerplate(spark):
    menu = [" ".join(f"m{k}w{j}".translate(LETTERS) for j in range(6)) for k in range(20)]
    own = lambda i: [" ".join(f"p{i}l{j}w{k}".translate(LETTERS) for k in range(30)) for j in range(2)]
    pages = docs(spark, [(i, "\n".join(menu + own(i)), "h") for i in range(60)] + [(100 + i, "\n".join(menu + own(0)), "few") for i in range(60)])
    cleaned = {r.doc_id: r.text for r in quality.clean_documents(pages, min_left_pct=10).collect()}
    assert cleaned == {i: "\n".join(own(i)) for i in range(60)} | {100 + i: "\n".join(menu + own(0)) for i in range(60)}


def test_token_files(spark, hostile, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.public_vocabulary())
    mine = tokens.WordEncoder(tokens.public_vocabulary())
    for t in ("don't you'RE ÀÉ ÿ. Straße, İstanbul ΣΑΣ ﬁ é é", "a<|endoftext|>b <|startoftext|>", "...hello!? 12ab a1, 日本語 \x1c\x85z", "A" * 300, None):
        assert np.frombuffer(mine.encode(t), mine.dtype).tolist() == whole.encode(t or "", add_special_tokens=False).ids
    got = sorted(tokens.read_digests(tokens.write_ids(hostile, tokens.public_vocabulary())).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    text = {i: t for i, t, _ in ROWS}
    for r in got:
        ids = whole.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert tokens.read_digests(tokens.write_ids(none, tokens.public_vocabulary())).count() == 0


def test_urls(spark):
    rows = [(i, f"https://www.ab{i}.com/en/{i}") for i in range(40)] + [(100 + i, f"http://x{i}.net/fr/{i}?q") for i in range(40)]
    rows += [(200, "https://news.org/en/7"), (201, "https://news.org/fr/7"), (202, None), (203, "no scheme"), (204, "HTTP://WWW.Example.COM/en/1#x"), (205, "x://example.com/en/a"), (205, "x://a.com?b")]
    got = defaultdict(list)
    for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect():
        got[r.page_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert (got[204][0].host, got[204][0].path, got[204][0].rule, got[204][0].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert sorted((r.rule or "", r.path) for r in got[205]) == [("", ""), ("example.com/en/", "/en/a")]
    assert (got[202][0].host, got[202][0].path, got[203][0].host) == ("", "", "")
    assert got[200][0].score > got[201][0].score
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/ö\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (None, "u", "n")]
    index = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = warc.read_archives(warc.write_deduplicated(index, warc.resolve(index))).collect()
    seen = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    assert seen == Counter([(1, 9, "revisit", 2), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None),
                            (5, 300_000, "response", None), (5, 300_000, "revisit", 5), (None, 1, "response", None)])
    assert {r.payload_digest for r in got if r.page_id == 4} == {warc.digest_of(b"")} and len(warc.digest_of(b"")) == 32
    large = warc.resolve(index, min_bytes=1)
    assert large.count() == 2
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(warc.write_deduplicated(empty, warc.resolve(empty))).count() == 0
    assert sha1(b"").digest_size == 20


def test_decontamination(spark, none):
    item = "A train leaves Berlin with 120 passengers and travels 300 km before it meets Anna at noon. How many stay?"
    other = item.replace("Berlin", "Oslo").replace("120", "75").replace("300", "410").replace("Anna", "Peter")
    mixed = item.replace("Berlin", "Oslo")
    filler = " ".join(f"f{i}" for i in range(80))
    rows = [(1, f"{filler}. {item} {filler}", "s"), (2, f"{filler}. {other}", "s"), (3, filler, "s"), (4, None, "s"), (5, "", None), (6, mixed, "s"), (6, mixed, "s"), (7, item[:40], "s"), (8, LONG, "s")]
    bench = spark.createDataFrame([(10, item, 0), (11, None, 0), (12, "", 0), (10, item, 1)], "item_id long, text string, th int")
    got = {(r.doc_id, r.item_id): r.changed for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(1, 10): False, (2, 10): True, (6, 10): True}
    twice = "Take 3 apples and 3 pears then add 3 more plums to the bowl now"
    torn = "Take 3 apples and 4 pears then add 5 more plums to the bowl now"
    one = spark.createDataFrame([(1, twice)], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, [(1, torn, "s")]), one).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0
    assert {r.doc_id for r in decontaminate.clean_documents(docs(spark, rows), bench).collect()} == {3, 4, 5, 7, 8}


APPLES = ("Tom has 3 apples in the kitchen of his house. Tom buys 4 more from the shop next door. "
          "Later Tom gives 2 of them to Berta who lives across the old market. How many does Tom keep?")


def held(spark, texts, item):
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r.doc_id: r.changed for r in decontaminate.contaminated(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), bench).collect()}


def test_decontamination_decides_names_alike_on_both_sides(spark):
    filler = " ".join(f"f{i}" for i in range(40))
    renamed = APPLES.replace("Tom", "Anna").replace("Berta", "Carl").replace("3", "5").replace("4", "8")
    texts = [f"{filler} {t} {filler}" for t in (renamed, APPLES.replace(" ", "\n"), APPLES.lower(), APPLES.upper(), renamed.replace(" ", "\n"))] + [filler.upper(), APPLES[:60]]
    assert held(spark, texts, APPLES) == {0: True, 1: False, 2: False, 3: False, 4: True}
    metres = "the runner covers 5 km in 20 minutes and then rests for 90 seconds before Paul starts"
    assert held(spark, [metres.upper(), metres.replace("5 km", "5\nkm")], metres) == {0: False, 1: False}


def test_decontamination_drops_only_windows_with_a_conflicting_slot(spark):
    item = "Tom has 3 apples and 5 pears in a basket that stands on the table near the window of his room"
    assert held(spark, [item.replace("3", "4").replace("5", "4")], item) == {0: True}
    typo = APPLES.replace("does Tom keep", "does Tim keep")
    assert held(spark, [typo], APPLES) == {0: False}
    assert held(spark, ["ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE"], "RED DOG RUNS FAST OVER GREEN HILLS") == {}


def test_lattice(spark, hostile, none):
    model = lattice.Pieces([b"th", b"the", b"he"])
    score = dict(zip((model.pieces[i] for i in model.order), model.scores))

    def brute(w):
        ways = 0.0
        for k in range(len(w)):
            for at in combinations(range(1, len(w)), k):
                parts = [w[a:z] for a, z in zip((0, *at), (*at, len(w)))]
                ways += math.exp(sum(score[p] for p in parts)) if all(p in score for p in parts) else 0.0
        return math.log(ways) + model.log_stop

    for w in (b"the", b"thethe", b"x", "é".encode()):
        assert model.log_spelt(np.frombuffer(w, np.uint8).reshape(1, -1))[0] == pytest.approx(brute(w))
    out = lattice.scored(hostile, lattice.in_fold(hostile["doc_id"]), held_words=5).collect()
    assert len(out) == len(ROWS) and all(math.isfinite(r.score) and r.score < 0 for r in out)
    train = Counter(w.lower() for i, t, _ in ROWS if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for w in [*words(t), b"\n"])
    n, v = train.total(), len(train)
    want = Counter(round(sum(math.log10((train[w.lower()] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b"\n"]), 3) for _, t, _ in ROWS)
    assert Counter(round(r.base_score, 3) for r in out) == want
    assert lattice.scored(none, lattice.in_fold(none["doc_id"])).count() == 0


def test_lattice_learns_from_long_words(spark, monkeypatch):
    model = lattice.Pieces([b"th", b"the", b"he", b"ethe"])
    text = np.frombuffer(b"thethxhethe" * 7, np.uint8)
    want = model.expected(text.reshape(1, -1))
    for span in (1, 3, 10, 1 << 14):
        monkeypatch.setattr(lattice, "SPAN", span)
        assert model.expected_long(text) == pytest.approx(want)
    long = spark.createDataFrame([(b"the" * 40,), (b"he" * 50,)], "word binary")
    fitted = lattice.fitted(model, long)
    score = dict(zip((fitted.pieces[i] for i in fitted.order), fitted.scores))
    assert score[b"the"] > score[b"x"] + 3 and fitted.stop < 0.1


def test_chat(spark):
    template = chat.Template()
    for role in ("user", "assistant", "system", "tool", "", "a[/ROLE] b"):
        for text in ("", chat.HOSTILE, "\\", "\\[INST]", "[[INST]", "<", "\\\\</s>", "[END]", "line\nline"):
            parts = template.segments(role, text, True)
            assert template.parse("".join(t for t, _ in parts), True) == (role, text)
            assert "".join(template.unescape(t) for t, loss in parts if loss) == (text if role == "assistant" else "")
    rows = [(1, 0, "user", "q", 1), (1, 1, "assistant", chat.HOSTILE, 1), (2, 1, "assistant", "a", 1), (2, 0, None, None, 1), (None, 0, "user", "x", 1), (1, 1, "assistant", "z", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == sha256((chat.HOSTILE + "z").encode()).hexdigest() and not got[1].valid
    assert got[2].turns_sha256 == sha256(b"\n\nassistant\na\n").hexdigest() and got[None].loss_chars == 0
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_jaccard(spark, hostile, none):
    def brute(rows):
        sets, root = [], list(range(len(rows)))
        for _, t, *_ in rows:
            w = [x.lower() for x in words(t)]
            sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
        for i, j in combinations(range(len(rows)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
        least = lambda k: min((rows[i][0] for i in range(len(rows)) if root[i] == k and rows[i][0] is not None), default=None)
        return Counter((r[0], len(s), least(root[i]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))

    rng = np.random.default_rng(5)
    rows = list(ROWS)
    for g in range(12):
        base = [f"g{g}w{rng.integers(40)}" for _ in range(int(rng.integers(20, 120)))]
        for k in range(8):
            own = [w if rng.random() > 0.012 else f"e{rng.integers(9)}" for w in base]
            rows.append((1000 + g * 10 + k, " ".join(own), "s"))
    got = jaccard.jaccard_components(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.unique_documents(hostile)
    assert kept.columns == hostile.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 9]


def test_duplicate_stage_takes_five_words_and_80_percent(spark):
    grown = lambda i, more: " ".join([f"b{i}w{k}" for k in range(200)] + [f"b{i}m{k}" for k in range(more)])
    rows = [r for i in range(20) for r in ((2 * i, grown(i, 0), "s"), (2 * i + 1, grown(i, 40 + i), "s"))]
    kept = {r.doc_id for r in corpus_pipeline.duplicate_stage(spark, docs(spark, rows), "").collect()}
    assert kept == {2 * i for i in range(20)} | {2 * i + 1 for i in range(20) if 100 * 196 < 80 * (236 + i)}
    base = [f"c{k}" for k in range(120)]
    other = [w if k not in (30, 90) else "x" for k, w in enumerate(base)]
    five = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    both = len(five(base) & five(other)) * 100 >= 80 * len(five(base) | five(other))
    assert both and len(corpus_pipeline.duplicate_stage(spark, docs(spark, [(1, " ".join(base), "s"), (2, " ".join(other), "s")]), "").collect()) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_pipeline_stages(spark, hostile, none, sf_small):
    for frame in (hostile, none):
        kept = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, kept, sf_small)
            assert out.columns[:len(kept.columns)] == kept.columns or k == 4
            kept = out
        assert kept.count() == 0 if frame is none else kept.count() > 0


@pytest.mark.parametrize("name", [n for n in E.oracle_sql() if n.startswith("op")])
def test_query_equals_its_sql(spark, sf_small, name):
    from compare import compare, duck

    assert compare(spark, sf_small, name, E.queries()[name], E.oracle_sql()[name], duck(sf_small))["status"] == "match"


def clashing(spark, rows, *names):
    return spark.createDataFrame([(i, t, s, *(f"own {n}" for n in names)) for i, t, s in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))


def test_stages_pass_on_columns_of_any_name(spark):
    names = ("kept", "removed", "_th", "th", "cls", "target", "source_size", "cut", "rest", "epochs", "taken", "size", "_key", "_range", "_row", "root", "own", "id", "key", "n", "token")
    frame = clashing(spark, ROWS, *names)
    for stage in (quality.clean_documents, jaccard.unique_documents, mixing.mixed_documents):
        out = stage(frame)
        assert out.columns == frame.columns
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names), stage


def test_unrelated_texts_of_one_id_both_stay(spark):
    rows = [(6, "one two three four five six", "a"), (6, "seven eight nine ten eleven twelve", "a"), (7, BASE, "a"), (7, NEAR, "a"), (None, "x y z a b c d", "a"), (None, None, "a"), (None, None, "b")]
    kept = sorted((str(r.doc_id), r.text or "") for r in jaccard.unique_documents(docs(spark, rows)).collect())
    texts = [t for _, t in kept]
    assert len(kept) == 5 and rows[0][1] in texts and rows[1][1] in texts and (BASE in texts) != (NEAR in texts)


def test_slots_of_null_groups(spark):
    frame = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "doc_id long, shard string").repartition(3)
    got = sharding.with_slots(frame, order=("doc_id",)).collect()
    for group in (None, "a"):
        assert sorted(r.slot for r in got if r.shard == group) == list(range(10))


def test_line_rule_equals_its_sql_at_a_larger_size(spark):
    from compare import compare, duck

    name, sf = "op8_line_frequency_quality", "/root/testdata/sf0.1"
    assert compare(spark, sf, name, E.queries()[name], E.oracle_sql()[name], duck(sf))["status"] == "match"


def test_tree_draws_equal_brute_force(spark):
    import xxhash

    topology = [[[(0, 1.0), (1, 2.5)], [(2, 1.0)]], [[(3, 0.0), (4, 3.0), (5, 1.0)]], [[(6, 0.5)], [(7, 0.5), (8, 0.5)]]]
    weight = lambda node: node[1] if isinstance(node, tuple) else sum(map(weight, node))

    def descend(key, node, path="root"):
        if isinstance(node, tuple):
            return node[0]
        live = [(c, f"{path}.s{c[0]}" if isinstance(c, tuple) else f"{path}.{i}") for i, c in enumerate(node) if weight(c) > 0]
        draw = lambda p, w: math.log(((xxhash.xxh64_intdigest(f"{key}|{p}", 42) >> 11) + 0.5) / 2**53) / w
        return descend(key, *max(live, key=lambda x: draw(x[1], weight(x[0]))) if len(live) > 1 else live[0])

    keys = [*range(2000), None]
    got = {r.doc_id: r.shard for r in sharding.with_shards(spark.createDataFrame([(k,) for k in keys], "doc_id long"), topology).collect()}
    assert got == {k: descend("" if k is None else str(k), topology) for k in keys} and set(got.values()) == {0, 1, 2, 4, 5, 6, 7, 8}
    frame = spark.createDataFrame([(1, "é x"), (2, None), (3, "")], "doc_id long, text string")
    import tempfile
    folder = tempfile.mkdtemp(prefix="op1-")
    frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: (r.size, r.text_crc32, r.law) for r in E.queries()["op1_hash_tree_shards"](spark, folder).collect()}
    assert rows == {1: (12, zlib.crc32("é x".encode()), "key"), 2: (8, 0, "key"), 3: (8, 0, "key")}
