"""N-gram Jaccard join: exact links between shingle sets, and their components.

Sets of equal shingles form classes; only one document of a class takes part.  Then

1. ``leaders``: classes that share the smallest hash of one of a few ranges are paired with the least and
   the greatest of them, and ``nearest`` compares each with the nearest of its partners, a few times.
   This joins large groups of near copies in linear work.
2. ``tiles``: a shared prefix of the sets (rare shingles first) is necessary for a link, and so
   is a like size.  Classes meet in tiles of one prefix shingle and one size band, unless they are of
   one component already.  The places of the shingle in both sets bound what they share from it on; a pair that shares
   one of the last few shingles before it is left to that tile.  Hashed bitmap signatures bound the overlap from above:
   the bits in which two signatures differ are no more than the shingles in which the sets differ.
3. The pairs left pass a bitmap of two bits a shingle, and ``nearest`` once more; then ``linked``
   intersects all that are still in different components exactly, as sorted arrays.

The order of prefix shingles comes from a sketch of fixed size; it decides how much work there
is and never what is found.  Classes are 64-bit; a second hash proves them distinct.

Defined cases: documents without words have an empty set and link with nothing; shorter
documents have one shingle; repeated rows are nodes of their own; a null doc_id counts as larger
than any; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.llm.common import aside, batches, materialise, table, text_hash

WIDTH, PERCENT = 4, 85
KEYS, BITS, FOLDED, SKETCH = 8, 1024, 1024, 1 << 20
#: Shingles gathered before those frequent among them go to the sketch, and how many make one frequent.
GATHER, FREQUENT = 4_000_000, 4
#: Rows (three numbers each) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: How often each class is compared with its nearest partner alone before all other pairs are.
NEAREST_ROUNDS = 2
#: Shared prefix shingles before its own that a row of a tile knows.
EARLIER = 4
#: Comparisons with one class in one task.
SPLIT = 500
#: Longer words are hashed one by one.
LONG_WORD = 256
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_RANGES = np.arange(KEYS, dtype=np.uint64) << np.uint64(61)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x632BE59BD9B4E019 & (2 ** 64 - 1))) * _A
    h ^= h >> np.uint64(29)
    h *= _B
    return h ^ (h >> np.uint64(32))


def words(text: bytes) -> np.ndarray:
    """A hash of each word: its eight-byte pieces and its length, mixed one after the other."""
    raw = np.frombuffer(text + b" " * 9, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True))
    at, size = edges[::2], edges[1::2] - edges[::2]
    pieces = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mix(pieces[at] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64)
    more = np.flatnonzero(size > 8)
    for i in more[size[more] > LONG_WORD].tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[at[i]:at[i] + size[i]])
    more, done = more[size[more] <= LONG_WORD], 8
    while len(more):
        h[more] = mix(h[more]) ^ (pieces[at[more] + done] & _MASKS[np.minimum(size[more] - done, 8)])
        done += 8
        more = more[size[more] > done]
    return mix(h)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    h = words((text or "").encode().lower())
    if not len(h):
        return h
    if len(h) < width:
        return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], np.uint64))
    out = h[:len(h) - width + 1].copy()
    for i in range(1, width):
        out = mix(out) + h[i:len(h) - width + 1 + i]
    out = np.sort(mix(out))
    return out[np.append(True, out[1:] != out[:-1])]


def signature(s: np.ndarray) -> tuple[int, int, list[int], list[int]]:
    """Class, its proof, the keys under which the set meets its likes, and its bitmap.

    The keys are the least hashes of equal ranges; an empty range has none.
    """
    total = [int(mix(s, k).sum(dtype=np.uint64)) for k in (101, 102)]
    first = np.searchsorted(s, _RANGES)
    keys = s[np.unique(first[first < len(s)])].view(np.int64).tolist()
    return *(_signed(x) for x in total), keys, bitmap(s)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def prefix(s: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which a linked set holds one, and how many of the set's come before each in the common order."""
    n = len(s)
    keep = n - -(-n * percent // 100) + 1
    rank = (levels[(s % np.uint64(len(levels))).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    first = rank <= np.partition(rank, keep - 1)[keep - 1]
    rank = rank[first]
    return s[first], np.searchsorted(np.sort(rank), rank).astype(np.int32)


def bitmap(s: np.ndarray) -> list[int]:
    """Parity of the shingles that fall on each bit."""
    bits = (np.bincount((mix(s, 300) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def _described(it: Iterable[pa.RecordBatch], width: int = WIDTH) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "th", "n", "cls", "proof", "keys", "bits", "bucket", "freq"]
    lists = pa.list_(pa.int64())

    def frequent() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(gathered), return_counts=True)
        h, c = h[c >= FREQUENT], c[c >= FREQUENT]
        k = len(h)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(k, id_type), *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.nulls(k, lists), pa.nulls(k, lists),
             pa.array((h % np.uint64(SKETCH)).astype(np.int64)), pa.array(c, pa.int64())], names=names)

    gathered: list[np.ndarray] = []
    size = 0
    for b in batches(it):
        id_type = b.schema.field("doc_id").type
        n, rows = [], []
        for text in b.column("text").to_pylist():
            s = shingles(text, width)
            n.append(len(s))
            rows.append(signature(s) if len(s) else (None, None, None, None))
            gathered.append(s)
            size += len(s)
        k = len(n)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], lists), pa.array([r[3] for r in rows], lists), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        if size >= GATHER:
            yield frequent()
            gathered, size = [], 0
    if gathered:
        yield frequent()


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of documents (doc_id, th, n, cls, proof, keys, bits) and of the sketch (bucket, freq)."""
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    ids = dict(rows.dtypes)["doc_id"]
    return materialise(rows.mapInArrow(
        lambda it: _described(it, width), f"doc_id {ids}, th long, n long, cls long, proof long, keys array<long>, bits array<long>, bucket long, freq long"), "shingle-classes")


def order_levels(found: DataFrame) -> np.ndarray:
    """Of fixed size: the level (log2 of the frequency) of each bucket of shingles."""
    got = found.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("freq").alias("f")).toArrow()
    levels = np.zeros(SKETCH, np.uint8)
    if got.num_rows:
        levels[got["bucket"].to_numpy()] = np.log2(got["f"].to_numpy().astype(float)).astype(np.uint8) + 1
    return levels


def _prefixes(levels: np.ndarray, percent: int = PERCENT, width: int = WIDTH):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches(it):
            out_t, out_c, out_p = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, width)
                if len(s):
                    cls = int(mix(s, 101).sum(dtype=np.uint64))
                    if cls in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(cls)
                    first, place = prefix(s, levels, percent)
                    out_t.append(first.view(np.int64))
                    out_c.append(np.full(len(first), _signed(cls), np.int64))
                    out_p.append(place)
            if out_t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_t, out_c, out_p)], names=["token", "cls", "place"])

    return run


def _facts(of, width: int = WIDTH):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows give one row per task; a second one changes no result
        for b in batches(it):
            rows = {c: t for c, t in zip(b.column("cls").to_pylist(), b.column("text").to_pylist(), strict=True) if c not in seen}
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(rows)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([of(shingles(t, width)) for t in rows.values()], pa.binary())], names=["cls", "facts"])

    return run


def _exact(percent: int):
    def links(own: bytes, other: bytes) -> bool:
        a, b = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    return links


def _admits(percent: int):
    def links(own: bytes, other: bytes) -> bool:
        a, b = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
        both, a, b = int(a[0] + b[0]), a[1:], b[1:]
        while len(a) != len(b):
            a, b = (_halved(a), b) if len(a) > len(b) else (a, _halved(b))
        return int(np.bitwise_count(a ^ b).sum()) * (100 + percent) <= (100 - percent) * both

    return links


def _halved(bits: np.ndarray) -> np.ndarray:
    return bits[:len(bits) // 2] ^ bits[len(bits) // 2:]


def wide(s: np.ndarray) -> bytes:
    """The size of the set and the parity of its shingles on at least two bits a shingle.

    The high half of a bitmap folds on the low half, which gives that of half as many bits."""
    n = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = (np.bincount((mix(s, 300) & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8)
    return np.uint64(len(s)).tobytes() + np.packbits(bits).tobytes()


def _held(links):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches(it):
            out = []
            for a, kind, cls, facts in zip(*(b.column(c).to_pylist() for c in ("a", "kind", "cls", "facts")), strict=True):
                if kind == 0:
                    own = facts
                elif links(own, facts):
                    out.append((a, cls))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _met(pairs: DataFrame, facts: DataFrame, links) -> DataFrame:
    """Of the pairs (a, b) of classes those whose facts (cls, facts) pass ``links``.  A class with
    many partners is compared with them in several tasks; a task streams its partners past it."""
    parts = F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")
    left = materialise(pairs.groupBy("a").agg(parts), "partners")
    others = materialise(pairs.select("a", "b").join(left, "a"), "partner-pairs")
    if others.count() <= BROADCAST_ROWS:  # then the sets move once only
        left, others = F.broadcast(left), F.broadcast(others)
    owners = left.join(facts, left["a"] == facts["cls"]).select("a", F.explode(F.sequence(F.lit(1), "parts")).alias("part"), F.lit(0).alias("kind"), "cls", "facts")
    part = (F.pmod(F.xxhash64("b"), F.col("parts")) + 1).cast("int")
    others = others.join(facts, F.col("b") == facts["cls"]).select("a", part.alias("part"), F.lit(1).alias("kind"), "cls", "facts")
    rows = owners.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", "kind").select("a", "kind", "cls", "facts")
    return rows.mapInArrow(_held(links), "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b) of classes those that link."""
    return _met(pairs, sets, _exact(percent))


def nearest(pairs: DataFrame, sets: DataFrame, near: DataFrame | None, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, components, open pairs): in each round every class is compared with the nearest of
    its partners (a, b, differ).  Pairs that this brings into one component can't change the result."""
    roots = None if near is None else components(near)
    for _ in range(NEAREST_ROUNDS):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"), "a", "b", "differ")
        best = ends.groupBy("cls").agg(F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        best = materialise(best, "nearest-pairs")
        if best.isEmpty() and roots is not None:
            break
        found = materialise(linked(best, sets, percent), "links")
        near = found if near is None else near.unionByName(found)
        roots = components(near)
        pairs = materialise(apart(pairs.join(best, ["a", "b"], "left_anti"), roots), "open-pairs")
    return near, roots, pairs


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, differ) whose classes are of different components."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b", "differ")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node that can be reached; large and small stars in turn."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = materialise(both, "edges"), None
    while True:
        around = now.union(now.select("v", "u")).toDF("u", "v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(
            F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        now = materialise(small, "edges")
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, of=np.ndarray.tobytes, width: int = WIDTH) -> DataFrame:
    """(cls, facts): the sets, or what ``of`` makes of them, of the classes in the pairs, from a text of each."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    reps = classes.join(needed, "cls").select("cls", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th"))
    reps = materialise(reps, "representatives")
    side = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps
    texts = docs.join(side, docs["doc_id"].eqNullSafe(side["_id"]) & (text_hash(docs["text"]) == side["_th"])).select("cls", "text")
    return materialise(texts.mapInArrow(_facts(of, width), "cls long, facts binary"), "sets")


def leaders(rows: DataFrame) -> DataFrame:
    """(a, b): each class with the classes that lead its keys, the least and the greatest of each key."""
    keys = rows.select("cls", F.explode("keys").alias("key"))
    ends = keys.groupBy("key").agg(F.min("cls").alias("y"), F.max("cls").alias("z")).where("y <> z")
    led = keys.join(materialise(ends, "leaders"), "key").select(F.explode(F.array("y", "z")).alias("l"), "cls").where("l <> cls")
    return led.select(F.least("l", "cls").alias("a"), F.greatest("l", "cls").alias("b")).distinct()


def differing(a: str, b: str, words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(words)])


def may_link(a: str, b: str, words: int, percent: int = PERCENT) -> Column:
    """Sizes and bitmaps admit a link: the overlap is at most (sizes - differing bits) / 2."""
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (differing(a, b, words) * (100 + percent) <= (100 - percent) * (m + n))


def bounded(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, differ): the pairs that the whole bitmaps admit, and the share in which those differ."""
    a, b = (classes.select(F.col("cls").alias(x), F.struct("n", "bits").alias(f"_{x}")) for x in "ab")
    share = (differing("_a", "_b", BITS // 64) / (F.col("_a.n") + F.col("_b.n"))).alias("differ")
    return pairs.join(a, "a").join(b, "b").where(may_link("_a", "_b", BITS // 64, percent)).select("a", "b", share)


def tiles(tokens: DataFrame, classes: DataFrame, roots: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs of classes of different components that share a tile and whose bound admits a link.

    tokens: (token, cls, place).  Before the first shingle that two sets share, in the common order, neither holds a common one;
    so a linked pair passes the bound by places there, and only there it is sure to be met."""
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("int")
    words, step = BITS // 64, FOLDED // 64
    folded = F.array(*(reduce(lambda x, y: x.bitwiseXOR(y), [F.col("bits")[i] for i in range(k, words, step)]) for k in range(step)))
    facts = classes.select("cls", "n", folded.alias("bits"), band.alias("band")).join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "n", "bits", "band", F.coalesce("root", "cls").alias("root"))
    facts = materialise(facts, "facts")
    ahead = Window.partitionBy("cls").orderBy("place", "token").rowsBetween(-EARLIER, -1)
    own = tokens.withColumn("before", F.collect_list("token").over(ahead)).join(facts.select("cls", "root", "band"), "cls")
    spread = own.select("token", "cls", "place", "before", "root", "band", F.explode(F.array("band", F.col("band") + 1)).alias("tile"))
    busy = spread.groupBy("token", "tile").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token", "tile")
    rows = spread.join(materialise(busy, "tiles"), ["token", "tile"])
    rows = materialise(rows.join(facts.select("cls", "n", "bits"), "cls"), "tile-rows")
    a, b = rows.alias("a"), rows.alias("b")
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    meets = ((F.col("a.token") == F.col("b.token")) & (F.col("a.tile") == F.col("b.tile")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root"))
             & (F.greatest("a.band", "b.band") == F.col("a.tile")) & (rest * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n")))
             & may_link("a", "b", step, percent) & ~F.arrays_overlap("a.before", "b.before"))
    return a.join(b, meets).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Per row of the input: doc_id, th (hash of its text), n_shingles, component_id, root (the component's
    own name, null without shingles)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = described(docs, width)
    rows = found.where(F.col("bucket").isNull())
    classes = rows.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.min_by(F.struct("doc_id", "th"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("rep"),
        F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.min("proof").alias("p"), F.max("proof").alias("q"))
    classes = materialise(classes, "classes")
    if not classes.where("p <> q").isEmpty():
        raise ValueError("two sets share a 64-bit class; change the seeds of signature()")
    led = materialise(bounded(leaders(classes), classes, percent), "led-pairs")
    near, roots, _ = nearest(led, sets_of(docs, classes, led, width=width), None, percent)
    sent = spark.sparkContext.broadcast(order_levels(found))
    tokens = docs.select("text").mapInArrow(lambda it: _prefixes(sent.value, percent, width)(it), "token long, cls long, place int").repartition("token")
    shared = tokens.groupBy("token").agg(F.min("cls").alias("r"), F.max("cls").alias("s")).where("r <> s").select("token")
    tokens = materialise(tokens.join(shared, "token").distinct(), "shared-prefixes")  # one exchange serves all of it
    pairs = materialise(bounded(tiles(tokens, classes, roots, percent), classes, percent), "tile-pairs")
    admitted = _met(pairs, sets_of(docs, classes, pairs, wide, width), _admits(percent))
    pairs = materialise(pairs.join(admitted, ["a", "b"]), "wide-pairs")
    sets = sets_of(docs, classes, pairs, width=width)
    near, _, pairs = nearest(pairs, sets, near, percent)
    roots = components(near.unionByName(linked(pairs, sets, percent)))
    named = classes.select("cls", "least").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    named = materialise(named, "class-roots")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = materialise(named.join(smallest, "root").select("cls", "component_id", "root"), "class-components")
    return rows.join(of_class, "cls", "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def unique_documents(docs: DataFrame, **how) -> DataFrame:
    """Pipeline stage: of each component one document stays, that with the least doc_id (then text hash; a null id last);
    of documents without shingles one of each doc_id and text.  All columns of the input pass on, whatever their names."""
    own = jaccard_components(docs, **how).select("doc_id", "th", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("k")
    kept = own.where(F.col("root").isNotNull()).groupBy("root").agg(first).select("k.doc_id", "k.th")
    kept = materialise(kept.unionByName(own.where(F.col("root").isNull()).select("doc_id", "th")).distinct(), "kept")
    rows = aside(docs, F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("own"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("own").eqNullSafe(F.col("th")), "left_semi")
    return rows.dropDuplicates(["id", "own"]).select("_row.*")


OP10_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, x from (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end) as x from w)),
n as (select doc_id, count(x) as n from w left join s using (doc_id) group by 1),
sized as (select s.doc_id, x, n from s join n using (doc_id)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o, any_value(a.n) as an, any_value(b.n) as bn
      from sized a join sized b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
l as (select a, b from p where 100 * o >= 85 * (an + bn - o)),
e as (select a, b from l union all select b, a from l),
r as (with recursive reach(node, root) as (select a, a from e union select e.b, reach.root from reach join e on e.a = reach.node) select node, min(root) as root from reach group by 1)
select n.doc_id, cast(n as bigint) as n_shingles, coalesce(root, n.doc_id) as component_id from n left join r on r.node = n.doc_id
"""
