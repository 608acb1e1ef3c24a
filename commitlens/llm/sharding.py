"""Sharding by a hierarchical weighted hash tree.

A topology is regions -> racks -> shards with a weight on each shard; a node
weighs what its shards weigh.  A key descends from the root: at each level every
child draws ``ln(u) / weight`` with ``u`` uniform from a hash of key and node, and
the largest draw wins.  A draw depends on the child's own weight alone, so a change
of weights moves keys only into subtrees that grew or out of subtrees that shrank.

Defined cases: the key's null counts as the empty string; repeated keys share a
shard; null text has size 8 and checksum 0; an empty table gives an empty result;
other columns of the input pass through.  Columns that the operator adds replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.llm.common import placed, table

#: regions -> racks -> (shard, weight)
Topology = list[list[list[tuple[int, float]]]]
RACKS, SHARDS_PER_RACK = 2, 4


def even_topology(shards: int, racks: int = RACKS, per_rack: int = SHARDS_PER_RACK) -> Topology:
    """Shards of weight 1, filled rack by rack and region by region.  A further shard
    beyond full regions opens a region of its own and so takes keys only into itself."""
    ids = [(s, 1.0) for s in range(shards)]
    in_racks = [ids[i:i + per_rack] for i in range(0, len(ids), per_rack)]
    return [in_racks[i:i + racks] for i in range(0, len(in_racks), racks)]


def _weight(node) -> float:
    return float(node[1]) if isinstance(node, tuple) else sum(map(_weight, node))


def _name(node, place: int) -> str:
    """A shard is named by its number, an inner node by its place below the parent."""
    return f"s{node[0]}" if isinstance(node, tuple) else str(place)


def _draw(key: Column, path: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("|" + path))), 11)
    return F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)


def tree_shard(key: Column, node: Topology | list | tuple, path: str = "root") -> Column:
    """The shard (int) that ``key`` (string) descends to."""
    if isinstance(node, tuple):
        return F.lit(node[0])
    live = [(i, c, f"{path}.{_name(c, i)}") for i, c in enumerate(node) if _weight(c) > 0]
    if not live:
        raise ValueError("a topology needs a shard with a weight above 0")
    if len(live) == 1:
        return tree_shard(key, live[0][1], live[0][2])
    best = F.array_max(F.array(*(F.struct(_draw(key, p, _weight(c)).alias("d"), F.lit(-i).alias("i")) for i, c, p in live)))
    if all(isinstance(c, tuple) for _, c, _ in live):
        return F.element_at(F.array(*(F.lit(c[0] if isinstance(c, tuple) else 0) for c in node)), 1 - best["i"])
    pick, out = best["i"], None
    for i, c, p in live:
        leaf = tree_shard(key, c, p)
        out = F.when(pick == F.lit(-i), leaf) if out is None else out.when(pick == F.lit(-i), leaf)
    return out


def with_shards(df: DataFrame, topology: Topology, key: str = "doc_id", into: str = "shard") -> DataFrame:
    """Narrow: no row moves."""
    return df.withColumn(into, tree_shard(F.coalesce(F.col(key).cast("string"), F.lit("")), topology).cast("int"))


def with_slots(df: DataFrame, group: str = "shard", order: tuple[str, ...] = (), into: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    The rows are checkpointed, sorted by group within their partitions; counts per
    (partition, group) give each run its base by prefix sums.  Only counts are
    gathered, so a group may hold any share of all rows.
    """
    kept = placed(df.sortWithinPartitions(group, *order).checkpoint())
    counts = kept.groupBy("_pid", group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    lower = F.sum("_n").over(Window.partitionBy("_pid").orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0)
    bases = counts.select("_pid", group, (F.coalesce(before, zero) - F.coalesce(lower, zero)).alias("_base"))
    bases = bases.select(F.col("_pid").alias("_of"), F.col(group).alias("_group"), "_base")
    at = (F.col("_pid") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group"))  # null is a group like any other
    return kept.join(bases, at).withColumn(into, F.col("_idx") + F.col("_base")).drop("_pid", "_idx", "_row", "_base", "_of", "_group")


def shard_documents(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Query op1: all documents over 24 shards (3 regions x 2 racks x 4) and with one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"))
    rows = with_shards(rows, even_topology(shards))
    rows = with_shards(rows, even_topology(shards + 1), into="grown_shard")
    return with_slots(rows, order=("doc_id",)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
