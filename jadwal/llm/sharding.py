"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions, racks and shards, each with a weight; a node's weight is the sum of its leaves.
A row descends level by level: every child of the node draws -ln(u) / weight from the hash of the row's
key and the child's name, and the smallest draw wins. A child's draw depends on nothing but the key, its
own name and its own weight, so a raised weight only pulls rows into that child, and movement stays in the
subtrees whose weights change. A new shard is attached as a region of its own: rows move into it only.

Slots are gapless within a shard without sorting a shard in one task: equal rows are counted, the counts are summed up within
(shard, bucket), and a small table of bucket sizes gives each bucket its first slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jadwal.llm.common import partitions, table, written

BUCKET_ROWS = 65_536  # rows of a shard that are numbered together
REPEATS = 65_536  # equal rows that one task writes


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


# Racks and regions have unique names across the tree.
def layout(n_regions: int, racks: int, shards: int) -> list[Leaf]:
    """A regular tree; shards are numbered from 0 in order."""
    return [Leaf(f"r{i}", f"r{i}k{j}", (i * racks + j) * shards + k) for i in range(n_regions) for j in range(racks) for k in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, as a region of its own."""
    n = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(f"new{n}", f"new{n}k0", n, weight)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1] from 53 bits of the hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, name), 11).cast("double") + 1) / F.lit(float(2**53))
    return -F.ln(u) / weight


def _descend(key: Column, children: Column) -> Column:
    """The child (name, weight, below) with the smallest draw; ties go to the smaller name."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name"), c["below"].alias("below")))
    return F.array_min(drawn)


def _level(leaves: list[Leaf], above: str, level: str, names: list[str], below: list[str]) -> Column:
    """For each node in ``names``, its children; ``below`` gives a child's place on the next level."""
    nodes = []
    for name in names:
        weights: dict[str, float] = {}
        for leaf in leaves:
            if not above or getattr(leaf, above) == name:
                child = str(getattr(leaf, level))
                weights[child] = weights.get(child, 0.0) + leaf.weight
        nodes.append(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("weight"), F.lit(below.index(c) + 1 if below else int(c)).alias("below")) for c, w in sorted(weights.items())]))
    return F.array(*nodes)


def with_shard(df: DataFrame, key: str, tree: list[Leaf], out: str) -> DataFrame:
    """``df`` with column ``out``: the shard of ``key``. Null keys share one hash and so one shard."""
    tree = [leaf for leaf in tree if leaf.weight > 0]
    if not tree:
        raise ValueError("the tree has no shard with a weight")
    regions, racks = sorted({leaf.region for leaf in tree}), sorted({leaf.rack for leaf in tree})
    k = F.col(key)
    region = _descend(k, _level(tree, "", "region", [""], regions)[0])
    rack = _descend(k, F.element_at(_level(tree, "region", "rack", regions, racks), region["below"]))
    shard = _descend(k, F.element_at(_level(tree, "rack", "shard", racks, []), rack["below"]))
    return df.withColumn(out, shard["below"].cast("int"))


def with_slot(df: DataFrame, shard: str, keys: list[str], out: str, buckets: int) -> DataFrame:
    """Gapless numbers from 0 within each shard, in order of bucket and ``keys``, which are all other columns.

    Equal rows are counted first, so that neither a frequent key nor a repeated row makes a large bucket, and the numbers depend
    on the rows alone.
    """
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__m")).withColumn("__b", F.pmod(F.xxhash64(F.lit("slot"), *keys), F.lit(buckets)).cast("int"))
    groups = written(groups, "slots")
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.groupBy(shard, "__b").agg(F.sum("__m").alias("__size")).select(shard, "__b", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    numbered = groups.withColumn("__start", F.coalesce(F.sum("__m").over(inside), F.lit(0))).join(first, [shard, "__b"])
    chunked = numbered.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__m") - 1) / REPEATS))))
    if not groups.where(F.col("__m") > REPEATS).isEmpty():
        chunked = chunked.repartition(partitions(df.sparkSession))
    last = F.least(F.col("__m"), (F.col("__chunk") + 1) * REPEATS) - 1
    rows = chunked.withColumn("__i", F.explode(F.sequence(F.col("__chunk") * REPEATS, last)))
    return rows.select(*df.columns, (F.col("__first") + F.col("__start") + F.col("__i")).cast("long").alias(out))


def shard_rows(df: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Law ``key``: key, size, text_crc32, law, shard, slot, grown_shard for every row.

    The key and the tree alone decide, so equal keys stay together and every repeated row keeps its own
    slot. Null text: size 8 and checksum 0. Null keys share a shard. Other columns are ignored; an
    empty table gives an empty result. The same rows have the same slots however they are partitioned.
    """
    rows = df.select(F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = with_shard(with_shard(rows, key, tree, "shard"), key, grown(tree), "grown_shard")
    buckets = max(1, -(-df.count() // (bucket_rows * max(1, len(tree)))))
    slots = with_slot(rows, "shard", [key, "size", "text_crc32"], "slot", buckets)
    return slots.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), layout(4, 3, 2))
