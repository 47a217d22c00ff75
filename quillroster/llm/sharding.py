"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A document descends from the root to a region, a rack and a shard. At each level every child draws
-ln(u) / weight, u being a hash of the document's key and the child's name, and the smallest draw
wins. A child's draw depends on nothing but the key, its name and its weight, so a changed weight
moves rows only into or out of the subtree on whose path it lies.

A shard that is added later joins the draw at the root under its own weight (its region and rack
are where it stands, not how it is found), so that it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillroster.llm.common import materialise, text_of

SHARDS, RACK_SHARDS, REGION_RACKS = 40, 4, 2
#: Sub-groups of a shard in which slots are counted; shards x buckets rows are broadcast.
SLOT_BUCKETS = 256


@dataclass
class HashTree:
    """regions[r][k][s] is the weight of shard s of rack k of region r; added: weights of later shards."""

    regions: list[list[list[float]]]
    added: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, shards: int, added: int = 0, rack: int = RACK_SHARDS, racks: int = REGION_RACKS) -> HashTree:
        """Equal weights: racks of `rack` shards, regions of `racks` racks, the last ones maybe smaller."""
        cut = lambda xs, n: [xs[i : i + n] for i in range(0, len(xs), n)]
        return cls(cut(cut([1.0] * shards, rack), racks), [1.0] * added)

    def __post_init__(self) -> None:
        weights = [w for region in self.regions for rack in region for w in rack] + self.added
        if not weights or min(weights) < 0 or not sum(weights) > 0:
            raise ValueError("weights must not be negative, and one at least must be positive")

    def children(self) -> tuple[list, list, list, int]:
        """Lists of (index, name, weight) for the root, each region and each rack; the number of shards."""
        root, region_of, rack_of, shard = [], [], [], 0
        for r, region in enumerate(self.regions):
            racks = []
            for k, rack in enumerate(region):
                leaves = []
                for s, w in enumerate(rack):
                    leaves.append((shard, f"s{r}.{k}.{s}", w))
                    shard += 1
                racks.append((len(rack_of), f"k{r}.{k}", float(sum(rack))))
                rack_of.append(leaves)
            region_of.append(racks)
            root.append((r, f"r{r}", sum(w for _, _, w in racks)))
        for i, w in enumerate(self.added):
            root.append((-1 - (shard + i), f"added{i}", w))
        return root, region_of, rack_of, shard + len(self.added)


def _nodes(children: list[tuple[int, str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("index"), F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for i, name, w in children])


def _drawn(key: Column, nodes: Column) -> Column:
    """Index of the child with the smallest draw; children of weight 0 never win."""
    uniform = lambda n: (F.shiftrightunsigned(F.xxhash64(key, n["name"]), 11).cast("double") + 0.5) / float(2**53)
    draws = F.transform(F.filter(nodes, lambda n: n["weight"] > 0), lambda n: F.struct((-F.log(uniform(n)) / n["weight"]).alias("draw"), n["index"].alias("index")))
    return F.array_min(draws)["index"]


def placed(df: DataFrame, key: Column, tree: HashTree, out: str) -> DataFrame:
    """df with the shard of each row's key in column out."""
    root, region_of, rack_of, _ = tree.children()
    many = lambda lists: F.array(*[_nodes(x) for x in lists])
    region, rack = f"{out}_region", f"{out}_rack"
    df = df.withColumn(region, _drawn(key, _nodes(root)))
    df = df.withColumn(rack, F.when(F.col(region) >= 0, _drawn(key, F.get(many(region_of), F.col(region)))))
    shard = F.when(F.col(region) >= 0, _drawn(key, F.get(many(rack_of), F.col(rack)))).otherwise(-1 - F.col(region))
    return df.withColumn(out, shard.cast("int")).drop(region, rack)


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: HashTree | None = None, grown: HashTree | None = None) -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the tree decide (law `key`); grown defaults to the tree with one more shard of mean
    weight. A null id is a key like any other; rows that repeat an id share its shard and take slots
    of their own. Null text has no bytes. Slots count from 0 without gaps in each shard, in order of
    the id within hashed sub-groups, so that no shard's rows have to meet in one task, and neither
    have equal rows: a row's sub-group depends on the part of the table that it is read from too, and
    so does its slot. An empty table gives an empty result; other columns of df are neither read nor
    returned.
    """
    tree = tree or HashTree.of(SHARDS)
    if grown is None:
        weights = [w for region in tree.regions for rack in region for w in rack] + tree.added
        grown = HashTree(tree.regions, [*tree.added, sum(weights) / len(weights)])
    text = text_of(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = placed(placed(rows, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grown, "grown_shard")
    rows = materialise(rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.spark_partition_id()), F.lit(SLOT_BUCKETS)).cast("int")), "placed")
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(within))
    # starts has at most shards x SLOT_BUCKETS rows, so it may be broadcast at any size of df.
    return ranked.join(F.broadcast(starts), ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_rank") - 1).alias("slot"), "grown_shard",
    )
