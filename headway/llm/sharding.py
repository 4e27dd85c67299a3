"""Sharding by a hierarchical weighted hash tree.

Every shard stands under a rack, a region and a generation, and has a weight; a node's weight is the sum of its shards'.
A key descends three levels: at each, every child of the node it has reached draws -ln(u) / weight, with u from a hash of the key
and the child's path, and the least draw wins.  A child wins in proportion to its weight, and the draw of a child depends
on nothing but its own path and weight.  So:

* where a shard's weight changes, only draws on its path change; keys move only between that path's subtrees and the rest, and never
  between two subtrees whose weights stayed as they were;
* a shard that is added later stands in a generation of its own, which is a child of the root beside the regions that were
  there: keys move into the new shard and nowhere else (law ``key``), whatever region and rack it physically joins.

The assignment is one expression of the key: no row is moved, counted or looked up to place it.  Only the tree is
data of the plan; it is a literal with one entry a shard.

Slots number a shard's rows from 0 without gaps, in order of key, checksum and size; rows alike in all three are
interchangeable.  No shard's rows come together in one task (``spread.numbered``).

Edge cases: a null key is a key as any other; a null text has no bytes, the checksum 0 and size 1; repeated rows each have a
slot of their own; a shard of weight 0 gets nothing, one shard gets all; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.spread import numbered


@dataclass(frozen=True)
class Shard:
    shard: int
    region: str
    rack: str
    weight: float = 1.0
    generation: int = 0


def regular(regions: int, racks: int, shards: int) -> list[Shard]:
    """A tree of equal weights: shards are numbered through racks, racks through regions."""
    every = [(r, k, s) for r in range(regions) for k in range(racks) for s in range(shards)]
    return [Shard(i, f"r{r}", f"r{r}k{k}") for i, (r, k, _) in enumerate(every)]


def grown(tree: Sequence[Shard], region: str, rack: str, weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a generation of its own."""
    return [*tree, Shard(max((s.shard for s in tree), default=-1) + 1, region, rack, weight, max((s.generation for s in tree), default=-1) + 1)]


def _levels(tree: Sequence[Shard]) -> list[list[list[tuple[str, float, int]]]]:
    """For each level its nodes' children as (path, weight, place of the child among the nodes of the next level)."""
    if len({s.shard for s in tree}) < len(tree) or any(not s.weight >= 0 or s.weight == float("inf") for s in tree) or not any(s.weight > 0 for s in tree):
        raise ValueError("shards have to be different and weights finite, not negative and not all zero")
    paths = [(f"{s.generation}/{s.region}", f"{s.generation}/{s.region}/{s.rack}", f"{s.generation}/{s.region}/{s.rack}/{s.shard}") for s in tree]
    weight: dict[str, float] = {}
    for s, path in zip(tree, paths, strict=True):
        for p in path:
            weight[p] = weight.get(p, 0.0) + s.weight
    numbers = {p[-1]: s.shard for s, p in zip(tree, paths, strict=True)}
    levels, nodes = [], [""]
    for depth in range(3):
        children = {n: sorted({p[depth] for p in paths if (p[depth - 1] if depth else "") == n and weight[p[depth]] > 0}) for n in nodes}
        below = [c for n in nodes for c in children[n]]
        at = numbers if depth == 2 else {c: i for i, c in enumerate(below)}
        levels.append([[(c, weight[c], at[c]) for c in children[n]] for n in nodes])
        nodes = below
    return levels


def shard_of(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard (int) of a key: three draws, each among the children of the node that won the draw before."""

    def drawn(children: Column, hashed: Column) -> Column:
        def draw(c: Column) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(hashed, c["path"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["path"].alias("path"), c["at"].alias("at"))

        return F.array_min(F.transform(children, draw))["at"]

    def literal(children) -> Column:
        return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(at).alias("at")) for p, w, at in children])

    hashed, node = F.xxhash64(key), F.lit(0)
    for nodes in _levels(tree):
        node = drawn(F.element_at(F.array(*map(literal, nodes)), node + 1), hashed)
    return node


def placed(docs: DataFrame, tree: Sequence[Shard], name: str = "shard", id_col: str = "doc_id") -> DataFrame:
    """The rows with their shard as column ``name``; written with ``partitionBy(name)`` they are the shards."""
    return docs.withColumn(name, shard_of(F.col(f"`{id_col}`"), tree))


def report(spark: SparkSession, docs: DataFrame, tree: Sequence[Shard], later: Sequence[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; ``later`` is the tree with one more shard."""
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shard_of(key, tree).alias("shard"), shard_of(key, later).alias("grown_shard"))
    slots = numbered(spark, rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
