"""Trie of conversation prefixes, with subtree totals by parallel tree contraction.

1. Turns are reduced to two 64-bit hashes of role and text and the text's words, numbered inside their conversation
   (``spread.numbered``), and joined to the rebuilt conversation's place.
2. The prefix of d turns is named by sums over its turns of hashes of (place, turn), four of 32 bits: a prefix sum
   instead of a chain of hashes, so that blocks of turns are summed apart and a conversation of any length
   isn't one task's.  A node is a distinct name; its members are counted, not listed.
3. Contraction: the tree is (id, parent, own totals, pending totals of the edge to the parent).  A round rakes all leaves, whose
   totals are final and go to their parents, and compresses chains: a node with one child left whose hash in the round
   is less than its parent's and its child's is taken out; its child gets its parent, and the edge its totals.  No two neighbours
   go together, so one join does it.  Each round takes all leaves and a third of all chain nodes, so rounds grow with the
   logarithm of the nodes, also for one conversation of millions of turns.
4. Expansion: a node that was taken out is its child's total plus what the edge and it held then.  Children taken
   out later are followed by doubling, then all get the totals that the rakes found.

A node's last members are hashed in the order of their ids: parts of 256 neighbouring ids are joined to strings, and the
parts of a node stream through one SHA-256; that hash is sequential, but no list is ever held.

Edge cases: turns are ordered by turn (null first), then by hashes of role and text, and repeated rows are turns of
their own; null role or text is empty; rows without conv_id are no conversation; conv_id may be negative (``%`` keeps
the sign); an empty table has no conversations and gives no rows, not even a root; other columns don't matter.
Names of 128 bits stand for prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.llm.shared import stored
from headway.llm.spread import numbered, spread_join

#: Turns whose hashes are summed in one window.
TURNS = 1024
#: A part of ids that are joined to a string has 2 ** PART at most.
PART = 8
_SUMS = ["s0", "s1", "s2", "s3"]
_TOTALS = ["leaves", "tokens"]


def _head(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4))


def turns_of(spark: SparkSession, conversations: DataFrame, names: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """(conv, nth, a, b, words) of every turn: its number from 0, two hashes of role and text, and the words of its text."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in names)
    said = F.struct(F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit("")))
    words = F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))
    rows = conversations.where(conv.isNotNull()).select(conv.cast("long").alias("conv"), turn.alias("turn"), F.xxhash64(F.lit(1), said).alias("a"), F.xxhash64(said, F.lit(2)).alias("b"), words.alias("words"))
    return numbered(spark, rows, "conv", ["turn", "a", "b"], "nth").drop("turn")


def rebuilt(spark: SparkSession, turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv, place, a, b, words) of the rebuilt turns, and (conv, length) of all conversations, both stored.

    The first turns come from conversation c - c % every, their number from c's checksum; the rest are c's own.
    """
    turns = stored(spark, turns)
    lengths = turns.groupBy("conv").agg(F.count("*").alias("own"))
    convs = lengths.withColumns({"base": F.col("conv") - F.col("conv") % every, "head": _head(F.col("conv"))})
    bases = lengths.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
    convs = stored(spark, convs.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("head"))))
    first = turns.where("nth < 3").select(F.col("conv").alias("base"), "nth", "a", "b", "words")
    lent = convs.select("conv", "base", "taken").join(first, "base").where("nth < taken")
    kept = spread_join(turns, convs.select("conv", "head", "taken"), "conv").where("nth >= head")
    cols = ["conv", "place", "a", "b", "words"]
    out = lent.withColumn("place", F.col("nth")).select(cols).unionByName(kept.withColumn("place", F.col("nth") - F.col("head") + F.col("taken")).select(cols))
    return stored(spark, out), convs.select("conv", "length")


def _name(depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[F.col(s).cast("string") for s in _SUMS])))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, id, parent, words) of every prefix of one turn or more; block sums and sums inside a block."""
    parts = []
    for seed, side in ((1, "a"), (2, "b")):
        h = F.xxhash64(F.lit(seed), "place", "a", "b")
        parts += [h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)]
    rows = turns.select("conv", "place", "words", F.shiftright("place", 10).alias("block"), *[p.alias(f"h{i}") for i, p in enumerate(parts)])
    sums = rows.groupBy("conv", "block").agg(*[F.sum(f"h{i}").alias(f"t{i}") for i in range(4)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "block", *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"t{i}") for i in range(4)])
    upto = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *[F.sum(f"h{i}").over(upto).alias(f"u{i}") for i in range(4)]).join(sums, ["conv", "block"])
    here = {s: F.col(f"t{i}") + F.col(f"u{i}") for i, s in enumerate(_SUMS)}
    there = {s: F.col(s) - F.col(f"h{i}") for i, s in enumerate(_SUMS)}
    named = summed.withColumns(here).withColumn("id", _name(F.col("place") + 1)).withColumns(there)
    return named.select("conv", (F.col("place") + 1).alias("depth"), "id", _name(F.col("place")).alias("parent"), "words")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams a task's parts, in order of node and part, through one hash a node."""
    node, state = None, None
    for batch in batches:
        out = []
        for own, ids in zip(batch["id"], batch["ids"], strict=True):
            own = bytes(own)
            if own != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["id", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["id", "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of (id, conv): the conversations in ascending order, joined by commas and hashed."""
    parts = ends.groupBy("id", F.shiftright("conv", PART).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return parts.repartition("id").sortWithinPartitions("id", "part").select("id", "ids").mapInPandas(_digests, "id binary, ends_sha256 string")


def subtree_totals(spark: SparkSession, tree: DataFrame, totals: list[str], *, seed: int = 13) -> DataFrame:
    """(id, totals) of every node of a forest (id, parent, totals): sums over its subtree, by rake and compress.

    A root's parent is null.  Ids are any hashable column type and unique; every other parent is an id.
    """
    coin = lambda c, k: F.xxhash64(F.lit(seed), F.lit(k), c)
    pending = [f"{t}_edge" for t in totals]
    children = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("kids"))
    active = tree.select("id", "parent", *totals).join(children.withColumnRenamed("parent", "id"), "id", "left")
    active = active.withColumns({"kids": F.coalesce("kids", F.lit(0)), **{e: F.lit(0).cast("long") for e in pending}})
    active = stored(spark, active.withColumns({"child": F.lit(None).cast(tree.schema["id"].dataType), "out": F.lit(False)}))
    raked, taken, k = [], [], 0
    while True:
        leaf, live = F.col("kids") == 0, active.where(~F.col("out"))
        raked.append(live.where(leaf).select("id", *totals))
        taken.append(active.where("out").select("id", F.col("child").alias("next"), *[(F.col(t)).alias(t) for t in totals]))
        if live.where(~leaf).isEmpty():
            break
        k += 1
        sums = [F.sum(F.when(leaf, F.col(t) + F.col(e)).otherwise(0)).alias(f"{t}_add") for t, e in zip(totals, pending, strict=True)]
        kept = F.max(F.when(~leaf, F.struct("id", *pending))).alias("kept")  # the one child, if one is left
        below = live.where("parent IS NOT NULL").groupBy("parent").agg(*sums, F.count_if(~leaf).alias("left"), kept)
        now = live.where(~leaf).drop("child", "kids", "out").join(below.withColumnRenamed("parent", "id"), "id")
        now = now.withColumns({**{t: F.col(t) + F.col(f"{t}_add") for t in totals}, "child": F.col("kept.id")})
        mine = coin(F.col("id"), k)
        now = now.withColumn("out", (F.col("left") == 1) & F.col("parent").isNotNull() & (mine < coin(F.col("parent"), k)) & (mine < coin(F.col("child"), k)))
        cut = now.where("out").select(F.col("child").alias("id"), F.col("parent").alias("above"), *[(F.col(t) + F.col(e)).alias(f"{t}_up") for t, e in zip(totals, pending, strict=True)])
        # what a node that goes needs later: its own totals and the edge to its child as they are now
        held = {t: F.when(F.col("out"), F.col(t) + F.col(f"kept.{e}")).otherwise(F.col(t)) for t, e in zip(totals, pending, strict=True)}
        after = now.withColumns(held).join(cut, "id", "left")
        edges = {e: F.col(e) + F.coalesce(f"{t}_up", F.lit(0)) for t, e in zip(totals, pending, strict=True)}
        after = after.withColumns({"parent": F.coalesce("above", "parent"), "kids": F.col("left"), **edges})
        active = stored(spark, after.select("id", "parent", *totals, "kids", *pending, "child", "out"))
    known = reduce(DataFrame.unionByName, raked)
    links = stored(spark, reduce(DataFrame.unionByName, taken).withColumn("more", F.lit(True)))
    while not links.where("more").isEmpty():
        further = links.select(F.col("id").alias("next"), F.col("next").alias("then"), *[F.col(t).alias(f"{t}_then") for t in totals])
        step = links.join(further, "next", "left")
        step = step.withColumns({"more": F.col("then").isNotNull(), **{t: F.col(t) + F.coalesce(f"{t}_then", F.lit(0)) for t in totals}})
        links = stored(spark, step.select("id", F.coalesce("then", "next").alias("next"), *totals, "more"))
    last = known.select(F.col("id").alias("next"), *[F.col(t).alias(f"{t}_last") for t in totals])
    again = links.join(last, "next").select("id", *[(F.col(t) + F.col(f"{t}_last")).alias(t) for t in totals])
    return known.unionByName(again)


def trie(spark: SparkSession, turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv, place, a, b, words), whose conversations have (conv, length), with their totals.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; id and parent are 16 bytes.
    """
    rows = stored(spark, prefixes(turns))
    root = F.unhex(F.md5(F.lit("0,0,0,0,0")))
    nodes = rows.groupBy("id").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    top = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = nodes.unionByName(top.select(root.alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs"))
    children = rows.groupBy("parent", "id").agg(F.lit(1)).groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id")
    nodes = stored(spark, nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    totals = subtree_totals(spark, own, _TOTALS)
    lasts = rows.select("conv", "depth", "id").unionByName(lengths.where("length = 0").select("conv", F.lit(0).cast("long").alias("depth"), root.alias("id")))
    ends = lasts.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"], "left_semi")
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = spread_join(nodes, above, "parent").join(totals, "id").join(ends_of(ends.select("id", "conv")), "id", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "id", "parent")


def report(spark: SparkSession, conversations: DataFrame, **options) -> DataFrame:
    """The digest columns of the trie of all rebuilt conversations."""
    turns, lengths = rebuilt(spark, turns_of(spark, conversations, **options))
    return trie(spark, turns, lengths).drop("id", "parent")
