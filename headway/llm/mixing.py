"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes are words.  Sources in code point order (null last) have the weights in turn, and share the
   total by weight; a target stops at ``repeats`` times its source's size and the excess goes to the
   others by weight, until none is above.
2. A source's documents are permuted by a seeded hash and dealt to about sqrt(documents) blocks, so
   that neither a block nor a source's list of blocks is long, however hot the source.  The mix makes
   floor(target / size) whole passes over the blocks and one part pass, which takes whole blocks and, of the block
   in which the target lies, the documents that still fit, in permuted order; what is then left of the target
   is less than the smallest document of that block that stays out, which is taken if that comes nearer.
   Each (pass, block) is one draw.
3. The draws of all sources are split among output shards by a binary tree: at each node a
   multivariate hypergeometric draw says how many of each source's draws go left.  The quotas are exact
   at every node and shards are equally large in draws.  Sources are split in groups of about ``GROUP`` (the
   same draw, first between groups and then inside one) and ``LEAVES`` shards at a time; each task walks only the
   nodes above its own leaves.  The sources' permuted draws fill the quotas in turn, so that they are disjoint.
4. In a shard, documents are ordered by a seeded hash of pass and document.

Edge cases: null text has size 0, is never drawn and has taken 0; a source of size 0 has target 0; a null
source is a source of its own; null and repeated ids are documents of their own where their texts differ, rows of equal
id and text are drawn alike within a source; an empty table gives an empty mix; all other columns stay, under any names.  Reruns agree: every random
choice hangs on ``seed`` and the document alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from headway.llm.shared import stored

WEIGHTS = (5, 2, 1)
REPEATS = 3
SHARD_WORDS = 2_000_000
GROUP = 50_000
LEAVES = 256


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _key(source: str) -> Column:
    """Sorts as the sources do, null last, and joins null to null."""
    return F.coalesce(F.concat(F.lit("0"), F.col(f"`{source}`").cast("string")), F.lit("1"))


def targets(spark: SparkSession, sized: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(key, docs, source_size, target) of each source of (key, size)."""
    sums = sized.groupBy("key").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("key")) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = stored(spark, sums.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(repeats))))
    level, full = 0.0, -1
    while True:  # each round at least one more source is full
        above = F.col("most") <= F.col("weight") * F.lit(level)
        r = rows.agg(F.sum("source_size").alias("total"), F.sum(F.when(above, F.col("most")).otherwise(0.0)).alias("fixed"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(above).alias("full")).first()
        if r.full == full or not r.open:
            break
        full, level = r.full, max(level, (r.total - r.fixed) / r.open)
    return rows.select("key", "docs", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def _fill(units: pd.DataFrame) -> pd.DataFrame:
    """The units (documents of one place) of a source's last block that its part pass takes."""
    units = units[units["words"] > 0].sort_values("place", kind="stable")
    words, gap, taken = units["words"].to_numpy(), float(units["gap"].iloc[0]) if len(units) else 0.0, np.zeros(len(units), bool)
    for i, w in enumerate(words):
        if w <= gap:
            taken[i], gap = True, gap - w
    if not taken.all():
        least = int(np.argmin(np.where(taken, np.iinfo(np.int64).max, words)))
        taken[least] = taken[least] or words[least] < 2 * gap
    return units.loc[taken, ["key", "block", "place"]]


def _quotas(totals: list[int], shards: int, seed: int):
    """Walks the splitting tree down to the shards of one range, for the sources of one group.

    ``totals``: draws of each group.
    """
    every = sum(totals)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        group, first = int(part["grp"].iloc[0]), int(part["range"].iloc[0]) * LEAVES
        last, part = min(first + LEAVES, shards), part.sort_values("key")
        out, todo = [], [(0, shards, np.array(totals, dtype=np.int64), part["n"].to_numpy(np.int64))]
        while todo:
            a, b, groups, have = todo.pop()
            if b - a == 1:
                out.append(pd.DataFrame({"key": part["key"].to_numpy(), "shard": a, "n": have})[have > 0])
                continue
            mid = (a + b) // 2
            left = every * mid // shards - every * a // shards
            went = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(groups, left, method="marginals")
            own = np.random.default_rng([seed, a, b, group + 1]).multivariate_hypergeometric(have, went[group], method="marginals")
            todo += [x for x in ((a, mid, went, own), (mid, b, groups - went, have - own)) if x[0] < last and x[1] > first]
        return pd.concat(out) if out else pd.DataFrame({"key": [], "shard": [], "n": []})

    return run


_DRAWS = "array<struct<pass:bigint,shard:bigint>>"


def plan(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, *, seed: int = 17, shards: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: bool = False) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, draws (array of pass, shard).

    ``keep`` adds the input's row as struct ``row``.
    """
    own = F.col(f"`{id_col}`")
    place = F.xxhash64(F.lit(seed), own.cast("string"), F.col(f"`{text_col}`").cast("string"))
    columns = [own.alias("doc_id"), _size(text_col).alias("size"), _key(source_col).alias("key"), place.alias("place")]
    sized = stored(spark, docs.select(*columns))
    goal = stored(spark, targets(spark, sized, weights, repeats).withColumns({
        "n_blocks": F.greatest(F.lit(1), F.least(F.ceil(F.sqrt("docs")), F.floor(F.col("docs") / 16))),
        "passes": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    }).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    block = F.pmod("place", "n_blocks").alias("block")
    in_source = Window.partitionBy("key").orderBy("block")
    sums = sized.join(goal, "key").groupBy("key", block, "passes", "rest").agg(F.sum("size").alias("words"))
    blocks = stored(spark, sums.withColumn("gap", F.col("rest") - F.sum("words").over(in_source) + F.col("words")).where("words > 0"))  # what is left of the part pass at the block
    # a draw for each whole pass, and one where the part pass reaches the block
    draws = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).where((F.col("pass") < F.col("passes")) | (F.col("gap") > 0))
    draws = stored(spark, draws.select("key", "block", "pass", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "block", "pass"), "block", "pass")).alias("nth")))
    if shards is None:
        shards = max(1, round((goal.agg(F.sum("target")).first()[0] or 0) / SHARD_WORDS))
    by_source = draws.groupBy("key").agg(F.count("*").alias("n"))
    groups = math.ceil(goal.count() / GROUP) or 1
    by_source = stored(spark, by_source.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")))
    held = {r.grp: r.n for r in by_source.groupBy("grp").agg(F.sum("n").alias("n")).collect()}  # one number a group
    ranges = by_source.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit((shards - 1) // LEAVES))))
    leaves = ranges.groupBy("grp", "range").applyInPandas(_quotas([held.get(g, 0) for g in range(groups)], shards, seed), "key string, shard long, n long")
    leaves = stored(spark, leaves.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("shard"))))
    places = leaves.select("key", "shard", F.explode(F.sequence((F.col("upto") - F.col("n") + 1).cast("int"), F.col("upto").cast("int"))).alias("nth"))
    by_block = draws.join(places, ["key", "nth"]).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))  # at most repeats + 1
    last = sized.join(goal.select("key", "n_blocks"), "key").withColumn("block", block)
    last = last.join(blocks.where("gap > 0 and gap < words").select("key", "block", "gap"), ["key", "block"])
    units = last.groupBy("key", "block", "place", "gap").agg(F.sum("size").alias("words"))
    taken = units.groupBy("key", "block").applyInPandas(_fill, "key string, block long, place long")  # one block of each source
    taken = taken.groupBy("key", "block").agg(F.collect_list("place").alias("taken"))
    state = blocks.select("key", "block", (F.col("gap") >= F.col("words")).alias("full"), "passes").join(by_block, ["key", "block"], "left").join(taken, ["key", "block"], "left")
    state = stored(spark, state)
    rows = docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if keep else sized
    placed = rows.join(goal.select("key", "n_blocks", "source_size", "target"), "key").withColumn("block", block)
    out = placed.join(state, ["key", "block"], "left")
    part = F.col("full") | F.coalesce(F.array_contains("taken", F.col("place")), F.lit(False))
    drawn = F.filter(F.coalesce("draws", F.array().cast(_DRAWS)), lambda d: (d["pass"] < F.col("passes")) | part)
    some = F.when(F.col("size") > 0, drawn).otherwise(F.array().cast(_DRAWS))
    return out.select("doc_id", "size", "source_size", "target", some.alias("draws"), *(["row"] if keep else []))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, *, names: tuple[str, str, str] = ("mix_shard", "mix_pass", "mix_order"), **options) -> DataFrame:
    """The mixed rows themselves: the input's columns, then shard, pass and order under ``names``.

    Written with ``repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")`` they are the
    shards, each shuffled.  A name that the input has already gets underscores in front.
    """
    options.setdefault("seed", 17)
    found = plan(spark, docs, weights, repeats, keep=True, **options)
    have = {c.lower() for c in docs.columns}
    free = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        free.append(name)
    drawn = found.select("doc_id", "row", F.explode("draws").alias("d"))
    order = F.xxhash64(F.lit(options["seed"]), F.col("d")["pass"], F.col("doc_id").cast("string"))
    own = (F.col("d")["shard"], F.col("d")["pass"], order)
    return drawn.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[x.alias(n) for x, n in zip(own, free, strict=True)])


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``plan``'s result, and the shards that the splitting tree deals each document to."""
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), shards.alias("shards"))
