"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

1. Targets. Sources, by code point with null last, weigh 1, 2, 3, 1, ... and share all words; a source is given at most
   REPEATS times its own words, and what it cannot take is shared again by weight. With the ratios cap / weight in
   ascending order this has a closed form: the first k sources are at their caps and the others share by weight.
2. Blocks. All words are cut into blocks of equal size; each source gets as many as the highest quotients
   target / (2 n + 1) give it. Only quotients near the last one that gets a block have to be ranked.
3. Shards. A source is dealt over shards of about SHARD_WORDS words by a seeded hash; the source's blocks are
   apportioned to its shards in the same way, by their sizes.
4. Selection. A shard's documents stand in a seeded order and are taken block by block, round after round, until the
   shard's blocks are used. No document is taken more than REPEATS times.

Defined results: a null or empty text has no words and is never taken; documents of size 0 are returned with taken 0;
a table without words has targets of 0; rows that share a doc_id are ordered by their text's
hash (by size: those of one size too are in no set order); extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.llm.common import WORD
from terraweft.session import settle

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK = 64
SHARD_WORDS = 400_000
SEED = 20_240_601


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of each source; sizes has source and source_size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    shared = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    shared = shared.withColumn("cap", F.col("source_size") * REPEATS).withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    # By ascending cap / weight: what the sources up to this one hold at their caps, and the weight of those after it.
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    full = shared.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(upto), F.lit(0))))
    # The first source whose cap is above its share fixes the level of all that follow.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    full = full.withColumn("fixed", level)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("fixed") * F.col("weight"), F.col("cap").cast("double")))
    return full.select("source", "source_size", target.alias("target"))


def apportioned(parties: DataFrame, group: list[str], claim: str, seats: str, key: str) -> DataFrame:
    """parties with a column quota: each group's `seats` whole seats by the highest quotients claim / (2 n + 1).

    A party's seats differ from its exact share q = seats * claim / sum(claim) by less than q * parties / seats + 2, so that
    those below are given at once and only the quotients from there up are ranked.
    """
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    held = parties.withColumn("_parties", F.count("*").over(by)).withColumn("_sum", F.sum(F.col(claim).cast("double")).over(by))
    share = F.when(F.col("_sum") > 0, F.col(seats) * F.col(claim).cast("double") / F.col("_sum")).otherwise(F.lit(0.0))
    held = held.withColumn("_share", share)
    near = (F.ceil(F.col("_share") * F.col("_parties") / F.greatest(F.col(seats), F.lit(1))) + 2).cast("long")
    held = held.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share")).cast("long") - near)).withColumn("_top", F.floor(F.col("_share")).cast("long") + near)
    held = held.withColumn("_left", F.col(seats) - F.sum("_sure").over(by))
    ranked = held.where(F.col(claim) > 0).select(*group, key, claim, "_left", F.explode(F.sequence("_sure", "_top")).alias("_n"))
    best = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc(F.col(claim) / (2 * F.col("_n") + 1)), F.col(key).asc_nulls_last(), "_n")
    won = ranked.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_left"))
    keys = [*group, key]
    won = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    same = None
    for k in keys:
        one = F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}"))
        same = one if same is None else same & one
    out = held.alias("p").join(won.alias("w"), same, "left")
    return out.select(*(F.col(f"p.{c}") for c in parties.columns), (F.col("p._sure") + F.coalesce("w._won", F.lit(0))).alias("quota"))


def mixed(docs: DataFrame, repeats: int = REPEATS, block: int = BLOCK, seed: int = SEED, by: str = "text") -> DataFrame:
    """docs with the columns size, source_size, target and taken (replaced if docs has them).

    by: what the seeded order hashes beside doc_id, `text` or `size`; texts that are changed word for word keep their size.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    # The row travels as one struct, so that no column of docs meets one of the names below.
    sized = docs.select(F.struct(*own).alias("_row"), F.col("doc_id"), F.col("text"), F.col("source")).withColumn("size", words(F.col("text")))
    tie = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.coalesce(by, F.lit("")) if by == "text" else F.col(by).cast("string")))
    # Per source and fine shard first: one small row for each of at most 4096 parts of a source, however large.
    sized = sized.withColumn("_tie", tie).withColumn("_fine", F.conv(F.substring("_tie", 30, 3), 16, 10).cast("int")).drop("text")
    parts = settle(sized.groupBy("source", "_fine").agg(F.sum("size").alias("size")), "parts")
    aimed = targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = parts.agg(F.sum("size")).first()[0] or 0
    seats = aimed.withColumn("seats", F.lit(-(-total // block)).cast("long"))
    seats = apportioned(seats, [], "target", "seats", "source").withColumnRenamed("quota", "blocks").drop("seats")
    # Shards of about SHARD_WORDS words: 2**k of the fine ones together.
    shards = F.pow(F.lit(2.0), F.least(F.lit(12), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("source_size"), F.lit(1)) / SHARD_WORDS))))).cast("int")
    seats = settle(seats.withColumn("shards", shards), "sources")
    sources = seats.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"), "source_size", "target", "blocks", "shards")

    def with_source(df: DataFrame, columns: list[str]) -> DataFrame:
        keyed = df.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())
        deal = F.pmod(F.xxhash64("_tie"), F.lit(32)).cast("int") if "_tie" in df.columns else F.lit(0)
        many = sources.select("_s", "_none", *columns)
        if "_tie" not in df.columns:
            return keyed.join(many, ["_s", "_none"]).drop("_s", "_none")
        many = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        return keyed.withColumn("_salt", deal).join(many, ["_s", "_none", "_salt"]).drop("_s", "_none", "_salt")

    sized_shards = with_source(parts, ["blocks", "shards"]).groupBy("source", "blocks", (F.col("_fine") % F.col("shards")).alias("shard")).agg(F.sum("size").alias("shard_size"))
    quotas = apportioned(sized_shards, ["source"], "shard_size", "blocks", "shard")
    quotas = quotas.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"), "shard", "shard_size", F.least(F.col("quota") * block, F.col("shard_size") * repeats).alias("quota"))
    quotas = settle(quotas, "quotas")

    placed = with_source(sized, ["source_size", "target", "shards"])
    placed = placed.withColumn("_shard", F.col("_fine") % F.col("shards"))
    seeded = Window.partitionBy("source", "_shard").orderBy("_tie", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_end", F.sum("size").over(seeded)).withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())
    full = placed.join(quotas.withColumnRenamed("shard", "_shard"), ["_s", "_none", "_shard"], "left")
    rounds = F.floor(F.col("quota") / F.col("shard_size")).cast("long")
    rest = F.col("quota") - rounds * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    taken = F.when(F.col("size") > 0, rounds * F.col("size") + part).otherwise(F.lit(0))
    return full.select("_row.*", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))
