"""Connected components over an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.session import discard, settle

SALTS = 8


def salted_lookup(big: DataFrame, small: DataFrame, key: str, spread: Column, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """big joined with small (one row a key); the rows of a hot key are dealt over `salts` partitions.

    Both sides are shuffled: Spark would size small before it is repeated for each salt, and so could broadcast too much.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the component's smallest node.

    edges has two long columns, src and dst. Each round links every node's larger neighbours, then its smaller ones, to
    its smallest neighbour (large-star, small-star); hubs are salted. Rounds follow the logarithm of the longest path.
    An empty edge table gives an empty result; loops and repeated edges are ignored, as are rows with a null end.
    """
    held = settle(
        edges.select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v"))
        .where("src is not null and dst is not null and u <> v").distinct(),
        "edges",
    )
    before: tuple = ()
    for _ in range(max_rounds):
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least_neighbour(both).select("u", F.least("u", "low").alias("low"))
        large = salted_lookup(both.where("v > u"), low, "u", F.col("v")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        small = salted_lookup(large, _least_neighbour(large), "u", F.col("v"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
        after = settle(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(held)
        held = after
        if tuple(seen) == before:
            break
        before = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
