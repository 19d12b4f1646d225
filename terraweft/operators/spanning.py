"""Maximum spanning forest and what is composed along it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.operators.graph import connected_components
from terraweft.session import discard, settle


def spanning_forest(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """src, dst, score of a maximum spanning forest (Boruvka): each round every part takes its best edge outward.

    Ties are ordered by (src, dst), so that the forest is unique. Parts at least halve in each round.
    """
    return forest_and_parts(edges, max_rounds)[0]


def forest_and_parts(edges: DataFrame, max_rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """The forest, and its parts (node, component: the part's smallest node).

    After each round parts are contracted to one node and only the best edge between two of them is kept, so that rounds
    shrink with the parts.
    """
    ends = edges.select("src", "dst", "score").where("src <> dst").distinct()
    held = settle(ends.select("*", F.col("src").alias("a"), F.col("dst").alias("b")), "graph")
    part = settle(held.select(F.col("src").alias("node")).union(held.select("dst")).distinct().withColumn("component", F.col("node")), "parts")
    taken = held.select("src", "dst", "score").limit(0)
    first = F.max(F.struct("score", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d")))
    edge = ((-F.col("e.s")).alias("src"), (-F.col("e.d")).alias("dst"), F.col("e.score").alias("score"))
    for _ in range(max_rounds):
        both = held.select(F.col("a").alias("part"), F.col("b").alias("up"), "score", "src", "dst").union(held.select("b", "a", "score", "src", "dst"))
        best = F.max(F.struct("score", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d"), "up")).alias("e")
        chosen = settle(both.groupBy("part").agg(best).select("part", "e.up", *edge), "chosen")
        if not chosen.take(1):
            discard(held)
            return taken, part
        taken = taken.unionByName(chosen.select("src", "dst", "score").distinct())
        label = settle(_contracted(chosen.select("part", "up")), "labels")
        a, b = label.select(F.col("part").alias("a"), F.col("label").alias("x")), label.select(F.col("part").alias("b"), F.col("label").alias("y"))
        across = held.join(a, "a").join(b, "b").where("x <> y")
        after = across.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(first.alias("e")).select(*edge, "a", "b")
        after = settle(after, "graph")
        part = settle(part.join(label.withColumnRenamed("part", "component"), "component", "left").select("node", F.coalesce("label", "component").alias("component")), "parts")
        discard(held)
        held = after
    raise RuntimeError("the forest did not settle")


def _contracted(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """part, label (the smallest of those that are joined) from the part that each one's best edge leads to.

    Best edges form trees whose two topmost parts lead to each other; of these the smaller is the root, and the way to it
    halves in each round.
    """
    back = links.select(F.col("part").alias("up"), F.col("up").alias("_back"))
    up = settle(links.join(back, "up").select("part", F.when((F.col("_back") == F.col("part")) & (F.col("part") < F.col("up")), F.col("part")).otherwise(F.col("up")).alias("up")), "up")
    for _ in range(max_rounds):
        top = up.select(F.col("part").alias("up"), F.col("up").alias("top"))
        after = settle(up.join(top, "up").select("part", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
        moved = after.where("moved").take(1)
        discard(up)
        up = after.select("part", "up")
        if not moved:
            return up.join(up.groupBy("up").agg(F.min("part").alias("label")), "up").select("part", "label")
    raise RuntimeError("the parts did not settle")


def contracted_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, component (its smallest node) of every node with an edge, for graphs of many more edges than nodes.

    Each round joins every part with its smallest neighbour; parts become one node, and only one edge between two of them is
    kept. Parts at least halve in each round (the best edges' topmost parts lead to each other: of parts that lead in a
    circle the smallest is what its successor leads to), and edges shrink with them. Loops and null ends are ignored.
    """
    held = settle(edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).distinct(), "graph")
    part = None
    for _ in range(max_rounds):
        both = held.union(held.select("b", "a"))
        label = settle(_contracted(settle(both.groupBy(F.col("a").alias("part")).agg(F.min("b").alias("up")), "chosen")), "labels")
        after = part.join(label.withColumnRenamed("part", "component"), "component", "left").select("node", F.coalesce("label", "component").alias("component")) if part else label.toDF("node", "component")
        part = settle(after, "parts")
        a, b = label.toDF("a", "x"), label.toDF("b", "y")
        across = held.join(a, "a").join(b, "b").where("x <> y")
        after = settle(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "graph")
        discard(held)
        held = after
        if not held.take(1):
            return part
    raise RuntimeError("the parts did not settle")


def largest_component(edges: DataFrame) -> DataFrame:
    """node of the component with the most nodes (ties: the smaller one)."""
    parts = connected_components(edges)
    best = parts.groupBy("component").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("component"))
    return parts.join(F.broadcast(best), "component", "left_semi").select("node")


def depths(edges: DataFrame, root: int, max_rounds: int = 10_000) -> DataFrame:
    """node, depth and parent along a forest from a root: breadth-first, one join a level."""
    both = settle(edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")).union(edges.select("dst", "src")), "tree")
    found = front = settle(both.sparkSession.createDataFrame([(root, 0, None)], "node long, depth int, parent long"), "front")
    for level in range(1, max_rounds):
        nxt = both.join(front.select(F.col("node").alias("parent")), "parent").select("node", F.lit(level).alias("depth"), "parent")
        front = settle(nxt.join(found.select("node"), "node", "left_anti").groupBy("node", "depth").agg(F.min("parent").alias("parent")), "front")
        if not front.take(1):
            return found
        found = found.unionByName(front)
    raise RuntimeError("the tree is too deep")
