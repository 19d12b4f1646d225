"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

A bounded sample of the vectors (PIVOTS rows at most) divides space into cells: a vector belongs to the cell of its nearest
pivot, and a cell knows the smallest and largest distance of its vectors to the pivot. A cell of more than SHARD vectors is
dealt to several shards. A shard's tree splits its vectors by their distance to a vantage point, down to leaves.

A query first searches one shard of its own cell. Its k-th distance there, by the triangle inequality, rules out cells, and
within the other cells' trees the sides that can't hold a nearer vector. With factor f a cell or side is skipped where f
times the least distance that it can have is more than the best so far: f = 1 is exact, a larger f skips more. Distances are
Euclidean, in double precision, of the original vectors; what rules a vector out allows for the rounding error of its
magnitude, so that vectors far from the origin and of very different lengths are treated alike.

A shard's vectors are sent to as many tasks as its own queries need (BLOCK each). Of each pair only the nearest k of a query
leave a task. Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null vec_id, take no part; vectors of different lengths are never compared; ties go to the smaller vec_id; a row's own
vec_id is no candidate of it; repeated vectors are all candidates, of queries with one vec_id one is asked; an empty table
gives an empty result. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.llm.common import bounded_sample
from terraweft.session import settle

#: Vectors of a shard, queries of a task, vectors of a leaf, and pivots at most.
SHARD, BLOCK, LEAF, PIVOTS = 16_384, 4096, 128, 1024
_NONE = np.iinfo(np.int64).max


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _rounding(dim: int) -> float:
    """A bound of the relative rounding error of a sum of `dim` squares, with room to spare."""
    return 8 * (dim + 8) * float(np.finfo(np.float64).eps)


class Tree:
    """A vantage-point tree over points (float64, one row each) with ids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int | None = None) -> None:
        leaf = leaf or LEAF
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.nodes: list[tuple] = []  # (vantage point, border, inner, outer) or (None, first, last, None)
        self.order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            first, last, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            part = self.order[first:last]
            if last - first > leaf:
                # The farthest point from the first one: a border far from most of the points.
                vantage = self.points[part[np.argmax(self._far(self.points[part[0]], part))]]
                d = self._far(vantage, part)
                by = np.argsort(d, kind="stable")
                middle = (last - first) // 2
                border = d[by[middle]]
                inside = int(np.searchsorted(d[by], border, "left"))
                if 0 < inside < last - first:
                    self.order[first:last] = part[by]
                    self.nodes.append([vantage, float(border), None, None])
                    todo += [(first, first + inside, at, 0), (first + inside, last, at, 1)]
                    continue
            self.nodes.append([None, first, last, None])
        self.points, self.ids = self.points[self.order], self.ids[self.order]
        del self.order
        self.middle = self.points.mean(0)
        self.centred = self.points - self.middle
        self.squares = (self.centred**2).sum(1)

    def _far(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[part] - x) ** 2).sum(1))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids (k columns, nearest first) of each query; inf and the largest id where there are fewer.

        What is farther than bound (one distance a query) may be left out.
        """
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), _NONE, np.int64)
        limit = np.full(len(queries), np.inf) if bound is None else bound.astype(np.float64)
        centred = queries - self.middle
        squares = (centred**2).sum(1)
        error = _rounding(queries.shape[1])

        def leaf(first: int, last: int, q: np.ndarray) -> None:
            # A rough distance by one matrix product rules out what its own error leaves no doubt about; the rest get the exact one.
            magnitude = squares[q, None] + self.squares[None, first:last]
            near = magnitude * (1 - error) - 2 * (centred[q] @ self.centred[first:last].T)
            row, column = np.nonzero(~(near > (limit[q] ** 2 * (1 + error))[:, None]) & (self.ids[None, first:last] != own[q, None]))
            if not len(row):
                return
            exact = np.sqrt(((queries[q[row]] - self.points[first + column]) ** 2).sum(1))
            rows, start, count = np.unique(row, return_index=True, return_counts=True)
            wide = np.full((len(rows), k + count.max()), np.inf)
            whom = np.full(wide.shape, _NONE, np.int64)
            wide[:, :k], whom[:, :k] = best[q[rows]], who[q[rows]]
            at = np.repeat(np.arange(len(rows)), count), k + np.arange(len(row)) - np.repeat(start, count)
            wide[at], whom[at] = exact, self.ids[first + column]
            order = np.lexsort((whom, wide), axis=-1)[:, :k]
            best[q[rows]], who[q[rows]] = np.take_along_axis(wide, order, 1), np.take_along_axis(whom, order, 1)
            limit[q[rows]] = np.minimum(limit[q[rows]], best[q[rows], -1])

        stack: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        with np.errstate(all="ignore"):  # sums that overflow rule nothing out
            while stack:
                node, q, gap = stack.pop()
                q = q[~(factor * gap > limit[q])]
                if not len(q):
                    continue
                vantage, border, inner, outer = self.nodes[node]
                if vantage is None:
                    for lo in range(0, len(q), 256):
                        leaf(border, inner, q[lo : lo + 256])
                    continue
                d = np.sqrt(((queries[q] - vantage) ** 2).sum(1))
                inside = d < border
                gap = np.abs(d - border) - error * (d + border)
                nothing = np.zeros(len(q))
                # The far sides wait below the near ones on the stack.
                stack.append((outer, q[inside], gap[inside]))
                stack.append((inner, q[~inside], gap[~inside]))
                stack.append((outer, q[~inside], nothing[~inside]))
                stack.append((inner, q[inside], nothing[inside]))
        return best, who


def _points(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


class Cells:
    """Pivots of each vector length (at most PIVOTS in all), with what is known of their cells."""

    def __init__(self, pivots: dict[int, np.ndarray]) -> None:
        self.pivots = pivots
        self.known: dict[int, np.ndarray] = {}  # by length: cell, least and largest distance, shards

    def distances(self, points: np.ndarray) -> np.ndarray:
        pivots = self.pivots.get(points.shape[1], np.empty((0, points.shape[1])))
        out = np.empty((len(points), len(pivots)))
        for k, p in enumerate(pivots):
            out[:, k] = np.sqrt(((points - p) ** 2).sum(1))
        return out

    def assigned(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """vec_id, embedding, dim with the cell (-1 where a length has no pivot) and the distance to its pivot."""
        for b in batches:
            cell, far = np.full(len(b), -1), np.zeros(len(b))
            for dim in b.dim.unique():
                some = np.flatnonzero(b.dim == dim)
                for lo in range(0, len(some), 2048):
                    part = some[lo : lo + 2048]
                    with np.errstate(all="ignore"):
                        d = self.distances(_points(b.embedding.iloc[part]))
                    if d.shape[1]:
                        cell[part] = d.argmin(1)
                        far[part] = d.min(1)
            yield b.assign(cell=cell, far=far)

    def visits(self, factor: float, first: bool):
        """Of each query (vec_id, embedding, dim, bound) the shards to search: one of its own cell first, then the rest."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for dim in b.dim.unique():
                    cells = self.known.get(int(dim))
                    if cells is None:
                        continue
                    some = b[b.dim == dim]
                    ids, least, most, shards = cells[:, 0].astype(np.int64), cells[:, 1], cells[:, 2], cells[:, 3].astype(np.int64)
                    for lo in range(0, len(some), 512):
                        part = some.iloc[lo : lo + 512]
                        with np.errstate(all="ignore"):
                            d = self.distances(_points(part.embedding))
                            d = d[:, ids] if ids[0] >= 0 else np.zeros((len(part), 1))
                            home = d.argmin(1)
                            own = part.vec_id.to_numpy(np.int64) % shards[home]
                            if first:
                                who, where, at = np.arange(len(part)), home, own
                            else:
                                gap = np.maximum(d - most, least - d) - _rounding(int(dim)) * (d + most)
                                who, where = np.nonzero(~(factor * gap > part.bound.to_numpy()[:, None]))
                                many = shards[where]
                                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                                who, where = np.repeat(who, many), np.repeat(where, many)
                                rest = (where != home[who]) | (at != own[who])
                                who, where, at = who[rest], where[rest], at[rest]
                        yield part.iloc[who].assign(cell=ids[where], part=at)

        return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query; both inputs have vec_id and embedding."""
    held, asked = (
        x.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))
        for x in (vectors, queries)
    )
    asked = asked.dropDuplicates(["vec_id"])
    pivots: dict[int, list] = {}
    for r in bounded_sample(held, "vec_id", min(PIVOTS, -(-held.count() // SHARD)), "pivots").collect():
        pivots.setdefault(r.dim, []).append(r.embedding)
    cells = Cells({dim: np.array(p, np.float64) for dim, p in pivots.items()})
    held = held.mapInPandas(cells.assigned, "vec_id long, embedding array<double>, dim int, cell int, far double")
    held = settle(held, "vectors")
    known = held.groupBy("dim", "cell").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.ceil(F.count("*") / SHARD).alias("shards"))
    for r in known.orderBy("dim", "cell").toLocalIterator():  # a row for each pivot and vector length
        cells.known[r.dim] = np.vstack([cells.known.get(r.dim, np.empty((0, 4))), [r.cell, r.least, r.most, r.shards]])
    shards = held.join(known.select("dim", "cell", "shards"), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), "shards").cast("int"))

    def search(vectors: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = block.vec_id.to_numpy(np.int64)
        tree = Tree(vectors.vec_id.to_numpy(np.int64), _points(vectors.embedding))
        best, who = tree.search(own, _points(block.embedding), k, factor, block.bound.to_numpy())
        some = who != _NONE
        return pd.DataFrame({"query_id": np.repeat(own, some.sum(1)), "vec_id": who[some], "score": best[some]})

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        visits = asked.mapInPandas(cells.visits(factor, first), "vec_id long, embedding array<double>, dim int, bound double, cell int, part int")
        visits = settle(visits, "visits")
        at, keys = ["dim", "cell", "part"], ["dim", "cell", "part", "block"]
        many = settle(visits.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "many")
        left = shards.select(*at, "vec_id", "embedding").join(many, at).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        dealt = many.select(*at, F.col("blocks").alias("over"))
        right = visits.join(dealt, at).withColumn("block", F.pmod(F.xxhash64("vec_id"), "over")).drop("over")
        left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))
        return settle(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double"), "found")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = settle(asked.withColumn("bound", F.lit(float("inf"))), "asked")
    near = searched(asked, True)
    bounds = near.groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("found")).where(F.col("found") == k)
    asked = asked.join(bounds.select(F.col("query_id").alias("vec_id"), "far"), "vec_id", "left").select("vec_id", "embedding", "dim", F.coalesce("far", "bound").alias("bound"))
    return ranked(near.unionByName(searched(asked, False))).select("query_id", "rank", "vec_id", "score")
