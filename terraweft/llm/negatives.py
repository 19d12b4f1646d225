"""Hard negatives by inner product, with coordinate pruning in buckets of like length.

Vectors are whole numbers: each component x is floor(256 x). A bounded sample of lengths (SAMPLE rows) cuts the vectors into
at most BUCKETS buckets of like length; a bucket is kept apart by a hash of the label (GROUPS) and dealt to shards of about
SHARD rows. A shard lists its directions (vectors over their lengths) sorted by each coordinate. An anchor asks for scores
within [low, high]. For a bucket that is a range of cosines, and for each of the anchor's FOCUS largest coordinates the
values that a direction within that range of angles can have: an interval of the sorted list. Only rows that lie in all of
the anchor's intervals (and are long enough) are verified, by the exact product; where the intervals rule out little, the
rows that are long enough are verified at once.

Positives are an anchor's first rows of its own label, from the shards of that label's hash. A positive's score gives the
range that its negatives must lie in. What `low` starts from is the score of the k-th best of the bounded sample in range,
which no worse row can displace; buckets whose length can't reach it are not visited. Anchors stand in blocks of BLOCK, and
a shard is sent to as many blocks as its visitors fill; of a shard only the first k in each range of an anchor are returned.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors of
different lengths are never compared; a zero vector scores 0 with all; rows with the anchor's own vec_id are no candidates
of it; of anchors with one vec_id the smallest label and vector is asked; repeated rows are candidates each; ties go to the
smaller vec_id. Scores are exact (64-bit, or Python's integers where vectors are too long for that; those are returned as
the nearest long). An anchor without positives, and a positive without negatives, give no rows; an empty table gives none.
Columns other than the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.llm.common import bounded_sample
from terraweft.session import settle

SAMPLE, BUCKETS, GROUPS, SHARD, BLOCK, FOCUS = 2048, 32, 16, 8192, 512, 4
#: Intervals are used where they leave less than this share of a shard's rows.
WORTH = 0.25
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: What rounding may add to a cosine, an angle or a length, relative.
_SLACK = 1e-7


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (array<double> of whole numbers) and dim of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    # Scaling by a power of two and floor are exact in double precision; floor(double) itself would be a long and overflow.
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    v = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).withColumn("dim", F.size("v"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.empty((0, 0))


def exact(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Whole inner products: in doubles while they hold all sums, else in 64 bits or Python's integers."""
    if not queries.size or not points.size:
        return np.zeros((len(queries), len(points)), np.int64)
    bound = np.sqrt((queries**2).sum(1).max()) * np.sqrt((points**2).sum(1).max())
    if bound < 2.0**52:
        return np.rint(queries @ points.T).astype(np.int64)
    if bound < 2.0**61 and max(np.abs(queries).max(), np.abs(points).max()) < 2.0**62:
        return queries.astype(np.int64) @ points.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (queries, points)]
    return whole[0] @ whole[1].T


class Shard:
    """Vectors of like length, the longest first, with sorted lists of their directions' coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> None:
        length = np.sqrt((points**2).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.labels, self.points, self.length = ids[order], labels[order], points[order], length[order]
        directions = self.points / np.where(self.length > 0, self.length, 1.0)[:, None]
        self.order = np.argsort(directions, axis=0, kind="stable")
        self.sorted = np.take_along_axis(directions, self.order, 0)

    def feasible(self, q: np.ndarray, low: float, high: float) -> np.ndarray:
        """Rows whose score with q can lie in [low, high]: all that do are among them."""
        size = float(np.sqrt((q**2).sum()))
        if size == 0:
            return np.arange(len(self.ids)) if low <= 0 <= high else np.empty(0, np.int64)
        # Rows stand by length; a positive score needs a length of low / |q| at least.
        many = int(np.searchsorted(-self.length, -(low / size) * (1 - _SLACK), "right")) if low > 0 else len(self.ids)
        if not many:
            return np.empty(0, np.int64)
        longest, shortest = self.length[0], self.length[-1]
        least = low / (size * (longest if low > 0 else shortest)) if (longest if low > 0 else shortest) > 0 else -1.0
        most = high / (size * (shortest if high > 0 else longest)) if (shortest if high > 0 else longest) > 0 else 1.0
        if shortest == 0:  # zero vectors score 0 at any angle
            least, most = -1.0, 1.0
        if least > 1 + _SLACK or most < -1 - _SLACK:
            return np.empty(0, np.int64)
        # Angles that the range of cosines allows, the narrow end first.
        near, far = (float(np.arccos(min(1.0, max(-1.0, c)))) for c in (most + _SLACK, least - _SLACK))
        unit = q / size
        spans = []
        for axis in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = float(np.arccos(min(1.0, max(-1.0, unit[axis]))))
            top = 1.0 if near <= own <= far else np.cos(min(abs(own - near), abs(own - far)))
            bottom = -1.0 if near + own <= np.pi <= far + own else np.cos(far + own) if far + own < np.pi else np.cos(near + own)
            column = self.sorted[:, axis]
            spans.append((axis, int(np.searchsorted(column, bottom - _SLACK, "left")), int(np.searchsorted(column, top + _SLACK, "right"))))
        if min(last - first for _, first, last in spans) >= WORTH * len(self.ids):
            return np.arange(many)
        spans.sort(key=lambda s: s[2] - s[1])
        axis, first, last = spans[0]
        left = np.zeros(len(self.ids), bool)
        left[self.order[first:last, axis]] = True
        for axis, first, last in spans[1:]:
            other = np.zeros(len(self.ids), bool)
            other[self.order[first:last, axis]] = True
            left &= other
        left[many:] = False
        return np.flatnonzero(left)

    def search(self, own: int, label: int, q: np.ndarray, ranges: list[tuple[int, int]], k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores and ids of the first k rows in each range, of the anchor's label or of others."""
        rows = self.feasible(q, float(min(r[0] for r in ranges)), float(max(r[1] for r in ranges)))
        rows = rows[(self.ids[rows] != own) & ((self.labels[rows] == label) == same)]
        score = exact(q[None], self.points[rows])[0] if len(rows) else np.empty(0, np.int64)
        out = []
        for low, high in ranges:
            some = np.flatnonzero((score >= low) & (score <= high))
            out.append(first_k(score[some], self.ids[rows[some]], k))
        return out


def first_k(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids; ties to the smaller id."""
    if len(score) > 4 * k and score.dtype != object:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = score >= edge
        score, ids = score[some], ids[some]
    order = sorted(range(len(score)), key=lambda i: (-int(score[i]), int(ids[i])))[:k]
    return score[order], ids[order]


class _Reach:
    """What an anchor needs to know before it visits: buckets with their lengths, and the sample."""

    def __init__(self, known: dict[int, list], sample: pd.DataFrame, k: int, same: bool) -> None:
        self.known, self.k, self.same = known, k, same
        self.sample = {int(d): Shard(s.vec_id.to_numpy(np.int64), s.label.to_numpy(np.int64), _matrix(s.v)) for d, s in sample.groupby("dim")} if len(sample) else {}

    def visits(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each bucket that can hold what an anchor (vec_id, label, v, dim, mine, lows, highs) asks for."""
        for b in batches:
            out = []
            for r in b.itertuples():
                q = np.asarray(r.v, np.float64)
                lows = [int(x) for x in r.lows]
                highs = [int(x) for x in r.highs]
                if r.dim in self.sample:
                    found = self.sample[r.dim].search(r.vec_id, r.label, q, list(zip(lows, highs, strict=True)), self.k, self.same)
                    lows = [max(low, min(_MOST, int(s[-1]))) if len(s) == self.k else low for low, (s, _) in zip(lows, found, strict=True)]
                size = float(np.sqrt((q**2).sum()))
                for group, bucket, longest, shards in self.known.get(r.dim, []):
                    if (not self.same or group == r.mine) and size * longest * (1 + _SLACK) >= min(lows):
                        out += [(r.vec_id, r.label, r.v, r.dim, lows, highs, group, bucket, part) for part in range(int(shards))]
            yield pd.DataFrame(out, columns=["vec_id", "label", "v", "dim", "lows", "highs", "group", "bucket", "part"])


ASKED = "vec_id long, label long, v array<double>, dim int, lows array<long>, highs array<long>"


def _searched(shards: DataFrame, known: dict[int, list], sample: pd.DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """vec_id (anchor), place (number of its range, from 0), id, score: the first k of each shard in each range."""
    asked = asked.withColumn("mine", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    visits = settle(asked.mapInPandas(_Reach(known, sample, k, same).visits, ASKED + ", group int, bucket int, part int"), "visits")
    at = ["dim", "group", "bucket", "part"]
    many = settle(visits.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "many")
    left = shards.join(many, at).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*at, "block", "vec_id", "label", "v")
    right = visits.join(many, at).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).select(*at, "block", "vec_id", "label", "v", "lows", "highs")

    def search(points: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(points) and len(anchors):
            shard = Shard(points.vec_id.to_numpy(np.int64), points.label.to_numpy(np.int64), _matrix(points.v))
            for a in anchors.itertuples():
                ranges = [(int(x), int(y)) for x, y in zip(a.lows, a.highs, strict=True)]
                for place, (score, ids) in enumerate(shard.search(a.vec_id, a.label, np.asarray(a.v, np.float64), ranges, k, same)):
                    rows += [(a.vec_id, place, int(i), min(_MOST, max(_LEAST, int(s)))) for i, s in zip(ids, score, strict=True)]
        return pd.DataFrame(rows, columns=["vec_id", "place", "id", "score"])

    keys = [*at, "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "vec_id long, place int, id long, score long")


def hard_negatives(held: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    held and anchors are rows of whole_numbers(). A negative's score is `least` to `most` percent of its positive's.
    """
    held = settle(held, "vectors")
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    sample = bounded_sample(held, "vec_id", SAMPLE, "lengths").withColumn("size", size).toPandas()
    cuts = sorted(set(np.quantile(sample["size"], np.arange(1, BUCKETS) / BUCKETS).tolist())) if len(sample) >= BUCKETS else []
    bucket = F.lit(0)
    for c in cuts:  # at most BUCKETS of them
        bucket = bucket + (F.col("size") >= c).cast("int")
    placed = held.withColumn("size", size).withColumn("bucket", bucket).withColumn("group", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    # Neighbouring buckets of a group are put together while they hold less than a shard.
    known = placed.groupBy("dim", "group", "bucket").agg(F.max("size").alias("longest"), F.count("*").alias("rows")).orderBy("dim", "group", F.desc("bucket")).toPandas()
    merged, buckets = [], {}
    for r in known.itertuples():  # at most BUCKETS * GROUPS rows a vector length
        if merged and merged[-1][:2] == [r.dim, r.group] and merged[-1][4] + r.rows <= SHARD:
            merged[-1][4] += r.rows
        else:
            merged.append([r.dim, r.group, r.bucket, r.longest, r.rows])
        merged_into = merged[-1][2]
        buckets[r.dim, r.group, r.bucket] = merged_into
    table: dict[int, list] = {}
    for dim, group, b, longest, rows in merged:
        table.setdefault(int(dim), []).append((int(group), int(b), float(longest), -(-int(rows) // SHARD)))
    spark = held.sparkSession
    plan = [(int(d), int(g), int(b), int(into), -(-next(m[4] for m in merged if m[:3] == [d, g, into]) // SHARD)) for (d, g, b), into in buckets.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "dim int, group int, bucket int, into int, shards int"))
    shards = placed.join(plan, ["dim", "group", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"))
    shards = shards.select("dim", "group", F.col("into").alias("bucket"), "part", "vec_id", "label", "v")

    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("a")).select("vec_id", "a.*")
    one = settle(one, "anchors")
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    asked = one.withColumn("lows", F.array(F.lit(_LEAST))).withColumn("highs", F.array(F.lit(_MOST)))
    found = _searched(shards, table, sample, asked, positives, True)
    first = found.withColumn("nth", F.row_number().over(best("vec_id"))).where(F.col("nth") <= positives).select("vec_id", "nth", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = settle(first, "positives")
    # least * positive <= 100 * negative <= most * positive, in whole numbers; decimals hold the products.
    wide = lambda n: F.lit(n).cast("decimal(10,0)") * F.col("positive_score").cast("decimal(19,0)")
    low, high = F.ceil(wide(least) / 100).cast("long"), F.floor(wide(most) / 100).cast("long")
    ranges = first.withColumn("low", low).withColumn("high", high).where("low <= high").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("nth", "low", "high"))).alias("r"))
    asked = one.join(ranges, "vec_id").select("vec_id", "label", "v", "dim", F.col("r.low").alias("lows"), F.col("r.high").alias("highs"), F.col("r.nth").alias("nths"))
    asked = settle(asked, "ranges")
    found = _searched(shards, table, sample, asked.drop("nths"), negatives, False)
    ranked = found.withColumn("rank", F.row_number().over(best("vec_id", "place"))).where(F.col("rank") <= negatives)
    named = ranked.join(asked.select("vec_id", F.posexplode("nths").alias("place", "nth")), ["vec_id", "place"]).join(first, ["vec_id", "nth"])
    return named.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
