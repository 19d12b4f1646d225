"""N-gram Jaccard join by vertical partitioning, and the components of its links.

The hash order of shingles is the global order. It is cut into fragments; each document's set falls into one segment a
fragment. Two steps count within fragments and sum what they counted:

1. Probe. A member of a link shares all but a fifth of its shingles with one other set. In the first PROBE_SHARE of the
   fragments the shingles that no other set holds are counted and summed per set; a set with more of them than a fifth
   of its whole size has no link. Copies of one set count as one. Each task first combines what it has read, so that a
   shingle of very many documents reaches its fragment once for each chunk, not once for each document.
2. Overlap. The sets that remain meet where they share one of their rarest shingles (prefix filter). Sets that meet form
   blocks of bounded size: a small group is one block; in a large one a set belongs to the largest of its meeting places
   and only blocks with a meeting place in common are compared. Segments are shuffled by block pair and fragment, the
   partial overlaps of a fragment are counted alone, and a second shuffle sums them per pair. A large group thus becomes
   many keys of bounded size. Only a spanning forest of a block pair's links and the number of links of each set leave
   the sum, never all pairs.

Defined results: null and empty texts have an empty set and no links; texts with fewer words than a shingle form one;
rows with equal sets are linked; rows that share a doc_id are one document; rows with a null doc_id are in the
component of their copies, which is null if none of them has an id; n_links counts the other rows that a row's set is
linked with, copies included. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terraweft.llm.common import salted_lookup, shingles
from terraweft.operators.graph import connected_components
from terraweft.session import discard, release, settle, shuffle_width, split_join

#: Share of the hash order that the probe reads.
PROBE_SHARE = 0.4
#: Shingles that a task holds at once in the probe, and about as many a fragment.
CHUNK = 1_000_000
FRAGMENT = 1_000_000
#: Sets and shingles in a block of the overlap step, and the fragments that count its overlaps.
BLOCK_SETS, BLOCK_SHINGLES, OVERLAP_FRAGMENTS = 256, 1_000_000, 4
SLICE = 4096


def _slack(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many of n shingles a linked set can lack: n - ceil(n * percent / 100)."""
    return n - (n * percent + 99) // 100


_PROBE = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("chunk", pa.int64()), ("toks", pa.binary()), ("owners", pa.binary())])
_PROBE_DDL = "kind int, doc_id long, n long, key binary, chunk long, toks binary, owners binary"


def _probe_rows(size: int, fragments: int, probed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of kind -1 (a document: doc_id, n, its set's digest as key), -2 (a chunk: the digests of its sets as key) and 0 up
    (a chunk's part of a fragment: shingles of one of its sets each, set by set, owners telling how many of which set,
    and as key the shingles that several of its sets hold)."""
    step = -(-(1 << 64) // fragments)
    end = np.uint64(min(probed * step, (1 << 64) - 1))

    def counted(chunk: list[tuple[bytes, np.ndarray]], number: int) -> Iterator[tuple]:
        yield -2, None, None, b"".join(c for c, _ in chunk), number, None, None
        every = np.concatenate([t for _, t in chunk])
        owner = np.repeat(np.arange(len(chunk), dtype=np.int32), [len(t) for _, t in chunk])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.append(True, every[1:] != every[:-1]) if len(every) else np.empty(0, bool)
        single = first & np.append(first[1:], True) if len(every) else first
        lone, lone_of, many = every[single], owner[single], every[first & ~single]
        # Only fragments that the chunk has shingles of are visited.
        part_lone, part_many = lone // np.uint64(step), many // np.uint64(step)
        for f in np.union1d(part_lone, part_many).tolist():
            lo, hi = np.searchsorted(part_lone, np.array([f, f + 1], np.uint64))
            c, d = np.searchsorted(part_many, np.array([f, f + 1], np.uint64))
            by = np.argsort(lone_of[lo:hi], kind="stable")
            whose, count = np.unique(lone_of[lo:hi], return_counts=True)
            yield f, None, None, many[c:d].tobytes(), number, lone[lo:hi][by].tobytes(), np.stack([whose, count.astype(np.int32)]).tobytes()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in _PROBE]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PROBE, strict=True)], schema=_PROBE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        chunk: list = []
        held, number = 0, TaskContext.get().partitionId() << 32
        for b in batches:
            out: list = []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                s = shingles(text.as_py(), size)
                cls = xxhash.xxh3_128_digest(s.tobytes())
                out.append((-1, doc_id.as_py(), len(s), cls, None, None, None))
                if len(s) and cls not in seen:
                    seen.add(cls)
                    chunk.append((cls, s[: np.searchsorted(s, end)].copy()))
                    held += len(chunk[-1][1])
                    if held >= CHUNK:
                        for row in counted(chunk, number):
                            yield batch([row])
                        chunk, held, number = [], 0, number + 1
            yield batch(out)
        if chunk:
            for row in counted(chunk, number):
                yield batch([row])

    return run


def _unshared(group: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment: for each chunk, how many shingles of which of its sets no other set holds."""
    parts = [np.frombuffer(t, np.uint64) for t in group.toks]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.empty(0, bool)
    alone = first & np.append(first[1:], True) if len(ranked) else first
    known = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in group.key]))
    if len(known) and len(ranked):
        alone &= known[np.minimum(np.searchsorted(known, ranked), len(known) - 1)] != ranked
    single = np.empty(len(every), bool)
    single[order] = alone
    counts, owners, at = [], [], 0
    for t, o in zip(parts, group.owners, strict=True):
        whose, many = np.frombuffer(o, np.int32).reshape(2, -1)
        ends = np.cumsum(many)
        total = np.append(0, np.cumsum(single[at : at + len(t)]))
        at += len(t)
        counts.append((total[ends] - total[ends - many]).astype(np.int32).tobytes())
        owners.append(whose.tobytes())
    return pd.DataFrame({"chunk": group.chunk.to_numpy(), "owners": owners, "counts": counts})


def _summed(listing: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Of one chunk: its sets' digests with the sums of what the fragments have counted."""
    if not len(listing):
        return pd.DataFrame({"cls": [], "unshared": []})
    key = listing.key.iloc[0]
    total = np.zeros(len(key) // 16, np.int64)
    for o, c in zip(found.owners, found.counts, strict=True):
        total[np.frombuffer(o, np.int32)] += np.frombuffer(c, np.int32)
    return pd.DataFrame({"cls": [key[16 * i : 16 * i + 16] for i in range(len(total))], "unshared": total})


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each array of left shares with each of right; the values of one array are distinct."""
    many, wide = len(left), len(right)
    a, b = (np.concatenate([*x, np.empty(0, np.uint64)]) for x in (left, right))
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    if not len(both):
        return np.zeros((many, wide), np.int32)
    at_a, at_b = (np.minimum(np.searchsorted(both, x), len(both) - 1) for x in (a, b))
    in_a, in_b = both[at_a] == a, both[at_b] == b
    at_a, of_a, at_b, of_b = at_a[in_a], of_a[in_a], at_b[in_b], of_b[in_b]
    by = np.argsort(at_b, kind="stable")
    at_b, of_b = at_b[by], of_b[by]
    held = np.bincount(at_b, minlength=len(both))
    times = held[at_a]
    pairs = int(times.sum())
    if pairs * 10 <= many * wide * len(both) * 0.05 + (many + wide) * len(both):  # few: pair by pair
        first = np.repeat((np.cumsum(held) - held)[at_a] - (np.cumsum(times) - times), times)
        cell = np.repeat(of_a, times) * wide + of_b[first + np.arange(pairs)]
        return np.bincount(cell, minlength=many * wide).reshape(many, wide).astype(np.int32)
    by = np.argsort(at_a, kind="stable")
    at_a, of_a = at_a[by], of_a[by]
    total = np.zeros((many, wide), np.float64)
    cuts = np.arange(0, len(both) + SLICE, SLICE)
    for (lo, hi), (lo_b, hi_b), base in zip(*(zip(c[:-1], c[1:], strict=True) for c in (np.searchsorted(at_a, cuts), np.searchsorted(at_b, cuts))), cuts[:-1], strict=True):
        x, y = np.zeros((many, SLICE), np.float32), np.zeros((wide, SLICE), np.float32)
        x[of_a[lo:hi], at_a[lo:hi] - base] = 1
        y[of_b[lo_b:hi_b], at_b[lo_b:hi_b] - base] = 1
        total += x @ y.T
    return total.astype(np.int32)


def forest(left: np.ndarray, right: np.ndarray, size: int) -> list[int]:
    """Which of the links (left[k], right[k]) form a spanning forest."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


def _grouped(batches: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[list]:
    """The rows of each key; rows arrive sorted by it."""
    rows: list = []
    held = None
    for b in batches:
        for r in b.itertuples(index=False):
            key = tuple(getattr(r, k) for k in keys)
            if rows and key != held:
                yield rows
                rows = []
            held = key
            rows.append(r)
    if rows:
        yield rows


_PARTIAL = "b1 long, b2 long, fragment int, lefts int, cls binary, nodes binary, sizes binary, copies binary, counts binary"


def _partial_overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a block pair and a fragment: overlaps of the segments; the first fragment also says whose they are."""
    for rows in _grouped(batches, ("b1", "b2", "fragment")):
        segments = [np.asarray(r.toks, np.int64).view(np.uint64) for r in rows]
        lefts = sum(1 for r in rows if not r.side)
        counts = overlaps(segments[:lefts], segments[lefts:] if rows[0].b1 != rows[0].b2 else segments)
        listed = [None] * 4
        if rows[0].fragment == 0:
            listed = [b"".join(bytes(r.cls) for r in rows), *(np.array([getattr(r, c) for r in rows], np.int64).tobytes() for c in ("node", "n", "copies"))]
        yield pd.DataFrame([(rows[0].b1, rows[0].b2, rows[0].fragment, lefts, *listed, counts.tobytes())], columns=[c.split()[0] for c in _PARTIAL.split(", ")])


def _links(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Partial overlaps of a block pair summed per pair: a spanning forest of its links, and each set's number of links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _grouped(batches, ("b1", "b2")):
            r, lefts = rows[0], rows[0].lefts
            nodes, sizes, copies = (np.frombuffer(x, np.int64) for x in (r.nodes, r.sizes, r.copies))
            total = np.sum([np.frombuffer(x.counts, np.int32) for x in rows], axis=0, dtype=np.int64).reshape(lefts, -1)
            same = r.b1 == r.b2
            right = np.arange(len(nodes)) if same else np.arange(lefts, len(nodes))
            ok = 100 * total >= percent * (sizes[:lefts, None] + sizes[None, right] - total)
            if same:
                np.fill_diagonal(ok, False)
            a, b = np.nonzero(np.triu(ok) if same else ok)
            kept = forest(a, right[b], len(nodes))
            yield pd.DataFrame({"src": nodes[a[kept]], "dst": nodes[right[b[kept]]]}).assign(cls=None, links=None)
            links = np.zeros(len(nodes), np.int64)
            links[:lefts] = ok @ copies[right]
            if not same:
                links[lefts:] = ok.T @ copies[:lefts]
            some = np.flatnonzero(links)
            yield pd.DataFrame({"src": None, "dst": None, "cls": [bytes(r.cls[16 * k : 16 * k + 16]) for k in some], "links": links[some]})

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text its set, and where its segments of the overlap fragments begin and end."""
    schema = pa.schema([("node", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("toks", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int32()))])
    edges = np.array([k * (1 << 64) // OVERLAP_FRAGMENTS for k in range(1, OVERLAP_FRAGMENTS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                found = [shingles(t.as_py(), size) for t in part.column(1)]
                columns = [part.column(0), [xxhash.xxh3_128_digest(s.tobytes()) for s in found], [len(s) for s in found], [s.view(np.int64) for s in found]]
                columns.append([[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def similar_sets(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each document (see the module's text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    fragments = max(8, -(-chars // (6 * FRAGMENT)))
    probed = max(1, round(PROBE_SHARE * fragments))
    read = settle(docs.mapInArrow(_probe_rows(size, fragments, probed), _PROBE_DDL), "probe")
    stats = settle(read.where("kind = -1").select("doc_id", F.col("key").alias("cls"), "n"), "stats")
    classes = settle(stats.groupBy("cls", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")

    # Probe: sets with few enough shingles that are theirs alone. A set that several tasks have read is judged by any of them:
    # its shingles are then shared, at least by its copies, and the smallest count is taken.
    found = read.where("kind >= 0").groupBy("kind").applyInPandas(_unshared, "chunk long, owners binary, counts binary")
    listing = read.where("kind = -2").select("chunk", "key")
    lone = listing.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(_summed, "cls binary, unshared long")
    lone = lone.groupBy("cls").agg(F.min("unshared").alias("unshared"))
    slack = F.expr(f"n - (n * {percent} + 99) div 100")
    near = classes.where("n > 0 and rep is not null").join(lone, "cls", "left").where(F.coalesce("unshared", F.lit(0)) <= slack)
    near = settle(near.select("cls", F.col("rep").alias("doc_id"), "copies"), "near")
    discard(read)
    texts = docs.join(near.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    found = texts.mapInArrow(_sets(size), "node long, cls binary, n long, toks array<long>, cuts array<int>").where("n > 0")
    sets = settle(found.join(near.select("cls", "copies"), "cls").dropDuplicates(["cls"]), "sets")
    release(spark)

    # Prefix filter: the rarest shingles of a set, of those that another set holds too.
    tokens = sets.select("node", F.hash("cls").alias("part"), "n", F.explode("toks").alias("tok"))
    often = tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    shared = split_join(tokens, often, "tok")
    by_set = Window.partitionBy("node", "part")  # part tells apart the sets of rows that share a doc_id
    shared = shared.withColumn("k", F.row_number().over(by_set.orderBy("df", "tok"))).withColumn("held", F.count("*").over(by_set))
    prefix = shared.where(F.col("k") <= slack + 1 - (F.col("n") - F.col("held")))
    # Sets of one octave of size or the next can be linked; an octave is 1 / percent wide.
    octave = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    postings = prefix.select("node", "n", F.explode(F.array(octave, octave + 1)).alias("octave"), "tok")
    postings = settle(postings.select("node", F.xxhash64("tok", "octave").alias("spot")), "postings")
    release(spark)
    spots = postings.groupBy("spot").agg(F.min("node").alias("src"), F.max("node").alias("top"), F.count("*").alias("size")).where("src <> top")
    met = split_join(postings, spots.select("spot", "src"), "spot").where("node <> src").select("src", F.col("node").alias("dst")).distinct()
    clusters = settle(connected_components(met).select("node", F.col("component").alias("cluster")), "clusters")

    # Overlap: segments by block pair and fragment, partial overlaps, their sums.
    dealt = _dealt(clusters, sets.groupBy("node").agg(F.max("n").alias("n")), postings, spots.select("spot", "size"))
    segments = F.transform(F.sequence(F.lit(0), F.lit(OVERLAP_FRAGMENTS - 1)), lambda f: F.slice("toks", F.get("cuts", f) + 1, F.get("cuts", f + 1) - F.get("cuts", f)))
    pairs = dealt.join(sets.select("node", "n", "cls", "copies", "toks", "cuts"), "node")
    pairs = pairs.select("b1", "b2", "side", "node", "n", "cls", "copies", F.posexplode(segments).alias("fragment", "toks"))
    width = shuffle_width(spark)
    keys = ["b1", "b2", "fragment"]
    partial = pairs.repartition(width, *keys).sortWithinPartitions(*keys, "side", "cls", "node").mapInPandas(_partial_overlaps, _PARTIAL)
    links = partial.repartition(width, "b1", "b2").sortWithinPartitions(*keys).mapInPandas(_links(percent), "src long, dst long, cls binary, links long")
    links = settle(links, "links")
    joined = connected_components(links.where("src is not null").select("src", "dst"))

    counts = links.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    ends = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "cls", "left").where("copies > 1 or links > 0")
    ends = ends.select("cls", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = salted_lookup(stats.where("n > 0"), ends, "cls", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.unionByName(stats.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def _dealt(clusters: DataFrame, sizes: DataFrame, postings: DataFrame, spots: DataFrame) -> DataFrame:
    """node, b1, b2, side: the block pairs in which each set is compared.

    A cluster within a block's bounds is one block. A larger one is cut in two ways, and the one that copies fewer sets is
    taken. By places: a set's home is the meeting place with the most sets of those it has; a home is cut into blocks of
    bounded size, and blocks are compared if a meeting place has sets of both, so that a chain stays local. By hash: all
    blocks are compared, so that n sets which all meet are copied n / BLOCK_SETS times, as counting all their links takes.
    """
    wide = clusters.join(sizes, "node").groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("volume"))
    wide = wide.withColumn("blocks", F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("volume") / BLOCK_SHINGLES)).cast("int"))
    wide = settle(wide.where("blocks > 1").select("cluster", "blocks", (F.col("sets") * F.col("blocks")).alias("copied")), "wide")
    placed = salted_lookup(clusters, wide.select("cluster", "blocks"), "cluster", "node")
    one = placed.where("blocks is null").select("node", F.col("cluster").alias("b1"), F.col("cluster").alias("b2"), F.lit(0).alias("side"))
    if not wide.take(1):
        return one
    inside = placed.where("blocks is not null").select("node", "cluster")
    held = postings.join(inside.select("node").hint("shuffle_hash"), "node", "left_semi")
    held = settle(split_join(held, spots, "spot"), "held")
    homes = held.groupBy("node").agg(F.max(F.struct("size", "spot"))["spot"].alias("home")).join(sizes, "node").join(inside, "node")
    homes = settle(homes, "homes")
    cut = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    homes = settle(salted_lookup(homes, cut, "home", "node").select("node", "cluster", F.xxhash64("home", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), "homes")
    at = settle(held.join(homes, "node").select("spot", "block").distinct(), "at")
    met = at.join(at.withColumnRenamed("block", "b2"), "spot").where("block <= b2").select(F.col("block").alias("b1"), "b2").distinct()
    ends = F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b2").alias("block"), F.lit(1).alias("side")))
    sides = met.select("b1", "b2", F.explode(F.when(F.expr("b1 = b2"), F.slice(ends, 1, 1)).otherwise(ends)).alias("x"))
    sides = settle(sides.select("x.block", "b1", "b2", "x.side"), "sides")
    local = homes.groupBy("cluster", "block").agg(F.count("*").alias("sets")).join(sides, "block").groupBy("cluster").agg(F.sum("sets").alias("local"))
    hashed = settle(wide.join(local, "cluster").where("copied <= local").select("cluster", "blocks"), "hashed")

    by_place = split_join(salted_lookup(homes, hashed, "cluster", "node").where("blocks is null"), sides, "block").select("node", "b1", "b2", "side")
    every = salted_lookup(inside, hashed, "cluster", "node", how="inner").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    every = every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = lambda c: F.xxhash64("cluster", c)
    by_hash = every.select("node", name(F.least("block", "other")).alias("b1"), name(F.greatest("block", "other")).alias("b2"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return one.unionByName(by_place).unionByName(by_hash)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of near duplicates the rows with its smallest doc_id (one of them, where a doc_id repeats).

    Rows with a null doc_id stay unless a copy with an id stays; of copies without an id one stays. Columns are docs'.
    """
    found = similar_sets(docs, size, percent)
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay.hint("shuffle_hash"), "doc_id", "left_semi")
    kept = kept.dropDuplicates(["doc_id"]) if not _unique(docs) else kept
    return kept.unionByName(_without_id(docs, found)).select(*docs.columns)


def _unique(docs: DataFrame) -> bool:
    counted = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1)
    return not counted.take(1)


def _without_id(docs: DataFrame, found: DataFrame) -> DataFrame:
    none = docs.where("doc_id is null")
    if not none.take(1):
        return none
    lone = none.dropDuplicates(["text"])
    return lone.join(docs.where("doc_id is not null").select("text").distinct(), "text", "left_anti").select(*docs.columns)
