"""URL filters: a sort-merge range join of URLs with rules over reversed hosts.

The canonical key of a URL is its class (1: it has a path, 0: it has none), its host's labels from the last to the first,
each closed by a dot, and its path. A rule (host, path) is then the interval of the keys that start with its own key: a
rule of path `/` covers whole hosts of class 1, one without a path both classes. Rules with a longer path hold for subdomains
too, whose keys lie elsewhere: a URL therefore also gets a key with its host cut to each number of labels that such rules'
hosts have. Intervals of prefixes nest, so that a sweep over keys in order keeps the rules that are open on a stack: a key
pops what it does not start with, and the top knows the best rule of all that are open.

Keys are dealt by range to PARTS times the shuffle's width at most, cut at quantiles of a bounded sample of keys; a rule goes
to every range that its interval meets (a cut lies within as many rules as nest there). Where one key fills several ranges
its rows are dealt over them. A task streams its ranges and holds one stack.

The longest rule wins: by characters of host and path together, then the longer host; of equal rules `block` wins. URLs that
no rule fits get the default verdict.

Defined results: host and path of a URL that is null or has no `://` are empty; hosts keep ports and user names; rules' hosts
are lower-cased as URLs' are; a null host or path of a rule is empty, and such a host covers all; a rule whose path starts
otherwise than with `/` fits nothing; null keys and repeated rows are judged each; an empty table gives no rows, and no
rules leave the default. Columns other than the key and the URL are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweft.session import shuffle_width

#: Sampled keys of a range, and ranges for each shuffle partition.
SAMPLE, PARTS = 32, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_labels(host: Column) -> Column:
    """Labels from the last to the first; an empty host has none."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.", -1)))


def _key(kind: Column, labels: Column, path: Column) -> Column:
    return F.concat(kind, F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit("."))), ""), path)


def _intervals(rules: DataFrame) -> DataFrame:
    """prefix, rank (the larger the better) and the rule's text and verdict; one or two rows a rule."""
    r = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict"))
    r = r.where((F.col("path") == "") | F.col("path").startswith("/")).withColumn("labels", _reversed_labels(F.col("host")))
    kinds = F.when(F.col("path") == "", F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("1")))
    inner = F.when(F.col("path") == "/", F.lit("")).otherwise(F.col("path"))
    # One number: characters of both, of the host, and whether it blocks.
    rank = (F.length("host") + F.length("path")).cast("long") * (1 << 32) + F.length("host") * 2 + (F.col("verdict") == "block").cast("int")
    r = r.select(F.explode(kinds).alias("kind"), "labels", inner.alias("inner"), rank.alias("rank"), F.concat("host", "path").alias("rule"), "verdict")
    return r.select(_key(F.col("kind"), F.col("labels"), F.col("inner")).alias("prefix"), F.size("labels").alias("depth"), (F.col("inner") != "").alias("deep"), "rank", "rule", "verdict")


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """URLs with the best open rule; rows come by range, key, and rules before URLs."""
    stack: list[tuple] = []  # (prefix, best rank, rule, verdict) of what is open
    part = None
    for b in frames:
        ranks, rules, verdicts = [-1] * len(b), [None] * len(b), [None] * len(b)
        for k, (at, key, is_url, rank, rule, verdict) in enumerate(zip(b.part, b.key, b.is_url, b["rank"], b.rule, b.verdict, strict=True)):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, rank, rule, verdict) if not stack or rank > stack[-1][1] else (key, *stack[-1][1:]))
            elif stack:
                _, ranks[k], rules[k], verdicts[k] = stack[-1]
        yield b[["id", "host", "path", "keys"]].assign(rank=ranks, rule=rules, verdict=verdicts)[b.is_url.to_numpy()]


def judged(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (host and path of the one that decides, else null) and verdict of each row of urls.

    rules: host, path, verdict (`allow` or `block`).
    """
    spark = urls.sparkSession
    kind = urls.schema[key].dataType.simpleString()
    spans = _intervals(rules)
    depths = [r.depth for r in spans.where("deep").select("depth").distinct().orderBy("depth").collect()]  # as many as a host has labels
    rows = urls.select(F.col(key).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels, own = _reversed_labels(F.col("host")), F.when(F.col("path") == "", "0").otherwise("1")
    cut = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda d: (d < F.size(labels)) & (F.col("path") != ""))
    keys = F.concat(F.array(_key(own, labels, F.col("path"))), F.transform(cut, lambda d: _key(F.lit("1"), F.slice(labels, 1, d), F.col("path"))))
    rows = rows.withColumn("_keys", keys).select("id", "host", "path", F.size("_keys").alias("keys"), F.explode("_keys").alias("key"))

    ranges = PARTS * shuffle_width(spark)
    share = min(1.0, SAMPLE * ranges / max(1, urls.count()))
    taken = sorted(r.key for r in rows.where(F.pmod(F.xxhash64("key", "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.substring("key", 1, 512).alias("key")).toLocalIterator())
    cuts = [taken[len(taken) * k // ranges] for k in range(1, ranges)] if taken else []
    order = [x.encode("utf-8", "surrogatepass") for x in cuts]  # Spark orders strings by their bytes

    @F.pandas_udf("struct<first:int,last:int>")
    def within(keys: pd.Series) -> pd.DataFrame:
        coded = [x.encode("utf-8", "surrogatepass") for x in keys]
        return pd.DataFrame({"first": [bisect_left(order, x) for x in coded], "last": [bisect_right(order, x) for x in coded]})

    @F.pandas_udf("struct<first:int,last:int>")
    def met(prefixes: pd.Series) -> pd.DataFrame:
        coded = [x.encode("utf-8", "surrogatepass") for x in prefixes]
        return pd.DataFrame({"first": [bisect_left(order, x) for x in coded], "last": [bisect_right(order, x + b"\xff") for x in coded]})

    dealt = rows.withColumn("_at", within("key"))
    dealt = dealt.withColumn("part", F.col("_at.first") + F.pmod(F.xxhash64("id", "host", "path"), F.col("_at.last") - F.col("_at.first") + 1).cast("int"))
    none = F.lit(None)
    dealt = dealt.select("part", "key", F.lit(True).alias("is_url"), "id", "host", "path", "keys", F.lit(-1).cast("long").alias("rank"), none.cast("string").alias("rule"), none.cast("string").alias("verdict"))
    spans = spans.withColumn("_at", met("prefix"))
    spans = spans.select(
        F.explode(F.sequence("_at.first", "_at.last")).alias("part"), F.col("prefix").alias("key"), F.lit(False).alias("is_url"), none.cast(kind).alias("id"),
        none.cast("string").alias("host"), none.cast("string").alias("path"), F.lit(0).alias("keys"), "rank", "rule", "verdict",
    )
    met_rows = dealt.unionByName(spans).repartition(ranges, "part").sortWithinPartitions("part", "key", "is_url")
    swept = met_rows.mapInPandas(_sweep, f"id {kind}, host string, path string, keys int, rank long, rule string, verdict string")
    # Rows of one id, host and path are judged alike; there are as many as keys over keys of one.
    best = swept.groupBy("id", "host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"), (F.count("*") / F.first("keys")).cast("int").alias("times"))
    best = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return best.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
