"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Normalised: A-Z lower-cased, words are runs of letters and digits (every character from U+0080 up counts as a letter).
A pattern is a window of WINDOW consecutive words of an item; an item with fewer words, but not none, is one window.
The automaton is compiled once per Python worker. Patterns are sent in groups of at most GROUP_CHARS characters, which
bounds what is broadcast; a larger benchmark is scanned group by group and the hits of a row are united by a key of its own.

Defined results: null texts have no words; an item without words matches nothing; equal items all count; hits at ties or
overlaps are the union of their words; a table without rows gives an empty result. Spans are character offsets in the
original text, end exclusive, of each run of hit words.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from terraweft.session import settle

WINDOW = 10
GROUP_CHARS = 32_000_000
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of the original text before lower-casing: digits, letters and what lies above ASCII.
_CASED = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_compiled: dict[str, ahocorasick.Automaton] = {}


def normalised(text: str | None) -> str:
    """Words joined by one space, lower case."""
    if not text:
        return ""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()).decode("utf-8", "surrogatepass")


def windows(text: str | None, size: int = WINDOW) -> list[tuple[str, int]]:
    """Distinct (pattern, number of words) of an item."""
    words = normalised(text).split(" ") if text else []
    words = [w for w in words if w]
    if not words:
        return []
    if len(words) <= size:
        return [(f" {' '.join(words)} ", len(words))]
    return list({f" {' '.join(words[i : i + size])} ": size for i in range(len(words) - size + 1)}.items())


def automaton(patterns: list[tuple[str, int, list[int]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, (pattern, *_) in enumerate(patterns):
        a.add_word(pattern, k)
    if patterns:
        a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, patterns: list[tuple[str, int, list[int]]], text: str) -> tuple[int, np.ndarray, set[int]]:
    """Number of words of a text, the numbers of its hit words, and the items that hit."""
    norm = normalised(text)
    if not norm:
        return 0, np.empty(0, np.int64), set()
    padded = f" {norm} "
    found = list(a.iter(padded)) if len(a) else []
    many = padded.count(" ") - 1
    if not found:
        return many, np.empty(0, np.int64), set()
    spaces = np.flatnonzero(np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    last = np.searchsorted(spaces, np.array([e for e, _ in found])) - 1
    size = np.array([patterns[k][1] for _, k in found])
    mark = np.zeros(many + 1, np.int64)
    np.add.at(mark, last - size + 1, 1)
    np.add.at(mark, last + 1, -1)
    return many, np.flatnonzero(np.cumsum(mark[:-1])), {i for k in {k for _, k in found} for i in patterns[k][2]}


def spans(text: str, words: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of each run of neighbouring hit words."""
    if not len(words):
        return []
    places = [m.span() for m in _CASED.finditer(text)]
    cuts = np.flatnonzero(np.diff(words) > 1) + 1
    return [(places[run[0]][0], places[run[-1]][1]) for run in np.split(words, cuts)]


def _groups(benchmark: DataFrame, size: int) -> Iterator[list[tuple[str, int, list[int]]]]:
    """Patterns with their items, group by group; items arrive one partition at a time."""
    held: dict[tuple[str, int], set[int]] = defaultdict(set)
    chars = 0
    for item, text in benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        for pattern in windows(text, size):
            chars += len(pattern[0]) if pattern not in held else 0
            held[pattern].add(item)
        if chars >= GROUP_CHARS:
            yield [(p, n, sorted(i)) for (p, n), i in held.items()]
            held, chars = defaultdict(set), 0
    yield [(p, n, sorted(i)) for (p, n), i in held.items()]


def _split(benchmark: DataFrame, size: int) -> tuple[bool, Iterator[list[tuple[str, int, list[int]]]]]:
    """Whether there is more than one group, and the groups."""
    groups = _groups(benchmark, size)
    head = [g for _, g in zip(range(2), groups)]
    return len(head) > 1, chain(head, groups)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hit_words (their numbers, from 0), items (sorted item_ids) and spans of each row of docs."""
    schema = "doc_id long, n_words long, hit_words array<int>, items array<long>, spans array<struct<start:int,end:int>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several, groups = _split(benchmark, size)
    if several:
        keyed = _keyed(rows)
        hit = _united(keyed, groups)
        return keyed.select("_key", "doc_id").join(hit, "_key").select("doc_id", "n_words", F.transform("places", lambda p: p["word"]).alias("hit_words"), "items", _runs("places").alias("spans"))
    patterns = next(groups)
    sent = docs.sparkSession.sparkContext.broadcast(patterns)
    key = hashlib.sha1(repr(patterns).encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _compiled:
            _compiled.clear()
            _compiled[key] = automaton(sent.value)
        for b in batches:
            rows = [(*hits(_compiled[key], sent.value, t), t) for t in b.text]
            yield pd.DataFrame({
                "doc_id": b.doc_id.astype("Int64"),
                "n_words": [r[0] for r in rows],
                "hit_words": [r[1].astype(np.int32) for r in rows],
                "items": [np.array(sorted(r[2]), np.int64) for r in rows],
                "spans": [[{"start": a, "end": b} for a, b in spans(r[3], r[1])] for r in rows],
            })

    return rows.mapInPandas(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, the whole row and a key of it, written: equal rows stay apart and every scan sees the same keys."""
    row = F.struct(*docs.columns).alias("_row")
    return settle(docs.select(row, "doc_id", "text").withColumn("_key", F.monotonically_increasing_id()), "keyed")


def _united(keyed: DataFrame, groups: Iterator[list[tuple[str, int, list[int]]]]) -> DataFrame:
    """_key, n_words, places (word, start and end of each hit word, in order) and items over all groups. Texts don't move."""
    schema = "_key long, n_words long, places array<struct<word:int,start:int,end:int>>, items array<long>"
    every = None
    for patterns in groups:
        sent = keyed.sparkSession.sparkContext.broadcast(patterns)
        key = hashlib.sha1(repr(patterns).encode("utf-8", "surrogatepass")).hexdigest()

        def run(batches: Iterator[pd.DataFrame], sent=sent, key=key) -> Iterator[pd.DataFrame]:
            if key not in _compiled:
                _compiled.clear()
                _compiled[key] = automaton(sent.value)
            for b in batches:
                rows = [(*hits(_compiled[key], sent.value, t), t) for t in b.text]
                at = [[m.span() for m in _CASED.finditer(t)] if len(words) else [] for _, words, _, t in rows]
                yield pd.DataFrame({
                    "_key": b._key,
                    "n_words": [r[0] for r in rows],
                    "places": [[{"word": int(w), "start": x[w][0], "end": x[w][1]} for w in r[1]] for r, x in zip(rows, at, strict=True)],
                    "items": [np.array(sorted(r[2]), np.int64) for r in rows],
                })

        found = keyed.select("_key", "text").mapInPandas(run, schema)
        every = found if every is None else every.unionByName(found)
    return every.groupBy("_key").agg(F.max("n_words").alias("n_words"), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("places", "items")))


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _runs(places: pd.Series) -> pd.Series:
    """Spans of neighbouring hit words."""
    out = []
    for words in places:
        run: list[dict] = []
        last = None
        for p in words:
            if run and p["word"] == last + 1:
                run[-1]["end"] = p["end"]
            else:
                run.append({"start": p["start"], "end": p["end"]})
            last = p["word"]
        out.append(run)
    return pd.Series(out, dtype="object")


def _clean(sent: Broadcast, key: str, share: float) -> Callable[[str], Column]:
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if key not in _compiled:
            _compiled.clear()
            _compiled[key] = automaton(sent.value)
        out = []
        for t in texts:
            many, words, _ = hits(_compiled[key], sent.value, t)
            out.append(len(words) <= share * many)
        return pd.Series(out, dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: float = 0.0) -> DataFrame:
    """docs without the rows of which more than `share` of the words are hit; columns are docs'.

    The scan runs beside the row, so that no join is needed; a benchmark of several groups filters group by group. Only
    a share of the words of several groups' hits takes a join, by a key of the row.
    """
    several, groups = _split(benchmark, size)
    if several and share > 0:
        keyed = _keyed(docs)
        over = _united(keyed, groups).where(F.size("places") > share * F.col("n_words")).select("_key")
        return keyed.join(over, "_key", "left_anti").select("_row.*")
    kept = docs
    for patterns in groups:
        sent = docs.sparkSession.sparkContext.broadcast(patterns)
        key = hashlib.sha1(repr(patterns).encode("utf-8", "surrogatepass")).hexdigest()

        kept = kept.where(_clean(sent, key, share)("text"))
    return kept
