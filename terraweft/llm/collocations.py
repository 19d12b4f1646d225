"""Phrase collocations by prefix-free parsing: n-grams are counted once in each distinct chunk of text.

Texts (A-Z lower-cased) are split at `. , ; : ! ?` and line ends into pieces and those into words at spaces and tabs. A
piece is cut where the content says so: at each window of OVERLAP = size - 1 words whose hash is 0 modulo TRIGGER. A chunk
reaches from one such window to the end of the next, so that neighbours overlap by that window, equal passages are cut
alike wherever they stand, and every phrase of up to `size` words lies within a chunk. The chunks with their frequencies in
the parse are the dictionary. A phrase is counted in a distinct chunk, times the chunk's frequency, where it starts before
the closing window: what starts in an overlap is counted in the chunk that it opens, once.

Phrases are counted by length. One of n words is only looked at where both of its parts of n - 1 words are frequent; which
are is told by BITS bits, a filter of fixed size that passes all frequent ones (and some others, whose counts then decide).
Counts are kept by the phrase itself; within GATHER words of one task equal phrases are found by 64-bit hashes.

Defined results: a null text has no words, a null lang is `und`; repeated rows count each; texts of one piece without any
trigger are one chunk; an empty table gives no rows; columns other than text and lang are not read. Scores are exact while
1000 * a * n stays below 10^38. Ties go to the more frequent phrase, then to the smaller one by UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terraweft.llm.common import _ODD, mixed, salted_lookup, word_hashes
from terraweft.session import settle

#: A window opens a chunk once in TRIGGER times; words taken together in a task; bits of the filter of frequent phrases.
TRIGGER, GATHER, BITS = 16, 500_000, 1 << 25
#: Texts parsed together.
PARSED = 2048
#: Groups that a language's phrases are ranked in before the last ranking.
SALTS = 64
_LINES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def grams(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, by their hashes."""
    many = max(0, len(hashed) - size + 1)
    out = np.full(many, size, np.uint64)
    for k in range(size):
        out += hashed[k : k + many] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
    return mixed(out)


class _Words:
    """The words of many chunks in a row: codes into `names`, with the chunk of each and its place in it."""

    def __init__(self, chunks: pa.Array) -> None:
        lists = pc.split_pattern(chunks.cast(pa.large_string()), " ")
        encoded = lists.flatten().dictionary_encode()
        self.names = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False)
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.chunk = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.starts[self.chunk]
        self.hashed = word_hashes([x.encode("utf-8", "surrogatepass") for x in self.names.to_pylist()])[self.codes] if len(self.codes) else np.empty(0, np.uint64)


def _text_pieces(texts: list[str]) -> list[str]:
    lines = b"\n".join(x.encode("utf-8", "surrogatepass").translate(_LINES) for x in texts).split(b"\n")
    return [p.decode("utf-8", "surrogatepass") for p in (b" ".join(x.split()) for x in lines) if p]


def parse(pieces: Counter, overlap: int, trigger: int) -> Counter:
    """(chunk, words that start before its closing window) -> frequency, of pieces (words joined by one space) with theirs."""
    out: Counter = Counter()
    if not pieces:
        return out
    names = list(pieces)
    words = _Words(pa.array(names, pa.large_string()))
    hashed = grams(words.hashed, overlap) if overlap else words.hashed
    opens = np.zeros(len(words.codes), bool)
    opens[: len(hashed)] = hashed % np.uint64(trigger) == 0
    opens &= (words.place > 0) & (words.place + overlap <= words.sizes[words.chunk])
    cut = np.flatnonzero(opens)
    places, by = words.place[cut].tolist(), np.searchsorted(words.chunk[cut], np.arange(len(names) + 1)).tolist()
    for name, times, size, lo, hi in zip(names, pieces.values(), words.sizes.tolist(), by, by[1:]):
        if lo == hi:
            out[name, size] += times
            continue
        listed, at = name.split(" "), places[lo:hi]
        for first, after in zip([0, *at], [*at, None]):
            end = size if after is None else after + overlap
            out[" ".join(listed[first:end]), (end if after is None else after) - first] += times
    return out


def dictionary(docs: DataFrame, size: int = 5, trigger: int = TRIGGER) -> DataFrame:
    """lang, chunk, owned (words that start before the closing window), times: the distinct chunks of the parse."""
    overlap = size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, PARSED) for whole in batches for lo in range(0, len(whole), PARSED)):
            langs = np.array(b.column(0).to_pylist(), object)
            texts = b.column(1)
            for lang in dict.fromkeys(langs):
                some = texts.filter(pa.array(langs == lang)).to_pylist()
                found = parse(Counter(_text_pieces(some)), overlap, trigger)
                if found:
                    chunk, owned = zip(*found, strict=True)
                    yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array(chunk, pa.string()), pa.array(owned, pa.int32()), pa.array(list(found.values()), pa.int64())], ["lang", "chunk", "owned", "times"])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    cut = texts.mapInArrow(run, "lang string, chunk string, owned int, times long")
    return cut.groupBy("lang", "chunk", "owned").agg(F.sum("times").alias("times"))


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Batches put together, up to about GATHER words (a longer text stands alone)."""
    held, size = [], 0
    for b in batches:
        for lo in range(0, len(b), 2048):
            part = b.slice(lo, 2048)
            held.append(part)
            size += (pc.sum(pc.binary_length(part.column(column))).as_py() or 0) // 6
            if size >= GATHER:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if size or held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _of_langs(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The languages as they are, and a hash of each."""
    encoded = _one(column).dictionary_encode()
    hashed = word_hashes([x.encode("utf-8", "surrogatepass") for x in encoded.dictionary.to_pylist()])
    return _one(column), hashed[encoded.indices.to_numpy(zero_copy_only=False)]


def _counts(words: _Words, langs: pa.Array, lang_hash: np.ndarray, owned: np.ndarray, times: np.ndarray, size: int, passing: np.ndarray | None) -> pa.RecordBatch:
    many = max(0, len(words.codes) - size + 1)
    chunk, place = words.chunk[:many], words.place[:many]
    good = (place < owned[chunk]) & (place + size <= words.sizes[chunk])
    if passing is not None:
        part = grams(words.hashed, size - 1)
        bit = mixed(part ^ lang_hash[words.chunk[: len(part)]]) & np.uint64(BITS - 1)
        known = (passing[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        good &= known[:many] & known[1 : many + 1]
    at = np.flatnonzero(good)
    key = grams(words.hashed, size)[at] ^ mixed(lang_hash[words.chunk[at]])
    same, distinct = pd.factorize(key)
    count = np.bincount(same, weights=times[words.chunk[at]], minlength=len(distinct)).astype(np.int64)
    one = np.empty(len(distinct), np.int64)
    one[same] = at  # any of the places of each phrase
    at = one
    parts = [words.names.take(pa.array(words.codes[at + k])) for k in range(size)]
    phrase = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
    return pa.record_batch([langs.take(pa.array(words.chunk[at])), phrase.cast(pa.string()), pa.array(count)], ["lang", "phrase", "f"])


def counted(chunks: DataFrame, size: int, passing: np.ndarray | None = None) -> DataFrame:
    """lang, phrase, f: occurrences of phrases of `size` words in the whole parse; with a filter, of those that it passes."""
    sent = chunks.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches, "chunk"):
            langs, hashed = _of_langs(t["lang"])
            owned, times = (t[c].to_numpy() for c in ("owned", "times"))
            found = _counts(_Words(_one(t["chunk"])), langs, hashed, owned, times, size, sent.value)
            if len(found):
                yield found

    return chunks.select("lang", "chunk", "owned", "times").mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(frequent: DataFrame, size: int) -> np.ndarray:
    """BITS bits, set for each of the frequent phrases of `size` words; parts are united by slot before they are brought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(BITS // 64, np.uint64)
        for t in _gathered(batches, "phrase"):
            words = _Words(_one(t["phrase"]))
            bit = mixed(grams(words.hashed, size)[words.starts] ^ _of_langs(t["lang"])[1]) & np.uint64(BITS - 1)
            np.bitwise_or.at(slots, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        some = np.flatnonzero(slots)
        for lo in range(0, len(some), 65_536):
            part = some[lo : lo + 65_536]
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(slots[part].view(np.int64))], ["slot", "bits"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def frequent(chunks: DataFrame, size: int = 5, least: int = 100) -> DataFrame:
    """lang, phrase, size, f: all phrases of 1 to `size` words that occur `least` times or more."""
    levels, passing = [], None
    for n in range(1, size + 1):
        found = settle(counted(chunks, n, passing).where(F.col("f") >= least).withColumn("size", F.lit(n)), f"phrases{n}")
        levels.append(found)
        if n < size:
            passing = _filter(found, n)
            if not passing.any():
                break
    return reduce(DataFrame.unionByName, levels)


def _joined(words: Column, start: Column | int, many: Column) -> Column:
    return F.array_join(F.slice(words, start, many), " ")


def collocations(docs: DataFrame, size: int = 5, least: int = 100, share: int = 100, top: int = 2000, trigger: int = TRIGGER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k: each language's best phrases, with the cut (after k words) that scores lowest.

    A phrase that occurs `share` percent of its times or more within one longer candidate is dropped.
    """
    chunks = settle(dictionary(docs, size, trigger), "chunks")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("owned") * F.col("times")).alias("n"))
    known = frequent(chunks, size, least)
    phrases = known.where("size >= 2").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))

    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("head"), _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = salted_lookup(cuts, totals, "lang", "phrase", how="inner")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_up", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n"))).withColumn("_down", wide("l") * wide("r")).withColumn("score", F.expr("_up div _down"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: _joined(F.col("words"), s, m)),
    ))
    longer = phrases.where("size >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("_longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < share * F.col("a"), F.lit(True)))

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), F.col("cut.k").alias("k"))
    # A language's phrases are ranked in SALTS groups first; the last ranking sees `top` of each.
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
