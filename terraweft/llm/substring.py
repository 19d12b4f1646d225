"""Substring dedup: passages of WINDOW words that also start in a document with a smaller doc_id are removed.

1. Fingerprints. The hashes of a text's ANCHOR-word phrases are winnowed: every window of WINDOW words holds at least one
   chosen phrase, the same one wherever the window occurs. Of equal texts only the one with the smallest doc_id goes on;
   in the others every window is a repeat.
2. Confirm. Phrases chosen in two documents or more recur; each is taken from the smallest document that holds it. A
   window that recurs holds such a phrase. Documents without any are done.
3. Shards. Phrases that were taken from one piece (STEP words) of a document form a unit, and units are dealt to shards of
   bounded size. Texts are cut into pieces that overlap by a window less one word, so that a very long text is no single
   row, and each piece goes to every shard that has a phrase for it. A unit whose pieces exceed a shard (a passage of very
   many documents) gets several shards, each with its automaton and a part of the pieces.
4. Locate. A shard compiles its phrases into one Aho-Corasick automaton over word numbers and streams its pieces through
   it; the occurrences, and nothing else, name the windows around them. Windows of one shard are told apart by their words
   (grouped by a hash, then compared word by word).
5. Exchange. Only shards that share a unit send their windows' 128-bit digests, once each with the smallest doc_id, to
   the digests' fragments, which tell each shard what starts in a smaller document elsewhere.
6. Remove. The spans of a document's windows are united and cut out of its text.

Defined results: a null text has no words; texts below WINDOW words keep all; a row with a null doc_id is never smaller,
and keeps all; rows that share a doc_id don't remove from each other; repeated rows get equal results; an empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweft.llm.common import mixed, pair_hash, salted_lookup, word_hashes
from terraweft.session import discard, release, settle, shuffle_width, split_join

WINDOW, ANCHOR = 50, 25
#: Words of a piece, not counting what it shares with the next one.
STEP = 1024
#: Words of the pieces of a shard, about.
SHARD_WORDS = 200_000
#: Digests in a fragment of the exchange, about.
FRAGMENT = 500_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_SPANS = "array<struct<start:int,end:int>>"


def words_of(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)).split()


def phrase_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` neighbouring words, from doubled phrases that overlap."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    have = 1
    while have * 2 <= size:
        h = pair_hash(h[:-have], h[have:])
        have *= 2
    return h if have == size else pair_hash(h[: len(h) - (size - have)], h[size - have :])


def winnowed(phrases: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest phrase of each `width` neighbouring ones stands (the last of equal ones), each place once."""
    if len(phrases) < width:
        return np.empty(0, np.int64)
    rank = np.empty(len(phrases), np.int64)  # by value, and by place from the end
    rank[np.lexsort((-np.arange(len(phrases)), phrases))] = np.arange(len(phrases))
    low, have = rank, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    step = width - have
    low = np.minimum(low[: len(low) - step], low[step:]) if step else low
    place = np.empty(len(phrases), np.int64)
    place[rank] = np.arange(len(phrases))
    return np.sort(place[np.unique(low)])


def _fingerprints(window: int, anchor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, tag, text in zip(b.doc_id, b.tag, b.text, strict=True):
                words = words_of(text)
                joined = b" ".join(words)
                phrases = phrase_hashes(word_hashes(words), anchor) if len(words) >= window else np.empty(0, np.uint64)
                at = winnowed(phrases, window - anchor + 1)
                rows.append((doc_id, tag, len(words), xxhash.xxh3_128_digest(joined), hashlib.sha256(joined).hexdigest(), phrases[at].view(np.int64), at))
            yield pd.DataFrame(rows, columns=["doc_id", "tag", "n_words", "cls", "sha", "chosen", "places"]).astype({"doc_id": "Int64"})

    return run


_PIECES = "shard long, shared boolean, doc_id long, tag long, start int, text binary, compile array<int>"


def _piece(place: str, window: int, anchor: int, step: int) -> str:
    """SQL for the first piece of a text that holds the whole phrase at place."""
    return f"cast(greatest(0, ceil(({place} - {step + window - 1 - anchor}) / {step})) as int)"


def _pieces(window: int, anchor: int, step: int, shards: int):
    """Pieces of each text, one row for each shard that has phrases for it, with the places of phrases to compile."""
    size = step + window - 1
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for b in batches:
            for r in b.itertuples(index=False):
                words = words_of(r.text)
                place, lo, piece, parts, own = (np.array([x[c] for x in r.held], np.int64) for c in ("place", "lo", "piece", "parts", "own"))
                order = np.argsort(place, kind="stable")
                place, parts, own, piece = place[order], parts[order].tolist(), own[order].tolist(), piece[order]
                unit = (mixed(lo[order].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64)) >> np.uint64(2)).tolist()
                for start in range(0, max(1, len(words) - window + 1), step):
                    first, last = np.searchsorted(place, (start, start + size - anchor + 1)).tolist()
                    wanted: dict[tuple[int, bool], list[int]] = {}
                    for k in range(first, last):
                        # The piece that a unit is named after brings its phrases to each of the unit's shards.
                        named = own[k] and piece[k] == start // step
                        for part in range(parts[k]) if named else (r.tag % parts[k],):
                            to = wanted.setdefault((unit[k] % shards, False) if parts[k] == 1 else (-1 - unit[k] - part, True), [])
                            if named:
                                to.append(int(place[k]) - start)
                    text = b" ".join(words[start : start + size]) if wanted else b""
                    rows += [(shard, shared, r.doc_id, r.tag, start, text, places) for (shard, shared), places in wanted.items()]
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        yield pd.DataFrame(rows, columns=names)

    return run


def automaton(texts: list[list[int]], places: list[list[int]], anchor: int) -> ahocorasick.Automaton:
    """Over word numbers: the phrases that start at the given places."""
    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for text, at in zip(texts, places, strict=True):
        for p in at:
            a.add_word(tuple(text[p : p + anchor]))
    if len(a):
        a.make_automaton()
    return a


def same_words(flat: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` words from left[k] on equal those from right[k] on."""
    out = np.ones(len(left), bool)
    for lo in range(0, len(left), 50_000):
        part = slice(lo, lo + 50_000)
        reach = np.arange(size)
        out[part] = (flat[left[part, None] + reach] == flat[right[part, None] + reach]).all(1)
    return out


def sources(flat: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """For each window (starts, in order of precedence) the first one with the same words, as its number in starts."""
    hashed = phrase_hashes(mixed(flat.astype(np.uint64) + np.uint64(1)), size)[starts]
    _, first, back = np.unique(hashed, return_index=True, return_inverse=True)
    source = first[back]
    wrong = ~same_words(flat, starts, starts[source], size)
    if wrong.any():  # equal hashes of different words: those groups are told apart by their words alone
        seen: dict[tuple[int, ...], int] = {}
        for k in np.flatnonzero(np.isin(hashed, hashed[wrong])).tolist():
            source[k] = seen.setdefault(tuple(flat[starts[k] : starts[k] + size].tolist()), k)
    return source


def spans_of(hit: np.ndarray, window: int) -> list[dict]:
    """Runs of words that windows starting at hit (sorted) cover."""
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > window)
    return [{"start": int(a), "end": int(b) + window} for a, b in zip(hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)], strict=True)]


class _Shard:
    """The windows around what a shard's automaton finds in its pieces, in order of doc_id."""

    def __init__(self, group: pd.DataFrame, window: int, anchor: int) -> None:
        group = group.sort_values("doc_id", kind="stable")
        self.window, self.pieces = window, [words_of(t) for t in group.text]
        numbers: dict[bytes, int] = {}
        texts = [[numbers.setdefault(w, len(numbers)) for w in words] for words in self.pieces]
        a = automaton(texts, [list(p) for p in group.compile], anchor)
        self.base = np.append(0, np.cumsum([len(t) for t in texts]))
        found = [np.empty(0, np.int64)]
        for k, text in enumerate(texts):
            ends = np.fromiter((e for e, _ in a.iter(tuple(text))), np.int64) if len(a) and len(text) >= window else np.empty(0, np.int64)
            if len(ends):
                starts = len(text) - window + 1
                mark = np.zeros(starts + 1, np.int64)
                np.add.at(mark, np.clip(ends - window + 1, 0, starts), 1)
                np.add.at(mark, np.clip(ends - anchor + 2, 0, starts), -1)
                found.append(self.base[k] + np.flatnonzero(np.cumsum(mark[:-1]) > 0))
        self.starts = np.concatenate(found)
        self.owner = np.searchsorted(self.base, self.starts, "right") - 1
        doc_id, self.tag, offset = (group[c].to_numpy(np.int64) for c in ("doc_id", "tag", "start"))
        self.doc = doc_id[self.owner]
        self.at = self.starts - self.base[self.owner] + offset[self.owner]
        self.source = sources(np.concatenate([np.array(t, np.int64) for t in texts]), self.starts, window) if len(self.starts) else self.starts
        self.lowest = self.doc[self.source]

    def digests(self) -> tuple[np.ndarray, list[bytes]]:
        """The distinct windows (their numbers) and the digests of their words."""
        lone = np.flatnonzero(self.source == np.arange(len(self.source)))
        places = (self.starts - self.base[self.owner])[lone].tolist()
        return lone, [xxhash.xxh3_128_digest(b" ".join(self.pieces[o][p : p + self.window])) for o, p in zip(self.owner[lone].tolist(), places, strict=True)]

    def spans(self, lowest: np.ndarray) -> pd.DataFrame:
        """Of each piece the spans of windows for which lowest is a smaller document."""
        repeat = lowest < self.doc
        at, owner, doc = self.at[repeat], self.owner[repeat], self.doc[repeat]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        rows = [(int(doc[x[0]]), int(self.tag[owner[x[0]]]), spans_of(at[x], self.window)) for x in np.split(np.arange(len(at)), cuts) if len(x)]
        return pd.DataFrame(rows, columns=["doc_id", "tag", "spans"])


def _located(window: int, anchor: int):
    """Of a shard that shares no unit: the spans to remove."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = _Shard(group, window, anchor)
        return shard.spans(shard.lowest)

    return run


def _sent(window: int, anchor: int, fragments: int):
    """Of a shard that shares its unit: its windows' digests with their smallest doc_id, by fragment."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = _Shard(group, window, anchor)
        lone, digests = shard.digests()
        part = np.array([int.from_bytes(d[:4], "big") * fragments >> 32 for d in digests], np.int64)
        order = np.argsort(part, kind="stable")
        split = [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]
        return pd.DataFrame({
            "shard": int(group.shard.iloc[0]), "fragment": [int(part[x[0]]) for x in split],
            "digests": [b"".join(digests[k] for k in x) for x in split], "lowest": [shard.lowest[lone[x]].tobytes() for x in split],
        })

    return run


def _told(window: int, anchor: int):
    """Of a shard that shares its unit: the spans to remove, with what it was told of the others."""

    def run(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"doc_id": [], "tag": [], "spans": []})
        shard = _Shard(group, window, anchor)
        least = {d: low for r in told.itertuples(index=False) for d, low in zip(_cut(r.digests), np.frombuffer(r.lowest, np.int64).tolist(), strict=True)}
        lone, digests = shard.digests()
        lowest = np.zeros(len(shard.source), np.int64)
        lowest[lone] = [min(own, least.get(d, own)) for own, d in zip(shard.lowest[lone].tolist(), digests, strict=True)]
        return shard.spans(lowest[shard.source])

    return run


def _cut(digests: bytes) -> list[bytes]:
    return [bytes(digests[k : k + 16]) for k in range(0, len(digests), 16)]


def _elsewhere(group: pd.DataFrame) -> pd.DataFrame:
    """Of a fragment: for each shard the digests of windows that start in a smaller document in another one."""
    least: dict[bytes, int] = {}
    listed = [(_cut(d), np.frombuffer(low, np.int64).tolist()) for d, low in zip(group.digests, group.lowest, strict=True)]
    for digests, lowest in listed:
        for d, low in zip(digests, lowest, strict=True):
            if least.setdefault(d, low) > low:
                least[d] = low
    rows = []
    for shard, (digests, lowest) in zip(group.shard, listed, strict=True):
        told = [(d, least[d]) for d, low in zip(digests, lowest, strict=True) if least[d] < low]
        if told:
            rows.append((shard, b"".join(d for d, _ in told), np.array([low for _, low in told], np.int64).tobytes()))
    return pd.DataFrame(rows, columns=["shard", "digests", "lowest"])


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, tag, text, spans in zip(b.doc_id, b.tag, b.text, b.spans, strict=True):
            words = words_of(text)
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, [x["start"] for x in spans], 1)
            np.add.at(mark, [x["end"] for x in spans], -1)
            gone = np.cumsum(mark[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((doc_id, tag, int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]))
        yield pd.DataFrame(rows, columns=["doc_id", "tag", "gone", "kept", "removed"])


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (word numbers, end exclusive) of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    spark, step = docs.sparkSession, STEP
    schema = "doc_id long, tag long, n_words long, cls binary, sha string, chosen array<long>, places array<int>"
    read = settle(docs.mapInPandas(_fingerprints(window, anchor), schema), "fingerprints")
    copies = read.where(f"n_words >= {window}").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    stats = settle(salted_lookup(read, copies.select("cls", "first"), "cls", "doc_id"), "stats")
    discard(read)

    # Confirm: phrases of two documents, each taken from the smallest.
    phrases = stats.where("doc_id is not null and size(chosen) > 0 and (first is null or doc_id = first)")
    phrases = phrases.select("doc_id", "tag", F.least("n_words", F.lit(step)).alias("words"), F.explode(F.arrays_zip("chosen", "places")).alias("x"))
    phrases = phrases.select("doc_id", "tag", "words", F.col("x.chosen").alias("phrase"), F.col("x.places").alias("place"))
    recurring = phrases.groupBy("phrase").agg(F.min(F.struct("doc_id", "place")).alias("low"), F.max("doc_id").alias("hi")).where("low.doc_id < hi")
    recurring = recurring.select("phrase", F.col("low.doc_id").alias("lo"), F.col("low.place").alias("at"))
    held = split_join(phrases, recurring, "phrase").withColumn("piece", F.expr(_piece("at", window, anchor, step)))
    held = settle(held.select("doc_id", "tag", "words", "place", "lo", "piece", F.expr("lo = doc_id and at = place").cast("int").alias("own")), "held")

    # Units that exceed a shard get several.
    units = held.select("lo", "piece", "doc_id", "tag", "words", F.expr(f"place div {step}").alias("part")).distinct()
    units = settle(units.groupBy("lo", "piece").agg(F.sum("words").alias("words")), "units")
    total, wide = units.agg(F.sum("words"), F.sum(F.when(F.col("words") > SHARD_WORDS, F.col("words")))).first()
    width = shuffle_width(spark)
    shards = max(width, -(-(total or 0) // SHARD_WORDS))
    parts = units.where(F.col("words") > SHARD_WORDS).select(F.struct("lo", "piece").alias("unit"), F.ceil(F.col("words") / SHARD_WORDS).cast("int").alias("parts"))
    held = salted_lookup(held.withColumn("unit", F.struct("lo", "piece")), parts, "unit", "doc_id").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("place", "lo", "piece", "parts", "own")).alias("held"))
    texts = settle(docs.where("doc_id is not null").join(held.hint("shuffle_hash"), ["doc_id", "tag"]), "texts")

    # Locate.
    release(spark)
    pieces = settle(texts.mapInPandas(_pieces(window, anchor, step, shards), _PIECES), "pieces")
    spans = f"doc_id long, tag long, spans {_SPANS}"
    found = pieces.where("not shared").groupBy("shard").applyInPandas(_located(window, anchor), spans)
    if wide:
        shared = pieces.where("shared")
        sent = shared.groupBy("shard").applyInPandas(_sent(window, anchor, -(-wide // FRAGMENT)), "shard long, fragment long, digests binary, lowest binary")
        told = sent.groupBy("fragment").applyInPandas(_elsewhere, "shard long, digests binary, lowest binary")
        found = found.unionByName(shared.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(_told(window, anchor), spans))

    # Remove.
    found = settle(found, "spans").groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    result = texts.select("doc_id", "tag", "text").join(found, ["doc_id", "tag"]).mapInPandas(_removed, f"doc_id long, tag long, gone long, kept string, removed {_SPANS}")
    result = result.dropDuplicates(["doc_id", "tag"])
    full = stats.join(result, ["doc_id", "tag"], "left")
    copy = F.col("first") < F.col("doc_id")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return full.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("removed", F.array().cast(_SPANS))).alias("removed"),
    )
