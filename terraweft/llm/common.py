"""Hashing and small relational helpers that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z is lower-cased; a text with fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    hashed = word_hashes(words)
    many = len(words) - size + 1
    out = hashed[:many] * _ODD[0]
    for k in range(1, size):
        out = out + hashed[k : many + k] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
    return np.unique(mixed(out))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _ODD[0] + b * _ODD[1] + _ODD[2])


def salted_lookup(big: DataFrame, small: DataFrame, key: str, spread: Column | str, salts: int = 16, how: str = "left") -> DataFrame:
    """big joined with small (one row a key); a hot key's rows are dealt over `salts` partitions. Both sides are shuffled."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def bounded_sample(df: DataFrame, key: str, rows: int, seed: str, total: int | None = None) -> DataFrame:
    """The rows with the smallest seeded hash of key, at most `rows` of them.

    All but about two times as many are ruled out where they are read, so that what is ordered does not grow with df. total is
    the number of df's rows, or of the table that it was filtered from, which a count of the file footers tells.
    """
    share = min(1.0, (2.0 * rows + 100) / max(1, df.count() if total is None else total))
    order = F.xxhash64(F.lit(seed), key)
    part = F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))
    return df.where(part).orderBy(F.pmod(order, F.lit(1 << 30)), order, key).limit(rows)
