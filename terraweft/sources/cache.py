"""A keyed cache on files that outlives a query: append-only segments of hashed buckets, of which the last entry wins.

A folder holds segments (each a table of entries partitioned by bucket), their Bloom filters, and states. put() writes a new
segment and then a state that names it; a state is a file that is renamed into place, so that a writer that is killed leaves
the last whole state and some files that nobody reads. lookup() asks the filters first: a segment's bucket is read only where
a key may be in it. An entry without a payload is one too (`found`, with nulls): what is known to be absent is not computed
again. compact() writes the last entries of all segments as one and drops the rest.

There is one writer at a time; readers see the state that they opened with.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a segment, bits of a bucket's filter, and bits that a key sets.
BUCKETS, BITS, HASHES = 16, 1 << 15, 4


class KeyedCache:
    """keys: columns of the key; payload: columns kept for it, by a schema string."""

    def __init__(self, spark: SparkSession, folder: str, keys: str, payload: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.keys = StructType.fromDDL(keys).fieldNames()
        self.payload = StructType.fromDDL(payload).fieldNames()
        self.schema = f"{keys}, {payload}"
        self.segments = self._state()

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _states(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path("states")):
            return []
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(self._path("states")) if f.getPath().getName().isdigit())

    def _state(self) -> list[str]:
        """Segments of the last whole state, the oldest first."""
        found = self._states()
        if not found:
            return []
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/states/{found[-1]}").collect()))

    def _commit(self, segments: list[str]) -> None:
        fs, number = self._fs(), (self._states() or [0])[-1] + 1
        draft = self._path("states", f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()
        if not fs.rename(draft, self._path("states", str(number))):
            raise RuntimeError(f"another writer has made state {number} of {self.folder}")
        self.segments = segments

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _places(self) -> Column:
        """The bits of a key."""
        return F.array(*(F.pmod(F.xxhash64(F.lit(k), *self.keys), F.lit(BITS)).cast("int") for k in range(HASHES)))

    def _write(self, entries: DataFrame) -> str:
        name = uuid.uuid4().hex
        path = f"{self.folder}/segments/{name}"
        held = entries.select(*self.keys, *self.payload).withColumn("bucket", self._bucket())
        # Several tasks share a bucket: of as many tasks as buckets a part would have none.
        held.repartition("bucket", F.pmod(F.shiftright(F.xxhash64(*self.keys), 32), F.lit(4))).write.partitionBy("bucket").parquet(f"{path}/entries")
        own = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{path}/entries")
        bits = own.select("bucket", F.explode(self._places()).alias("at")).groupBy("bucket", F.shiftright("at", 6).alias("slot"))
        bits = bits.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63))).alias("bits"))
        bits.coalesce(1).write.parquet(f"{path}/filter")
        return name

    def put(self, entries: DataFrame) -> None:
        """Entries (keys and payload, one a key) as a new segment; they win over those before."""
        self._commit([*self.segments, self._write(entries)])

    def _entries(self, names: list[str], buckets: dict[str, list[int]] | None = None) -> DataFrame | None:
        out = None
        for age, name in enumerate(self.segments):
            if name not in names:
                continue
            part = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/segments/{name}/entries")
            part = part.where(F.col("bucket").isin(buckets[name])) if buckets else part
            part = part.withColumn("_age", F.lit(age))
            out = part if out is None else out.unionByName(part)
        return out

    def candidates(self, keys: DataFrame) -> dict[str, list[int]]:
        """The buckets of each segment that may hold one of the keys, by the filters alone."""
        out: dict[str, list[int]] = {}
        asked = keys.select(self._bucket().alias("bucket"), self._places().alias("_at"))
        for name in self.segments:
            held = self.spark.read.schema("bucket int, slot int, bits long").parquet(f"{self.folder}/segments/{name}/filter")
            # A filter is of fixed size: keys are judged where they lie, each as one row.
            bits = held.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("_m"))
            bits = bits.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda s: F.coalesce(F.col("_m")[s], F.lit(0).cast("long"))).alias("_bits"))
            places = [F.col("_at")[k] for k in range(HASHES)]
            hit = [F.call_function("shiftright", F.col("_bits")[F.shiftright(p, 6)], p.bitwiseAND(63)).bitwiseAND(1) == 1 for p in places]
            some = asked.join(F.broadcast(bits), "bucket").where(reduce(lambda x, y: x & y, hit)).select("bucket").distinct().collect()
            if some:
                out[name] = sorted(r.bucket for r in some)
        return out

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys with the payload of their last entry and `found`; payload is null for unknown keys and negative entries."""
        chosen = self.candidates(keys) if self.segments else {}
        entries = self._entries(list(chosen), chosen) if chosen else None
        if entries is None:
            kinds = StructType.fromDDL(self.schema)
            return keys.select(*self.keys, *(F.lit(None).cast(kinds[c].dataType).alias(c) for c in self.payload), F.lit(False).alias("found"))
        last = entries.groupBy(*self.keys).agg(F.max_by(F.struct(*self.payload), "_age").alias("_last"))
        met = keys.select(*self.keys).join(last, self.keys, "left")
        return met.select(*self.keys, *(F.col(f"_last.{c}").alias(c) for c in self.payload), F.col("_last").isNotNull().alias("found"))

    def absent(self, keys: DataFrame) -> DataFrame:
        return self.lookup(keys).where("not found").select(*self.keys)

    def compact(self) -> None:
        """One segment of the last entries; the others' files go once the new state stands."""
        if len(self.segments) < 2:
            return
        old = self.segments
        last = self._entries(old).groupBy(*self.keys).agg(F.max_by(F.struct(*self.payload), "_age").alias("_last")).select(*self.keys, "_last.*")
        self._commit([self._write(last)])
        for name in old:
            self._fs().delete(self._path("segments", name), True)
