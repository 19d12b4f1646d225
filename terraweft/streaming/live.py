"""Live sessions as a stream with timers: capture decisions and a watch over the link.

A session's state is two values: what the capture rules need (streaming/capture.py) and what was heard last. Event-time timers
watch the link: where nothing has come for 15 s of the stream's time a session is due to return, after 90 s to disarm, and
these events are emitted when the watermark passes the limit, whether or not a further message ever comes. A message after
the limit finds the same events due, so that the rows don't depend on how the stream is cut into triggers. A session that
has been silent for `forget` seconds is forgotten altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terraweft.session import dealt, sent_whole
from terraweft.sources import log_stream
from terraweft.streaming import capture
from terraweft.streaming.capture import FRESH, OUTPUT, STATE, TELEMETRY_SCHEMA, Rules, judged

LIVE_OUTPUT = OUTPUT + ", due_ms long"
#: Seconds of silence and what they call for.
LIMITS = ((15, "return"), (90, "disarm"))
FORGET = 30 * 24 * 3600
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LiveSession(StatefulProcessor):
    """One session's fold. Rows of a trigger are judged in order of msg_id."""

    def __init__(self, rules: Rules, limits: tuple = LIMITS, forget: int = FORGET) -> None:
        self.rules, self.limits, self.forget = rules, limits, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.capture = handle.getValueState("capture", STATE)
        self.link = handle.getValueState("link", "msg_id long, at_ms long, given int")

    def _due(self, session: int, msg_id: int, at_ms: int, given: int, now_ms: int) -> tuple[int, list[tuple]]:
        """How many limits have passed by now, and the events of those not given yet."""
        passed = sum(at_ms + 1000 * s <= now_ms for s, _ in self.limits)
        rows = [(session, msg_id, event, None, None, None, None, None, at_ms + 1000 * s) for s, event in self.limits[given:passed]]
        return max(given, passed), rows

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = int(key[0])
        batch = pd.concat(list(rows)).sort_values("msg_id", kind="stable")
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        out: list[tuple] = []
        link = tuple(self.link.get()) if self.link.exists() else None
        for msg_id, at_ms in zip(batch.msg_id, batch.at_ms, strict=True):
            if link:
                out += self._due(session, *link, int(at_ms))[1]
            link = (int(msg_id), int(at_ms), 0)
        state = tuple(self.capture.get()) if self.capture.exists() else FRESH
        after, events = judged(self.rules, state, batch)
        if after is None:
            self.capture.clear()
        else:
            self.capture.update(after)
        self.link.update(link)
        self.handle.registerTimer(link[1] + 1000 * self.limits[0][0])
        yield _live_frame([(*e, None) for e in events] + out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.link.exists():
            msg_id, at_ms, given = self.link.get()
            now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            if at_ms + 1000 * self.forget <= now:
                self.capture.clear()
                self.link.clear()
            passed, out = self._due(int(key[0]), msg_id, at_ms, given, now)
            if self.link.exists():
                self.link.update((msg_id, at_ms, passed))
                wait = self.limits[passed][0] if passed < len(self.limits) else self.forget
                self.handle.registerTimer(at_ms + 1000 * wait)
        yield _live_frame(out)

    def close(self) -> None:
        pass


def _live_frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = [c.split() for c in LIVE_OUTPUT.split(", ")]
    frame = pd.DataFrame(rows, columns=[c for c, _ in kinds])
    return frame.astype({c: "Int64" if t == "long" else "float64" for c, t in kinds if t != "string"})


def messages_of(lines: DataFrame) -> DataFrame:
    """Telemetry messages of a stream of JSON lines, with the event time as watermark."""
    m = lines.select(F.from_json("line", TELEMETRY_SCHEMA).alias("m")).select("m.*")
    m = m.where("session is not null and msg_id is not null and ts is not null").withColumn("at_ms", F.unix_millis("ts"))
    return m.withWatermark("ts", "0 seconds")


def live(messages: DataFrame, rules: Rules, limits: tuple = LIMITS, forget: int = FORGET) -> DataFrame:
    """Events of each session (capture.OUTPUT) and its link's (`return`, `disarm`, with the time they were due)."""
    with sent_whole(__name__, capture.__name__):
        return messages.groupBy("session").transformWithStateInPandas(LiveSession(rules, limits, forget), LIVE_OUTPUT, "append", "eventTime")


def write_log(rows: DataFrame, folder: str, order: str) -> None:
    """rows as JSON lines, in files whose names follow `order`."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct("*"))).write.mode("append").text(folder)


def drained(events: DataFrame, folder: str) -> DataFrame:
    """Runs a stream until what is there now is read; its rows so far. Called again with the folder it goes on.

    A run ends with the batch without data that the last watermark calls for, so that the timers due by then have fired;
    availableNow leaves that batch out for sources written in Python.
    """
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        q = events.writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(events.schema).parquet(f"{folder}/events")


def log_lines(spark: SparkSession, folder: str, range_bytes: int = log_stream.RANGE_BYTES) -> DataFrame:
    return log_stream.stream(spark, folder, range_bytes)


def write_growing(rows: DataFrame, folder: str, share: float) -> None:
    """A log file for each session (rows: session, at, line), of the first `share` of its bytes.

    Each file is written beside and renamed, so that a reader never sees less than before and a lost task is just repeated.
    A task streams its sessions in order and holds one batch.
    """
    sizes = rows.groupBy("session").agg(F.sum(F.octet_length("line") + 1).alias("size"))
    ordered = dealt(rows.join(sizes, "session"), "session").sortWithinPartitions("session", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        store, root = log_stream._opened(folder)
        own, out, left = None, None, 0
        for b in batches:
            for session, size, line in zip(b.session, b["size"], b.line, strict=True):
                if session != own:
                    if out is not None:
                        _finish(store, out, root, own)
                    own, left = session, int(size * share)
                    store.create_dir(f"{root}/session={own}", recursive=True)
                    out = (f"{root}/session={own}/.{uuid.uuid4().hex}", None)
                    out = (out[0], store.open_output_stream(out[0]))
                data = (line + "\n").encode()[: max(0, left)]
                left -= len(data)
                out[1].write(data)
        if out is not None:
            _finish(store, out, root, own)
        yield pd.DataFrame({"done": [True]})

    ordered.mapInPandas(run, "done boolean").count()


def _finish(store, out: tuple, root: str, session: int) -> None:
    out[1].close()
    store.move(out[0], f"{root}/session={session}/log.jsonl")
