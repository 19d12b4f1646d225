"""The log source and the live stream: growing files, restarts, timers."""

import io
import random

import pytest
from pyspark.sql import functions as F

from terraweft.functions.geo import Area
from terraweft.sources import log_stream
from terraweft.streaming import capture, live

AREA = Area([(0.0, 0.0), (0.0, 0.01), (0.01, 0.01), (0.01, 0.0)])


@pytest.mark.parametrize("block", [1, 3, 64])
def test_every_line_is_in_one_range(monkeypatch, block):
    monkeypatch.setattr(log_stream, "BLOCK", block)
    rng = random.Random(block)
    data = b"".join(bytes(rng.choice(b"ab\xc3\xa4") for _ in range(rng.randrange(0, 9))) + b"\n" for _ in range(40))
    whole, at = [], 0
    for line in data.splitlines(keepends=True):
        whole.append((at, line[:-1]))
        at += len(line)
    for tail in (b"", b"unfinished \xc3"):
        file = io.BytesIO(data + tail)
        assert log_stream.last_line_end(file, len(data + tail)) == len(data)
        for size in (1, 2, 7, 1000):
            for first in (0, whole[11][0]):
                got = [x for a in range(first, len(data), size) for x in log_stream.lines_of(file, first, a, min(len(data), a + size))]
                assert got == [x for x in whole if x[0] >= first]
    assert log_stream.last_line_end(io.BytesIO(b"no line end"), 11) == 0


def test_log_that_grows_by_half_lines(spark, tmp_path):
    """Three runs, each of which finds a log cut within a line (and a letter), give each line once."""
    logs = {f"{k}.log": "".join(f"{k} zeile {n} ä{'x' * (n % 7)}\n" for n in range(30)).encode() for k in range(3)}
    folder = tmp_path / "log"
    folder.mkdir()
    seen = []
    for share in (0.31, 0.74, 1.0, 1.0):
        for name, data in logs.items():
            (folder / name).write_bytes(data[: int(len(data) * share)])
        seen.append(live.drained(live.log_lines(spark, str(folder), 64), str(tmp_path)).count())
    got = sorted((r.log, r.offset, r.line) for r in live.drained(live.log_lines(spark, str(folder), 64), str(tmp_path)).collect())
    want = [(name, data[:at].rfind(b"\n") + 1, line) for name, data in sorted(logs.items()) for at, line in _lines(data)]
    assert got == want and 0 < seen[0] < seen[1] < seen[2] == seen[3] == 90
    (folder / "0.log").write_bytes(b"short\n")
    with pytest.raises(Exception, match="shorter"):
        live.drained(live.log_lines(spark, str(folder), 64), str(tmp_path))


def _lines(data):
    at = 0
    for line in data.splitlines(keepends=True):
        yield at, line[:-1].decode()
        at += len(line)


def _telemetry(rng, sessions=4, messages=60):
    rows, clock, n = [], 1_700_000_000_000, 0
    for _ in range(messages):
        clock += rng.choice((200, 1000, 4000, 15_000, 20_000, 95_000))
        session, kind, n = rng.randrange(sessions), rng.random(), n + 1
        base = {"session": session, "msg_id": n, "ms": clock}
        if kind < 0.25:
            rows.append(base | {"msg_type": "HEARTBEAT", "src_component": rng.choice((1, 1, 1, 2)), "base_mode": rng.choice((128, 128, 200, 3))})
        elif kind < 0.4:
            rows.append(base | {"msg_type": "ATTITUDE", "roll": rng.uniform(-0.3, 0.3), "pitch": 0.0})
        else:
            rows.append(base | {"msg_type": "GLOBAL_POSITION_INT", "lat_e7": rng.randrange(-20_000, 120_000), "lon_e7": rng.randrange(-20_000, 120_000), "rel_alt_mm": rng.choice((500, 30_000)), "hdg_cdeg": rng.choice((65535, 900))})
    return rows


def _due(rows):
    out, last = [], max(r["ms"] for r in rows)
    for session in {r["session"] for r in rows}:
        own = [r for r in rows if r["session"] == session]
        for r, after in zip(own, [x["ms"] for x in own[1:]] + [last]):
            out += [(session, r["msg_id"], event, r["ms"] + 1000 * s) for s, event in live.LIMITS if r["ms"] + 1000 * s <= after]
    return sorted(out)


@pytest.mark.parametrize("cuts", [(60,), (7, 30, 31, 60)])
def test_live_rows_do_not_depend_on_the_runs(spark, tmp_path, cuts):
    """Capture events equal the batch form's, and silent sessions get their events without a further message."""
    rows = _telemetry(random.Random(8))
    kinds = capture.TELEMETRY_SCHEMA.replace("ts timestamp", "ms long")
    table = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in kinds.split(", ")) for r in rows], kinds).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    rules = capture.Rules(AREA, interval=100.0)
    events = live.live(live.messages_of(live.log_lines(spark, str(tmp_path / "log"), 300)), rules)
    before = 0
    for upto in cuts:
        live.write_log(table.where((F.col("msg_id") > before) & (F.col("msg_id") <= upto)), str(tmp_path / "log"), "msg_id")
        found, before = live.drained(events, str(tmp_path)), upto
    found = found.collect()
    assert sorted((r.session, r.msg_id, r.event, r.due_ms) for r in found if r.due_ms is not None) == _due(rows)
    want = capture.captured(table, rules).collect()
    assert sorted(repr(tuple(r)[:-1]) for r in found if r.due_ms is None) == sorted(repr(tuple(r)) for r in want)
    assert {"armed", "photo", "enter"} <= {r.event for r in want}


def test_silent_sessions_are_forgotten(spark, tmp_path):
    """After `forget` seconds of silence nothing is left of a session: it is not armed any more."""
    beat = lambda n, session, ms, mode: (session, n, "HEARTBEAT", 1, mode, None, None, None, None, None, None, ms)
    kinds = capture.TELEMETRY_SCHEMA.replace("ts timestamp, ", "") + ", ms long"
    t = lambda rows: spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    events = live.live(live.messages_of(live.log_lines(spark, str(tmp_path / "log"))), capture.Rules(AREA), forget=600)
    for rows in ([beat(1, 1, 1_000_000, 128), beat(2, 2, 1_700_000, 128)], [beat(3, 1, 1_800_000, 128)]):
        live.write_log(t(rows), str(tmp_path / "log"), "msg_id")
        found = live.drained(events, str(tmp_path)).collect()
    assert sorted((r.msg_id, r.event) for r in found if r.session == 1) == [(1, "armed"), (1, "disarm"), (1, "return"), (3, "armed")]
