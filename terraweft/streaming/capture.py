"""Live capture as a stateful stream: which positions of a telemetry stream become photographs.

Messages of a session arrive in order of msg_id within a trigger. The state of a session is one row: whether it is armed,
the last attitude, the position of the last kept photograph, whether it was in the area, and counters. In this order a
position is judged: armed and high enough, in the area, far enough from the last kept one, level, a frame present. A
position that fails the last two leaves the last kept position as it is. The first disarming ends the session: its
summary is emitted and its state removed; messages after it start a new one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terraweft.functions.geo import METRES_PER_DEGREE, Area

OUTPUT = "session long, msg_id long, event string, lat double, lon double, alt double, heading double, kept long"
STATE = "armed boolean, roll double, pitch double, inside boolean, e double, n double, has_last boolean, kept long"
FRESH = (False, 0.0, 0.0, False, 0.0, 0.0, False, 0)
TELEMETRY_SCHEMA = "session long, msg_id long, ts timestamp, msg_type string, src_component int, base_mode int, lat_e7 long, lon_e7 long, rel_alt_mm long, hdg_cdeg int, roll double, pitch double"


class Rules:
    """What a session's photographs must meet."""

    def __init__(self, area: Area, interval: float = 40.0, min_altitude: float = 1.0, max_tilt_degrees: float = 12.0) -> None:
        self.lat, self.lon, self.edges = area.lat, area.lon, area.edges
        self.shrink = math.cos(math.radians(area.lat))
        self.interval, self.min_altitude, self.max_tilt = interval, min_altitude, math.radians(max_tilt_degrees)

    def inside(self, x: float, y: float) -> bool:
        odd = False
        for (x1, y1), (x2, y2) in self.edges:
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd


def judged(rules: Rules, state: tuple, rows: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
    """The state after a session's messages (None after a disarming), and what they emit."""
    armed, roll, pitch, was_inside, e0, n0, has_last, kept = state
    out: list[tuple] = []
    ended = False
    for r in rows.itertuples(index=False):
        if r.msg_type == "ATTITUDE":
            roll, pitch = r.roll, r.pitch
        elif r.msg_type == "HEARTBEAT":
            if r.src_component != 1:
                continue
            now = bool(int(r.base_mode) & 128)
            if now != armed:
                out.append((r.session, r.msg_id, "armed" if now else "disarmed", None, None, None, None, kept))
            if armed and not now:
                armed, roll, pitch, was_inside, e0, n0, has_last, kept = FRESH
                ended = True
                continue
            armed, ended = now, False if now else ended
        else:
            lat, lon, alt = r.lat_e7 / 1e7, r.lon_e7 / 1e7, r.rel_alt_mm / 1e3
            if not (armed and alt >= rules.min_altitude):
                continue
            # In this order, as everywhere else: captures lie on the area's border, where the last digit decides.
            e, n = (lon - rules.lon) * METRES_PER_DEGREE * rules.shrink, (lat - rules.lat) * METRES_PER_DEGREE
            inside = rules.inside(e, n)
            if inside != was_inside:
                out.append((r.session, r.msg_id, "enter" if inside else "leave", lat, lon, alt, None, kept))
                was_inside = inside
            if not inside or has_last and math.hypot(e - e0, n - n0) < rules.interval:
                continue
            if max(abs(roll), abs(pitch)) > rules.max_tilt:
                continue
            e0, n0, has_last, kept = e, n, True, kept + 1
            heading = 0.0 if r.hdg_cdeg == 65535 else r.hdg_cdeg / 100
            out.append((r.session, r.msg_id, "photo", lat, lon, alt, heading, kept))
    state = (armed, roll, pitch, was_inside, e0, n0, has_last, kept)
    return (None if ended and state == FRESH else state), out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def captured_stream(messages: DataFrame, rules: Rules) -> DataFrame:
    """Events of each session from a streaming frame of messages."""

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("msg_id", kind="stable")
        after, out = judged(rules, state.get if state.exists else FRESH, rows)
        if after is None:
            state.remove()
        else:
            state.update(after)
        yield _frame(out)

    return messages.groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def captured(messages: DataFrame, rules: Rules) -> DataFrame:
    """The same of a table: sessions are sorted within partitions and streamed, one state held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, FRESH
        for b in batches:
            out: list[tuple] = []
            for key, rows in b.groupby("session", sort=False):
                if key != session:
                    session, state = key, FRESH
                after, found = judged(rules, state, rows)
                state = FRESH if after is None else after
                out += found
            yield _frame(out)

    ordered = messages.where("session is not null").repartition("session").sortWithinPartitions("session", "msg_id")
    return ordered.mapInPandas(run, OUTPUT)


def latest(frames: DataFrame, key: str, order: str) -> DataFrame:
    """Of the frames of a trigger the newest of each key: what waits is dropped, not queued."""
    from pyspark.sql import functions as F

    return frames.groupBy(key).agg(F.max_by(F.struct(*frames.columns), order).alias("f")).select("f.*")
