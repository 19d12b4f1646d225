"""What the third round's findings projected to six gigabytes: each of these failed before."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweft.functions import geo
from terraweft.operators import mission, poses
from terraweft.plans import documents, missions

from tests.test_findings_r03 import plan

SF = "/root/testdata/sf0.001"


def test_a_mission_is_made_where_its_row_is(spark):
    """rows were numbered by windows over a union that made the program three times, and joined."""
    for query, keys in ((missions.k9, 2), (missions.s21, 2), (missions.m4, 1), (missions.a12, 1), (documents.m7_whole, 2)):
        found = plan(query(spark, SF))
        assert found.count("Exchange hashpartitioning(") == found.count("REPARTITION_BY_NUM") == keys and "Window" not in found and "BroadcastExchange" not in found
    text = plan(spark.range(3).select(geo.general_number(F.col("id") / 7)))
    assert "transform(" not in text and "regexp_replace" not in text


def test_reports_hold_what_programs_hold(spark):
    """counted from the settings, without the program."""
    m = missions.planned(spark, SF).withColumns({"lap_altitude": F.when(F.col("mission") % 7 == 0, F.col("altitude")).otherwise(F.col("lap_altitude")), "lap": F.when(F.col("mission") % 5 == 0, F.slice("lap", 1, 0)).otherwise(F.col("lap"))})
    stops, seconds = mission.held(m)
    got = {r[0]: (r[1], r[2]) for r in m.select("mission", stops, seconds).collect()}
    items = mission.program(m).where(F.col("command") == mission.WAYPOINT).groupBy("mission").agg(F.count("*"), F.sum("p1"))
    assert got == {r[0]: (r[1], r[2]) for r in items.collect()}


def test_gaps_are_ranked_where_the_views_are(spark, monkeypatch):
    """each way met each candidate in a shuffle of all such pairs."""
    rng = np.random.default_rng(3)
    rows = []
    for g in (1, 2, 3):
        for v in range(20 * g):
            ways = [{k: float(x) for k, x in zip(("nx", "ny", "nz"), n / np.linalg.norm(n))} | {"cx": 0.0, "cy": 0.0, "cz": 0.0, "moved": 1.0} for n in (np.array([0.1 * g, -0.2, 1.0]), rng.normal(0, 1, 3) + [0, 0, 2])]
            rows.append((g, v, ways[:: 1 if v % 3 else -1]))
    held = spark.createDataFrame(rows, f"g long, v long, ways {poses.WAYS}")
    made, settle = [], poses.settle
    monkeypatch.setattr(poses, "settle", lambda df, name: made.append(plan(df)) or settle(df, name))
    found = {r.g: (r.nx, r.ny, r.nz) for r in poses.plane_normals(held, "g", "v").collect()}
    for g in (1, 2, 3):
        assert found[g] == pytest.approx(tuple(np.array([0.1 * g, -0.2, 1.0]) / math.sqrt(1.04 + 0.01 * g * g)), abs=1e-6)
    assert len(made) == 3 and not [x for p in made for x in p.splitlines() if "Exchange hashpartitioning(" in x and ("_c" in x or "v#" in x.split("hashpartitioning(")[1].split(")")[0])]
