"""What the third round's findings named on larger tables: each of these failed before."""

import math
import random

from pyspark.sql import functions as F

from terraweft import session
from terraweft.operators import compositing, proximity, seams
from terraweft.plans import capture, extras, live, rasters
from terraweft.sources import log_stream

from tests.test_findings_r03 import plan

SF = "/root/testdata/sf0.001"


def test_cells_are_made_where_they_are_summed(spark):
    """Only captures are shuffled, and their tasks grow in number with the table."""
    for query in (rasters.a7, rasters.r12, extras.r7, extras.r8_whole):
        found = plan(query(spark, SF))
        assert found.count("Exchange hashpartitioning(") == found.count("REPARTITION_BY_NUM") > 0 and "BroadcastExchange" not in found
    df = spark.range(1000)
    assert session.dealt(df, "id", 10).rdd.getNumPartitions() == 100
    assert session.dealt(df, "id").rdd.getNumPartitions() == session.shuffle_width(spark)


def test_groups_are_balanced_in_their_task_as_by_rounds(spark, monkeypatch):
    """no rounds over one system of all groups; a null leaves its group to them."""
    rng = random.Random(4)
    rows = [(g, v, r, c, rng.uniform(20, 230)) for g in (1, 2, 3) for v in range(5) for r in range(v, v + 6) for c in range(2 * v, 2 * v + 5)]
    rows += [(4, 1, 0, 0, 9.0), (5, 1, 0, 0, 9.0), (5, 2, 0, 0, None)]
    frame = spark.createDataFrame(rows, "g long, v long, row int, col int, value double")
    found, rounds = [], []
    whole = seams.conjugate_gradients
    monkeypatch.setattr(seams, "conjugate_gradients", lambda *a: rounds.append(1) or whole(*a))
    for pairs, data in ((seams.PAIRS, frame.where("g < 5")), (100, frame.where("g < 5")), (0, frame.where("g < 5"))):
        monkeypatch.setattr(seams, "PAIRS", pairs)
        found.append({(r.g, r.v, r.block_row, r.block_col): r.gain for r in seams.block_gains(data, "g", "v", 3).collect()})
        assert len(rounds) == len(found) - 1
    for other in found[1:]:
        assert other.keys() == found[0].keys() and all(abs(other[k] - x) < 1e-6 for k, x in found[0].items())
    monkeypatch.setattr(seams, "PAIRS", 10**6)
    assert {r.g for r in seams.block_gains(frame, "g", "v", 3).collect()} == {1, 2, 3, 4, 5}


def test_tasks_follow_bytes_and_not_files(tmp_path, monkeypatch):
    """one task for many small logs, and logs that have not grown are left closed."""
    for k in range(300):
        (tmp_path / f"{k}.jsonl").write_bytes(b"a\nbb\ntorn"[: 3 + k % 7])
    reader = log_stream.LogReader(str(tmp_path), 4)
    end = reader.latestOffset()
    assert set(end.values()) == {2, 5} and len(end) == 300
    opened, look = [], log_stream.last_line_end
    monkeypatch.setattr(log_stream, "last_line_end", lambda *a: opened.append(1) or look(*a))
    assert reader.latestOffset() == end and not opened
    (tmp_path / "0.jsonl").write_bytes(b"a\nbb\nccc\n")
    after = reader.latestOffset()
    assert after == end | {"0.jsonl": 9} and len(opened) == 1
    rows = lambda a, b: sorted(r for t in reader.partitions(a, b) for x in reader.read(t) for r in zip(*x.to_pydict().values()))
    assert len(reader.partitions({}, end)) == 1
    assert rows({}, end) == sorted([(f"{k}.jsonl", 0, "a") for k in range(300)] + [(f"{k}.jsonl", 2, "bb") for k in range(300) if k % 7 >= 2])
    assert rows(end, after) == [("0.jsonl", 2, "bb"), ("0.jsonl", 5, "ccc")]
    monkeypatch.setattr(log_stream, "TASK_BYTES", 40)
    assert 30 <= len(reader.partitions({}, end)) <= 50


def test_groups_are_blended_in_their_task_as_by_joins(spark, monkeypatch):
    """levels of all views were written and shuffled; a null leaves its group to the joins."""
    rng = random.Random(8)
    rows = [(g, v, r, c, rng.uniform(0, 255), rng.choice([0.0, 0.3, rng.uniform(0.1, 1)])) for g in (1, 2, 3) for v in range(4) for r in range(3 * v - 5, 3 * v + 9 * g) for c in range(v * g, v * g + 11)]
    frame = spark.createDataFrame([*rows, (4, 1, -70, 5, 9.0, 1.0), (4, 2, 33, -41, 7.0, 1.0)], "g long, v long, row int, col int, value double, weight double")
    found, joined = [], []
    by_joins = compositing._blended_by_joins
    monkeypatch.setattr(compositing, "_blended_by_joins", lambda *a: joined.append(1) or by_joins(*a))
    for cells, field in ((compositing.CELLS, compositing.FIELD), (compositing.CELLS, 1), (500, 1), (0, 1)):
        monkeypatch.setattr(compositing, "CELLS", cells)
        monkeypatch.setattr(compositing, "FIELD", field)
        found.append({(r.g, r.row, r.col): r.value for r in compositing.multiband(frame, "g", "v", 3).collect()})
        assert len(joined) == max(0, len(found) - 2)
    for other in found[:3]:
        assert other.keys() == found[3].keys() and all(abs(other[k] - x) < 1e-9 for k, x in found[3].items())
    assert len(found[0]) > 900
    monkeypatch.setattr(compositing, "CELLS", 10**6)
    bad = frame.unionByName(spark.createDataFrame([(5, 1, 0, 0, 9.0, 1.0), (5, None, 0, 1, 9.0, 1.0)], frame.schema))
    assert {r.g for r in compositing.multiband(bad, "g", "v", 3).collect()} == {1, 2, 3, 4, 5}


def test_tasks_stream_small_groups(spark):
    """groups of a partition cut anywhere by batches, without a call for each."""
    rng = random.Random(2)
    rows = [(g, k, rng.uniform(0, 50), rng.uniform(0, 50)) for g in range(60) for k in range(1 + g % 23)] + [(None, 1, 0.0, 0.0), (None, 2, 0.0, 0.0)]
    want = set()
    for g, i, x, y in rows:
        near = sorted((round(math.dist((x, y), (e, n)), 6), j) for h, j, e, n in rows if h == g is not None and j != i)
        want |= {(g, i, j, r + 1) for r, (d, j) in enumerate(near[:4]) if d < 30}
    frame = spark.createDataFrame(rows, "g long, id long, e double, n double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            df = proximity.nearest_within(frame, "g", "id", "e", "n", 30.0, 4)
            got = [(r.g, r.i, r.j, r["rank"]) for r in df.collect()]
            assert len(got) == len(set(got)) and set(got) == want
            assert "MapInPandas" in plan(df) and "CoGroup" not in plan(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_arrivals_bring_their_steps_along(spark):
    """no join by place and no distinct of all pairs."""
    rows = [(g, k * 3, float(k * 100 * (g == 2)), 0.0) for g in (1, 2) for k in range(20)]
    p = spark.createDataFrame(rows, "session long, frame_id long, east double, north double").withColumn("seq", F.col("frame_id") / 3 + 1)
    df = capture.arrival_candidates(p, 3, (1, 5))
    assert "Aggregate" not in plan(df) and "Join" not in plan(df)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    assert {(i, j) for g, i, j in got if g == 2} == {(i * 3, j * 3) for j in range(20) for i in range(j) if j - i in (1, 5)}
    assert {(i, j) for g, i, j in got if g == 1} >= {(i * 3, j * 3) for j in range(20) for i in range(j) if j - i in (1, 5) or i < 3}


def test_candidates_are_not_copied_for_each_cell(spark, monkeypatch):
    """what two captures both see is counted from one row of each."""
    made, settle = {}, live.settle
    monkeypatch.setattr(live, "settle", lambda df, name: made.update({name: plan(df)}) or settle(df, name))
    live.r17(spark, SF)
    assert "array_intersect" in made["links"] and not [x for x in made["links"].splitlines() if "Join" in x and "row#" in x]
