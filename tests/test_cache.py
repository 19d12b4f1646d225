"""The keyed cache: last entries, negative entries, filters, killed writers, compaction."""

import pytest

from terraweft.sources import cache

KEYS, PAYLOAD = "a long, b string", "x double, n int"


def opened(spark, tmp_path):
    return cache.KeyedCache(spark, str(tmp_path / "c"), KEYS, PAYLOAD, buckets=4)


def rows(df):
    return {(r.a, r.b): (r.x, r.n, r.found) for r in df.collect()}


def test_last_entry_wins_and_negative_ones_are_kept(spark, tmp_path):
    keys = spark.createDataFrame([(k, "p") for k in range(8)], KEYS)
    entries = lambda *rows: spark.createDataFrame(rows, f"{KEYS}, {PAYLOAD}")
    c = opened(spark, tmp_path)
    assert not any(found for *_, found in rows(c.lookup(keys)).values()) and c.absent(keys).count() == 8
    c.put(entries((0, "p", 1.0, 1), (1, "p", None, None), (2, "q", 5.0, 1)))
    c.put(entries((0, "p", 2.0, 2), (3, "p", None, 2)))
    c.put(entries().limit(0))
    want = {(0, "p"): (2.0, 2, True), (1, "p"): (None, None, True), (3, "p"): (None, 2, True)} | {(k, "p"): (None, None, False) for k in (2, 4, 5, 6, 7)}
    assert rows(c.lookup(keys)) == want == rows(opened(spark, tmp_path).lookup(keys))
    assert {r.a for r in opened(spark, tmp_path).absent(keys).collect()} == {2, 4, 5, 6, 7}
    c.compact()
    assert len(c.segments) == 1 and rows(opened(spark, tmp_path).lookup(keys)) == want
    assert len(list((tmp_path / "c" / "segments").iterdir())) == 1


def test_filters_skip_segments(spark, tmp_path):
    c = opened(spark, tmp_path)
    for k in range(4):
        c.put(spark.createDataFrame([(1000 * k + n, "s", 0.0, k) for n in range(50)], f"{KEYS}, {PAYLOAD}"))
    asked = spark.createDataFrame([(2003, "s"), (2007, "s"), (77_777, "s")], KEYS)
    assert list(c.candidates(asked)) == [c.segments[2]]
    assert {k: v[1] for k, v in rows(c.lookup(asked)).items()} == {(2003, "s"): 2, (2007, "s"): 2, (77_777, "s"): None}
    every = c.candidates(spark.createDataFrame([(1000 * k + n, "s") for k in range(4) for n in range(50)], KEYS))
    assert list(every) == c.segments and all(b == [0, 1, 2, 3] for b in every.values())


def test_killed_writer_leaves_the_last_state(spark, tmp_path, monkeypatch):
    c = opened(spark, tmp_path)
    c.put(spark.createDataFrame([(1, "p", 1.0, 1)], f"{KEYS}, {PAYLOAD}"))

    def killed(self, segments):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(cache.KeyedCache, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            opened(spark, tmp_path).put(spark.createDataFrame([(1, "p", 9.0, 9), (2, "p", 9.0, 9)], f"{KEYS}, {PAYLOAD}"))
    (tmp_path / "c" / "states" / "draft-lost").write_text("[")
    keys = spark.createDataFrame([(1, "p"), (2, "p")], KEYS)
    assert rows(opened(spark, tmp_path).lookup(keys)) == {(1, "p"): (1.0, 1, True), (2, "p"): (None, None, False)}
    c.put(spark.createDataFrame([(2, "p", 3.0, 3)], f"{KEYS}, {PAYLOAD}"))
    assert rows(opened(spark, tmp_path).lookup(keys))[2, "p"] == (3.0, 3, True)
