"""Emission of races whose lanes come in several batches."""

from lanecast.streaming import streams


def test_lanes_of_two_batches_make_a_race(spark, tmp_path):
    rows = lambda lanes: spark.createDataFrame([(2, str(k)) for k in lanes], "race_id long, combination string")
    write, path = streams.emit_once(str(tmp_path / "emitted"), "v1"), str(tmp_path / "emitted")
    write(rows(range(1, 6)), 0)
    assert streams.predicted(spark, path).count() == 0
    for _ in range(2):
        write(rows([6]), 1)
    write(rows([1, 6]), 2)
    assert [r["race_id"] for r in streams.predicted(spark, path).collect()] == [2]
