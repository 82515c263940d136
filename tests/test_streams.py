"""Streams fed one file at a time: bounded state, sessions, emission and reconciliation that may run again."""

import datetime as dt

from pyspark.sql import functions as F

from lanecast.functions import pricing
from lanecast.operators import windows
from lanecast.streaming import streams


def feed(spark, tmp_path, batches, schema, build, sink, mode):
    """Writes a file, runs the stream to its end with the same checkpoint, and so on; the state's rows after each."""
    source, held = str(tmp_path / "source"), []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else 0)
    return held


def test_latest_quotes_hold_no_more_than_a_span(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    races = {k: start + dt.timedelta(hours=3 * k + 1) for k in range(8)}  # deadlines three hours apart
    batches = [[(k, "win", str(c), 2.0 + c + n / 100, races[k] - dt.timedelta(minutes=lead)) for c in range(1, 7) for n, lead in enumerate((70, 15, 12, 4))] for k in races]
    schedule = spark.createDataFrame(list(races.items()), "race_id long, deadline timestamp")
    out = str(tmp_path / "out")
    build = lambda s: streams.latest(streams.in_rounds(s.withWatermark("observed_at", "10 minutes"), schedule, pricing.rounds(spark)))
    held = feed(spark, tmp_path, batches, streams.QUOTES, build, streams.append_batches(out), "update")
    keys = ["race_id", "bet_type", "combination", "round"]
    got = {tuple(r[k] for k in keys): r["odds"] for r in streams.latest_of(spark.read.parquet(out), keys).collect()}
    want = {(k, "win", str(c), name): 2.0 + c + n / 100 for k in races for c in range(1, 7) for name, n in (("t-60", 0), ("t-10", 2), ("t-2", 3))}
    assert got == want
    assert max(held) <= 2 * 18 and len(want) == 144  # state holds two races' keys at most, however many went by


def test_sessions_by_stream_are_those_of_the_batch(spark, tmp_path):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(1, day(0), 1), (1, day(1), 2), (2, day(1), 4), (1, day(4), 3), (1, day(5), 1), (2, day(6), 5), (1, day(6), None), (1, day(7), 2), (2, day(7), 1), (1, day(12), 2)]
    schema, out = "venue long, day date, counter long", str(tmp_path / "out")
    held = feed(spark, tmp_path, [rows[:3], rows[3:5][::-1], rows[5:8], rows[8:]], schema, streams.series_sessions, streams.append_batches(out), "append")
    want = windows.series_sessions(spark.createDataFrame(rows, schema), "venue", "day", "counter").select("venue", "day", "session").collect()
    got = spark.read.parquet(out).select("venue", "day", "session").collect()
    assert sorted(map(tuple, got)) == sorted((r["venue"], r["day"], r["session"]) for r in want) and held[-1] == 2


def test_races_of_several_batches_are_emitted_once(spark, tmp_path):
    lanes = lambda *pairs: spark.createDataFrame([(r, str(k)) for r, ks in pairs for k in ks], "race_id long, combination string")
    path = str(tmp_path / "emitted")
    write = streams.emit_once(path, "v1")
    write(lanes((1, range(1, 7)), (2, range(1, 5))), 0)
    for _ in range(2):  # run again after a failure
        write(lanes((2, (5, 6)), (3, (1,))), 1)
    write(lanes((1, range(1, 7)), (2, (6,)), (3, range(2, 7))), 2)
    assert sorted(r["race_id"] for r in streams.predicted(spark, path).collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{path}-open-v1/2").count() == 0


def test_a_replayed_batch_isnt_doubled(spark, tmp_path):
    path, out = str(tmp_path / "archive"), str(tmp_path / "live")
    streams.archive(spark.range(0, 100, 2).select(F.col("id").alias("race_id")), path)
    write = streams.reconcile(path, out)
    for batch_id in (0, 0, 1):
        write(spark.createDataFrame([(batch_id * 2, "x"), (batch_id * 2 + 1, "y"), (batch_id * 2 + 1, "z")], "race_id long, state string"), batch_id)
    assert sorted((r["race_id"], r["state"]) for r in spark.read.parquet(out).collect()) == [(1, "y"), (1, "z"), (3, "y"), (3, "z")]
