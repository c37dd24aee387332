import os

import pytest

from stemma.streaming import jobs


def test_micro_batches_add_up(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 24:02d}:{k % 60:02d}:00", k % 5, "a" if k % 2 else "b", float(k), "{}") for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props")
    df.repartition(7).write.parquet(f"{tmp_path}/events.parquet/part")
    stream = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/events.parquet/part").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props")
    got = {r.user_id: (r.n, r.total, r.greatest) for r in jobs.finished(jobs.user_totals(stream), "complete", "t").collect()}
    assert got == {u: (40, float(sum(k for k in range(200) if k % 5 == u)), 195.0 + u) for u in range(5)}
    steps = jobs.minibatch_average(stream)
    assert len(steps) == 4 and [k for k, _ in steps] == [0, 1, 2, 3] and 0 < steps[-1][1] < 200


def test_events_of_part_files_of_one_file_and_of_none(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 24:02d}:00:00", k % 3, "a", float(k), "{}") for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props")
    df.repartition(5).write.parquet(f"{tmp_path}/parts/events.parquet")
    df.coalesce(1).write.parquet(f"{tmp_path}/made")
    os.mkdir(f"{tmp_path}/single")
    (part,) = (f for f in os.listdir(f"{tmp_path}/made") if f.endswith(".parquet"))
    os.rename(f"{tmp_path}/made/{part}", f"{tmp_path}/single/events.parquet")
    for folder in ("parts", "single"):
        got = {r.user_id: (r.n, r.total) for r in jobs.finished(jobs.user_totals(jobs.events(spark, f"{tmp_path}/{folder}")), "complete", "t").collect()}
        assert got == {u: (20, float(sum(range(u, 60, 3)))) for u in range(3)}
    with pytest.raises(Exception, match="FileNotFound"):
        jobs.events(spark, f"{tmp_path}/made")
