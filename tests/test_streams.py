"""State with time to live, progress as a table, late rows: small streams with restarts and failures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import state
from corpusloom.streaming.daily import run_daily_stream, stream_of
from corpusloom.streaming.progress import ProgressTable

START = datetime(2024, 3, 1)
SCHEMA = "key string, request long, at timestamp, value string"


def put(spark, folder, name, rows):
    """One file of requests (key, request, minutes, value)."""
    df = spark.createDataFrame([(k, r, START + timedelta(minutes=m), v) for k, r, m, v in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, work, trigger={"availableNow": True}, **options):
    requests = stream_of(spark, str(folder), 1)
    q = state.answered(requests, 3_600_000, **options).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(**trigger).start()
    q.awaitTermination()
    return {(r.request, r.key, r.found, r.value) for r in spark.read.schema(state.ANSWERS).parquet(f"{work}/out").collect()}


def test_entries_expire_and_recur_over_a_restart(spark, tmp_path):
    asked, work = tmp_path / "asked", tmp_path / "work"
    put(spark, asked, 1, [("a", 1, 0, "x"), ("a", 2, 30, "y"), ("b", 3, 40, "z")])
    first = run(spark, asked, work)
    assert first == {(1, "a", "miss", "x"), (2, "a", "hit", "x"), (3, "b", "miss", "z")}
    put(spark, asked, 2, [("b", 4, 50, "q"), ("c", 5, 200, "c")])  # b is found by the state of the first run
    put(spark, asked, 3, [("a", 6, 210, "n"), ("a", 7, 211, "m")])
    put(spark, asked, 4, [("a", 8, 20, "late")])  # behind the watermark
    second = run(spark, asked, work) - first
    assert {x for x in second if x[0] > 0} == {(4, "b", "hit", "z"), (5, "c", "miss", "c"), (6, "a", "miss", "n"), (7, "a", "hit", "n")}
    assert {(k, f, v) for r, k, f, v in second if r < 0} == {("b", "expired", "z")}  # a's was void and is replaced


def test_use_puts_the_end_off(spark, tmp_path):
    asked = tmp_path / "asked"
    put(spark, asked, 1, [("a", 1, 0, "x"), ("a", 2, 50, "y"), ("a", 3, 100, "z"), ("a", 4, 170, "w")])
    by = lambda **o: {(r, f) for r, _, f, _ in run(spark, asked, tmp_path / str(o), **o) if r > 0}
    assert by(by_use=True) == {(1, "miss"), (2, "hit"), (3, "hit"), (4, "miss")}
    assert by() == {(1, "miss"), (2, "hit"), (3, "miss"), (4, "miss")}


def test_time_to_live_by_the_clock(spark, tmp_path):
    asked = tmp_path / "asked"
    put(spark, asked, 1, [("a", 1, 0, "x"), ("a", 2, 500, "y"), ("b", 3, 0, None)])
    assert run(spark, asked, tmp_path / "work", {"once": True}, late=None) == {(1, "a", "miss", "x"), (2, "a", "hit", "x"), (3, "b", "miss", None)}


@pytest.fixture
def listener(spark):
    made = ProgressTable()
    spark.streams.addListener(made)
    yield made
    spark.streams.removeListener(made)


def two_batches(spark, tmp_path, each, name):
    for i in range(2):
        spark.range(i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return rows.writeStream.queryName(name).foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()


def test_progress_of_two_batches_and_of_a_failure(spark, listener, tmp_path):
    q = two_batches(spark, tmp_path / "good", lambda df, n: df.write.format("noop").mode("overwrite").save(), "good")
    q.awaitTermination()
    assert listener.wait(q.runId)

    def fail(df, n):
        if n == 1:
            raise ValueError("second batch")

    bad = two_batches(spark, tmp_path / "bad", fail, "bad")
    with pytest.raises(Exception, match="second batch"):
        bad.awaitTermination()
    assert listener.wait(bad.runId)
    rows = listener.table(spark)
    events = lambda name: [(r.event, r.batch) for r in rows.where(F.col("name") == name).orderBy("seq").collect() if r.event in ("start", "running", "done", "finished", "failed")]
    assert events("good") == [("start", None), ("running", 0), ("done", 0), ("running", 1), ("done", 1), ("finished", None)]
    assert events("bad") == [("start", None), ("running", 0), ("done", 0), ("failed", None)]
    assert sorted(r.rows for r in rows.where("name = 'good' and event = 'done'").collect()) == [1, 2]
    assert rows.where("event = 'failed'").first().error
    listener.write(spark, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == rows.count() and not listener.rows


def test_days_behind_the_watermark_take_no_late_rows(spark, tmp_path):
    def day(d, n, kind="view"):
        return spark.createDataFrame([(i, START + timedelta(days=d, minutes=i), kind, 1.0) for i in range(n)], "event_id long, ts timestamp, event_type string, value double").coalesce(1)

    path = str(tmp_path / "in")
    for d, n in ((0, 3), (1, 2), (0, 1), (9, 1), (20, 1), (0, 5), (19, 2)):  # the second day 0 is late but within two days, the third is not
        day(d, n).write.mode("append").parquet(path)
    import os
    import time

    for i, f in enumerate(sorted((p for p in (tmp_path / "in").iterdir() if p.suffix == ".parquet"), key=lambda p: p.stat().st_mtime_ns)):
        os.utime(f, (time.time() - 100 + i, time.time() - 100 + i))
    got = {(r.day, r.n) for r in run_daily_stream(spark, path, str(tmp_path / "work")).collect()}
    assert got == {("2024-03-01", 4), ("2024-03-02", 2), ("2024-03-10", 1), ("2024-03-21", 1), ("2024-03-20", 2)}
