"""Watcher and interval stream with available-now triggers."""

import os
import threading
import time

from pyspark.sql import functions as F

from lodeworks.streaming import assay_stream
from lodeworks.streaming.watcher import Watcher


def once(watcher, checkpoint):
    watcher.start(checkpoint, availableNow=True).awaitTermination()


def test_watcher(spark, tmp_path):
    folder, state, checkpoint = (tmp_path / n for n in ("drops", "state", "checkpoint"))
    (folder / "Dep A").mkdir(parents=True)
    runs, broken = [], {"dep_b"}

    def job(deposit):
        runs.append(deposit)
        if deposit in broken:
            raise RuntimeError("no collar")
        return {"cv_r2": 0.5, "roc_auc": 0.9}

    watcher = Watcher(spark, str(folder), str(state), job, cooldown_seconds=0)
    (folder / "Dep A" / "a.csv").write_text("x\n")
    (folder / "Dep A" / "ignored.pdf").write_text("x")
    once(watcher, str(checkpoint))
    assert runs == ["dep_a"]
    once(watcher, str(checkpoint))  # nothing new
    assert runs == ["dep_a"]
    time.sleep(1.1)
    (folder / "Dep A" / "b.csv").write_text("x\n")
    once(watcher, str(checkpoint))
    assert runs == ["dep_a", "dep_a"]

    (folder / "dep-b").mkdir()
    (folder / "dep-b" / "c.csv").write_text("x\n")
    once(watcher, str(checkpoint))
    assert runs[2:] == ["dep_b"]
    assert [r["deposit"] for r in watcher.pending().collect()] == ["dep_b"]
    broken.clear()
    assert watcher.work_off() == ["dep_b"]  # the failed one is tried again
    assert watcher.pending().isEmpty()

    os.utime(folder / "Dep A" / "a.csv", (time.time() + 60, time.time() + 60))
    once(watcher, str(checkpoint))  # an edit in place is not streamed again
    assert len(runs) == 4
    assert watcher.reconcile() == ["dep_a"]
    assert watcher.reconcile() == []
    kinds = [r["status"] for r in watcher.statuses().orderBy("last_update").collect()]
    assert kinds.count("ready") == 4 and kinds.count("error") == 1

    slow = Watcher(spark, str(folder), str(state), job, cooldown_seconds=3600)
    (folder / "dep-c").mkdir()
    (folder / "dep-c" / "d.csv").write_text("x\n")
    assert slow.reconcile() == []  # cooling down: stays pending
    assert [r["deposit"] for r in slow.pending().collect()] == ["dep_c"]


def test_interval_stream_with_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = ("hole_id string, fromdepth double, todepth double, ceo2_ppm double,"
              " la2o3_ppm double, at timestamp")

    def drop(rows):
        spark.createDataFrame(rows, "hole_id string, fromdepth double, todepth double,"
                              " ceo2_ppm double, la2o3_ppm double, t string").select(
            "*", F.to_timestamp("t").alias("at")).drop("t").coalesce(1).write.mode(
            "append").parquet(source)

    def advance():
        rows = spark.readStream.schema(schema).parquet(source)
        unique = assay_stream.without_repeats(rows, "at", "1 hour")
        assay_stream.start(
            assay_stream.hole_updates(unique.drop("at")), str(tmp_path / "holes"),
            str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
        return {r["hole_id"]: r for r in assay_stream.current_holes(
            spark, str(tmp_path / "holes")).collect()}

    drop([("h1", 0.0, 5.0, 10.0, None, "2024-01-01 00:00:00"),
          ("h2", 0.0, 2.0, None, None, "2024-01-01 00:00:00")])
    first = advance()
    assert first["h1"]["treo_max"] == 10.0 and first["h2"]["treo_max"] is None
    drop([("h1", 0.0, 5.0, 10.0, None, "2024-01-01 00:10:00"),
          ("h1", 5.0, 9.0, 20.0, 10.0, "2024-01-01 00:10:00")])
    second = advance()
    assert second["h1"]["treo_max"] == 30.0 and second["h1"]["treo_mean"] == 20.0
    assert second["h1"]["intervals"] == 2 and second["h2"]["intervals"] == 1


def test_watching_trains_every_deposit_without_help(spark, tmp_path):
    """Deposits are top folders; what cools down or fails is retried."""
    folder = tmp_path / "in"
    for name in ("Dep A/sub", "dep-b"):
        (folder / name).mkdir(parents=True)
        (folder / name / "x.csv").write_text("a\n1\n")
    (folder / "loose.csv").write_text("a\n1\n")
    calls = []

    def job(deposit):
        calls.append(deposit)
        if calls.count(deposit) == 1 and deposit == "dep_b":
            raise RuntimeError("first time")
        return {}

    watcher = Watcher(spark, str(folder), str(tmp_path / "state"), job, cooldown_seconds=1)
    stream = threading.Thread(
        target=watcher.watch, args=(str(tmp_path / "checkpoint"), 1.0), daemon=True)
    stream.start()
    until = time.time() + 120
    while time.time() < until and not watcher.pending().isEmpty() or not calls:
        time.sleep(1)
    for query in spark.streams.active:
        query.stop()
    stream.join(60)
    assert sorted(set(calls)) == ["dep_a", "dep_b"] and calls.count("dep_b") == 2
    assert watcher.folder_of("dep_a") == f"{folder}/Dep A"
    assert watcher.folder_of("dep_b") == f"{folder}/dep-b"
    assert watcher.pending().isEmpty()
    assert watcher.statuses().filter("status = 'stopped'").count() == 1
