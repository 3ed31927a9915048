"""Folder watcher: new or changed deposits are trained, failures are retried.

Three append-only tables below the state folder keep what was seen, what was
processed and every status change. A deposit is pending while its latest file
time differs from the one last processed, so nothing is lost when a run fails,
falls into the cooldown, or the driver restarts.
"""

from __future__ import annotations

import datetime
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import fixedvalues as fv
from lodeworks.operators.files import deposit_files, deposit_of_folder
from lodeworks.sources.listing import LISTING_SCHEMA, list_files

SEEN = "deposit string, mtime timestamp, folder string"
DONE = "deposit string, mtime timestamp"
STATUS = (
    "status string, last_update timestamp, deposit string, cv_r2 double, roc_auc double,"
    " message string"
)
POLL = "10 seconds"


@dataclass
class Watcher:
    """Watches ``folder`` and calls ``job(deposit)`` for each changed deposit.

    A deposit is a folder right below ``folder`` with all files at any depth;
    ``folder_of`` gives its path, as its name is normalised. ``job`` returns a
    dict of metrics; an exception leaves the deposit pending.
    """

    spark: SparkSession
    folder: str
    state: str
    job: Callable[[str], dict]
    cooldown_seconds: int = fv.COOLDOWN_SECONDS
    _working: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.state}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(
            f"{self.state}/{name}")

    def publish(self, status: str, deposit: str | None = None, metrics: dict | None = None,
                message: str | None = None) -> None:
        m = metrics or {}
        now = datetime.datetime.now()
        self._append(
            "status", [(status, now, deposit, m.get("cv_r2"), m.get("roc_auc"), message)], STATUS)

    def statuses(self) -> DataFrame:
        return self._read("status", STATUS)

    def changed(self, files: DataFrame) -> DataFrame:
        """Latest file time per deposit, and its folder as it is written."""
        below = self.folder.split("://", 1)[-1].removeprefix("file:")
        below = "/" + below.strip("/") + "/"
        inner = F.substring_index(F.col("path"), below, -1)
        return (
            deposit_files(files).withColumn("folder", F.substring_index(inner, "/", 1))
            .filter(F.contains(inner, F.lit("/")) & F.contains("path", F.lit(below)))
            .groupBy(deposit_of_folder(F.col("folder")).alias("deposit"))
            .agg(F.max("mtime").alias("mtime"), F.max_by("folder", "mtime").alias("folder"))
        )

    def note(self, files: DataFrame) -> None:
        """Remember the latest file time of every deposit in a listing."""
        self.changed(files).coalesce(1).write.mode("append").parquet(f"{self.state}/seen")

    def pending(self) -> DataFrame:
        """Deposits whose latest file time is not the one last processed."""
        seen = self._read("seen", SEEN).groupBy("deposit").agg(F.max("mtime").alias("mtime"))
        done = self._read("processed", DONE).groupBy("deposit").agg(
            F.max("mtime").alias("done"))
        return seen.join(done, "deposit", "left").filter(
            ~F.col("mtime").eqNullSafe(F.col("done")))

    def folder_of(self, deposit: str) -> str:
        """Path of a deposit's folder."""
        seen = self._read("seen", SEEN).filter(F.col("deposit") == deposit)
        name = seen.agg(F.max_by("folder", "mtime")).first()[0]
        return f"{self.folder.rstrip('/')}/{name or deposit}"

    def cooling(self) -> bool:
        """Whether the last run, good or bad, ended less than the cooldown ago."""
        last = self.statuses().filter("status IN ('ready', 'error')").agg(F.max("last_update")).first()[0]
        if last is None:
            return False
        return (datetime.datetime.now() - last).total_seconds() < self.cooldown_seconds

    def work_off(self) -> list[str]:
        """Run the job for pending deposits; returns those that succeeded.

        The loop is over deposit names; each job is itself distributed. One call
        works at a time; a second one leaves at once.
        """
        if not self._working.acquire(blocking=False):
            return []
        try:
            return self._work_off()
        finally:
            self._working.release()

    def _work_off(self) -> list[str]:
        finished = []
        for row in self.pending().orderBy("deposit").collect():
            if self.cooling():
                break
            self.publish("training", row["deposit"])
            try:
                metrics = self.job(row["deposit"])
            except Exception as error:  # noqa: BLE001 - any failure keeps it pending
                self.publish("error", row["deposit"], message=str(error)[:500])
                continue
            self._append("processed", [(row["deposit"], row["mtime"])], DONE)
            self.publish("ready", row["deposit"], metrics)
            finished.append(row["deposit"])
        return finished

    def reconcile(self) -> list[str]:
        """Batch pass over the whole folder: also finds files edited in place."""
        self.note(list_files(self.spark, self.folder))
        return self.work_off()

    def watch(self, checkpoint: str, poll_seconds: float = 10.0, **trigger) -> None:
        """Stream new files and retry what is pending until the stream ends."""
        query = self.start(checkpoint, **trigger)
        try:
            while not query.awaitTermination(poll_seconds):
                self.work_off()
        finally:
            query.stop()
            self.publish("stopped")

    def start(self, checkpoint: str, **trigger):
        """Stream new files; every batch works off what is pending."""
        files = (
            self.spark.readStream.format("binaryFile").schema(LISTING_SCHEMA)
            .option("recursiveFileLookup", True).load(self.folder)
            .select(
                F.regexp_replace("path", "^file:/+", "/").alias("path"), "length",
                F.col("modificationTime").alias("mtime"))
        )

        def batch(rows: DataFrame, _number: int) -> None:
            self.note(rows)
            self.work_off()

        return (
            files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": POLL})).start()
        )
