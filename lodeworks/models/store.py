"""Versioned model bundles and the append-only registry."""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeworks.models.ensemble import Ensemble
from lodeworks.operators.versions import content_hash

REGISTRY = (
    "deposit string, trained_at timestamp, version string, model_path string, n_holes long,"
    " cv_r2 double, roc_auc double, is_global boolean"
)
GLOBALS = "version string, marked_at timestamp"
METADATA = (
    "version string, trained_at timestamp, deposit string, deposits array<string>,"
    " features array<string>, names array<string>, n_holes long, p95 double, cv_r2 double,"
    " roc_auc double, rmse double, confidence double, model_scores map<string,double>,"
    " weights map<string,double>, digest string, previous_version string,"
    " delta_r2 double, delta_holes long"
)


@dataclass
class Bundle:
    """A stored ensemble, its metadata row and where its training rows are."""

    ensemble: Ensemble
    info: Row
    path: str

    def training_rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/training")


def new_version() -> tuple[str, datetime.datetime]:
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    return f"{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}", now


def save_bundle(
    spark: SparkSession, root: str, deposit: str, ensemble: Ensemble, training: DataFrame,
    p95: float, deposits: list[str], previous: Bundle | None = None,
) -> Bundle:
    """Write one new version below ``root``; earlier versions are never touched.

    ``training`` holds hole_id, deposit, raw treo and the features.
    """
    version, trained_at = new_version()
    path = f"{root.rstrip('/')}/bundles/{deposit}/{version}"
    training.write.parquet(f"{path}/training")
    stored = spark.read.parquet(f"{path}/training")
    digest = content_hash(stored, ["hole_id", *ensemble.features]).first()
    ensemble.preparation.write().save(f"{path}/preparation")
    for name, model in ensemble.models.items():
        model.write().save(f"{path}/models/{name}")
    ensemble.stacker.write().save(f"{path}/stacker")
    m = ensemble.metrics
    before = previous.info if previous else None
    row = (
        version, trained_at, deposit, deposits, ensemble.features, ensemble.names,
        digest["rows"], float(p95), m["cv_r2"], m["roc_auc"], m["rmse"], m["confidence"],
        m["model_scores"], m["weights"], digest["digest"],
        before["version"] if before else None,
        m["cv_r2"] - before["cv_r2"] if before else None,
        digest["rows"] - before["n_holes"] if before else None,
    )
    # The metadata is written last, so a bundle without it is unfinished.
    spark.createDataFrame([row], METADATA).coalesce(1).write.parquet(f"{path}/metadata")
    return load_bundle(spark, path)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    info = spark.read.schema(METADATA).parquet(f"{path}/metadata").first()
    models = {n: PipelineModel.load(f"{path}/models/{n}") for n in info["names"]}
    ensemble = Ensemble(
        list(info["features"]), PipelineModel.load(f"{path}/preparation"), models,
        LinearRegressionModel.load(f"{path}/stacker"),
        {
            "cv_r2": info["cv_r2"], "roc_auc": info["roc_auc"], "rmse": info["rmse"],
            "confidence": info["confidence"], "model_scores": dict(info["model_scores"]),
            "weights": dict(info["weights"]),
        },
    )
    return Bundle(ensemble, info, path)


def is_compatible(bundle: Bundle | None, features: list[str]) -> bool:
    """A stored model can be reused only for exactly the same ordered features."""
    return bundle is not None and bundle.ensemble.features == list(features)


class Registry:
    """Append-only tables below ``root``: trained versions, and marks of the global one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/registry"
        self.marks_path = f"{root.rstrip('/')}/globals"

    def table(self) -> DataFrame:
        return self._read(self.path, REGISTRY)

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, row) -> None:
        self.spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").parquet(
            self.path)

    def register(self, bundle: Bundle, make_global: bool = True) -> None:
        i = bundle.info
        self._append((
            i["deposit"], i["trained_at"], i["version"], bundle.path, i["n_holes"],
            round(i["cv_r2"], 4), round(i["roc_auc"], 4), make_global,
        ))

    def set_global(self, version: str) -> None:
        """Make an earlier version the global model; the versions stay as they are."""
        if self.table().filter(F.col("version") == version).isEmpty():
            raise ValueError(f"unknown version {version}")
        self.spark.createDataFrame([(version, new_version()[1])], GLOBALS).coalesce(1).write.mode(
            "append").parquet(self.marks_path)

    def deposits(self) -> list[str]:
        return sorted(r[0] for r in self.table().select("deposit").distinct().collect())

    def latest_path(self, deposit: str | None = None) -> str | None:
        """Newest bundle of the deposit, else the one marked or trained as global last."""
        marks = self._read(self.marks_path, GLOBALS).groupBy("version").agg(
            F.max("marked_at").alias("marked_at"))
        trained = F.when(F.col("is_global"), F.col("trained_at"))
        rows = self.table().join(marks, "version", "left").withColumn(
            "_global_at", F.greatest("marked_at", trained))

        def newest(chosen, order):
            return F.max_by(
                F.when(chosen, F.col("model_path")), F.when(chosen, F.struct(order, "version")))

        found = rows.agg(
            newest(F.col("deposit") == F.lit(deposit), "trained_at").alias("own"),
            newest(F.col("_global_at").isNotNull(), "_global_at").alias("shared"),
        ).first()
        return found["own"] or found["shared"]

    def latest_bundle(self, deposit: str | None = None) -> Bundle | None:
        path = self.latest_path(deposit)
        return load_bundle(self.spark, path) if path else None
