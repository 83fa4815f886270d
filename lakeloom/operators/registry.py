"""A registry of model versions: an append-only log a model, from which stages follow."""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import evaluate
from lakeloom.operators.boosting import TreeModel
from lakeloom.sources.commits import CommitLog

_ENTRY = "name string, version int, run_id string, auc double, metrics map<string,double>, bundle string"


class ModelRegistry:
    """Models by name under a folder. Versions are never changed; which is in production is derived."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self.path = spark, path.rstrip("/")

    def _log(self, name: str) -> CommitLog:
        if not name:
            raise ValueError("a model needs a name")
        return CommitLog(self._spark, f"{self.path}/versions/{quote(name, safe='')}")

    def register(self, name: str, auc: float | None, model: TreeModel | None = None, run_id: str | None = None, **metrics: float) -> int:
        """A new version of a model, with its number; several writers at once get numbers of their own.

        The model is saved first, so a version never names a bundle that is not there.
        """
        bundle = None
        if model is not None:
            bundle = f"{self.path}/bundles/{uuid.uuid4().hex}"
            model.save(self._spark, bundle)
        log = self._log(name)
        while True:
            n = log.last() + 1
            if log.put(n, {"name": name, "version": n, "run_id": run_id, "auc": auc, "metrics": metrics, "bundle": bundle}):
                return n

    def names(self) -> list[str]:
        p = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = p.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(unquote(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def versions(self, name: str | None = None) -> DataFrame:
        """name, version, run_id, auc, metrics, bundle of every version, or of one model's."""
        known = self.names()
        paths = [f"{self.path}/versions/{quote(n, safe='')}" for n in (known if name is None else [name]) if n in known]
        return self._spark.read.schema(_ENTRY).json(paths) if paths else self._spark.createDataFrame([], _ENTRY)

    def stages(self, name: str | None = None) -> DataFrame:
        """versions() with promoted and stage: Production, Archived or None."""
        return evaluate.promotion(self.versions(name))

    def latest(self, name: str, stage: str = "Production") -> Row | None:
        """The highest version of a model in a stage."""
        s = self.stages(name).where(F.col("stage") == stage)
        return s.groupBy("name").agg(F.max_by(F.struct(*s.columns), "version").alias("v")).select("v.*").first()

    def model(self, name: str, stage: str = "Production") -> TreeModel:
        """The model of the latest version in a stage; an error if there is none or it has no bundle."""
        v = self.latest(name, stage)
        if v is None or v.bundle is None:
            raise LookupError(f"{name} has no model in stage {stage}")
        return TreeModel.load(self._spark, v.bundle)

    def score(self, rows: DataFrame, name: str, stage: str = "Production", threshold: float = 0.5) -> DataFrame:
        """rows with probability and prediction by the model in a stage; all of it is an expression of the scan."""
        return scored(rows, self.model(name, stage), threshold)


def scored(rows: DataFrame, model: TreeModel, threshold: float = 0.5) -> DataFrame:
    """rows with the model's probability, and the prediction at the threshold."""
    d = rows.withColumn("probability", model.prediction())
    return d.withColumn("prediction", above(F.col("probability"), threshold))


def above(p: Column, threshold: float) -> Column:
    return (p >= threshold).cast("int")
