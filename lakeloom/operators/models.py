"""Scorecard and house-price models on Spark ML, with exact preparation in SQL expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.prep import constant_impute, fit_scaler, median_impute, standardize, target_encode
from lakeloom.operators.ranking import exact_medians
from lakeloom.scratch import cut, fresh


@dataclass(frozen=True)
class Preparation:
    """Medians and scales fitted on training rows; transform() adds the vector ``features``."""

    cols: list[str]
    medians: dict[str, float | None]
    scales: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        z = standardize(median_impute(df, self.cols, self.medians), self.cols, self.scales)
        return VectorAssembler(inputCols=self.cols, outputCol="features").transform(z)

    def to_json(self) -> str:
        return json.dumps({"cols": self.cols, "medians": self.medians, "scales": self.scales})

    @classmethod
    def from_json(cls, text: str) -> Preparation:
        x = json.loads(text)
        return cls(x["cols"], x["medians"], {k: tuple(v) for k, v in x["scales"].items()})


def fit_preparation(train: DataFrame, cols: list[str]) -> Preparation:
    m = exact_medians(train, cols)
    return Preparation(list(cols), m, fit_scaler(median_impute(train, cols, m), cols))


def component_count(ratios: list[float], limit: float = 0.95) -> int:
    """The first count whose cumulative ratio reaches the limit, else all of them."""
    total = 0.0
    for i, r in enumerate(ratios, 1):
        total += r
        if total >= limit:
            return i
    return len(ratios)


def pca_variance(df: DataFrame, max_components: int = 3) -> DataFrame:
    """(component, ratio, cumulative, used) of the leading components of ``features``."""
    m = PCA(k=max_components, inputCol="features", outputCol="components").fit(df)
    ratios = [float(x) for x in m.explainedVariance]
    used = component_count(ratios)
    rows, total = [], 0.0
    for i, r in enumerate(ratios, 1):
        total += r
        rows.append((i, round(r, 6), round(total, 6), i <= used))
    return df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double, used boolean")


def fit_pca(df: DataFrame, max_components: int = 3) -> PCAModel:
    """A PCA model of as many components as the variance rule asks for."""
    k = min(max_components, len(df.first()["features"]))
    first = PCA(k=k, inputCol="features", outputCol="components").fit(df)
    need = component_count([float(x) for x in first.explainedVariance])
    return first if need == k else PCA(k=need, inputCol="features", outputCol="components").fit(df)


@dataclass(frozen=True)
class Blocks:
    """A fitted input of models: prepared numbers, perhaps as principal components, and encoded categories."""

    numeric: Preparation
    pca: PCAModel | None
    encodings: dict[str, DataFrame]
    mean: float

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the vector ``features``; a category not seen in training has the mean of all."""
        d = self.numeric.transform(df)
        parts = ["features"]
        if self.pca is not None:
            d, parts = self.pca.transform(d), ["components"]
        for c, e in self.encodings.items():
            value, coded = fresh(d, "_value"), fresh(d, f"_{c}")
            seen = e.select(F.col(c).alias(value), F.col("encoded").alias(coded))
            d = d.join(seen, F.coalesce(F.col(c), F.lit("missing")) == F.col(value), "left").drop(value).fillna(self.mean, [coded])
            parts.append(coded)
        if parts != ["features"]:
            every = fresh(d, "_all")
            d = VectorAssembler(inputCols=parts, outputCol=every).transform(d)
            d = d.drop("features", *parts).withColumnRenamed(every, "features")
        return d


def fit_blocks(train: DataFrame, numeric: list[str], categorical: list[str] = (), label: str = "label", components: int | None = None) -> Blocks:
    """Numbers imputed and scaled, and with ``components`` reduced to at most so many; nulls of categories become a value, and values their encoded mean."""
    p = fit_preparation(train, numeric)
    pca = fit_pca(p.transform(train), components) if components else None
    e = {c: cut(target_encode(constant_impute(train, [c]), c, label), "encoding") for c in categorical}
    return Blocks(p, pca, e, float(train.agg(F.avg(label)).first()[0] or 0.0) if categorical else 0.0)


def balanced(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """df with ``weight``: rows over twice the rows of the class; and how many rows."""
    c = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")).first()
    n, p = c.n, c.p or 0
    return df.withColumn("weight", F.when(F.col(label) == 1, n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1)))), n


#: Rows that are worth a task of their own in a fit, and rows that one task takes at most, about.
FEW, MANY = 25_000, 1_000_000


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as its rows can keep busy; one that has them, or has few rows, as it is.

    A table of numbers is small as a file, so that Spark reads millions of rows in a task or
    two, and a fit goes over them some hundred times.
    """
    n = df.count()
    want = max(-(-n // MANY), min(-(-n // FEW), 2 * df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(want) if want > 1 and want > df.rdd.getNumPartitions() else df


def fit_logistic(df: DataFrame, label: str, c: float = 1.0, features: str = "features") -> PipelineModel:
    """L2 logistic regression with balanced weights; their sum is the number of rows."""
    weighted, n = balanced(dealt(df), label)
    lr = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * max(n, 1)), maxIter=1000)
    return Pipeline(stages=[lr]).fit(weighted)


def fit_boosted(df: DataFrame, label: str, trees: int = 100, features: str = "features") -> PipelineModel:
    """Boosted trees of the same family as gradient-boosting libraries; numbers are not the same."""
    g = GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=4, stepSize=0.1, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=42)
    return Pipeline(stages=[g]).fit(dealt(df))


def fit_regression(df: DataFrame, cols: list[str], target: str, trees: int = 100) -> PipelineModel:
    g = GBTRegressor(featuresCol="features", labelCol=target, maxIter=trees, maxDepth=6, stepSize=0.1, lossType="squared", seed=42)
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), g]).fit(dealt(df))


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with the probability of class 1 and the prediction at the threshold."""
    p = fresh(df, "_p")
    out = model.transform(df).withColumn(p, vector_to_array("probability")[1]).drop("probability", "prediction", "rawPrediction")
    return out.withColumn("probability", F.col(p)).withColumn("prediction", (F.col(p) >= threshold).cast("int")).drop(p)


def save_bundle(path: str, preparation: Preparation, model: PipelineModel, best: str) -> None:
    """The model's folder and a manifest beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(preparation.to_json(), best)], "preparation string, best_model string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> tuple[Preparation, PipelineModel, str]:
    row = spark.read.schema("preparation string, best_model string").json(f"{path}/manifest").first()
    return Preparation.from_json(row.preparation), PipelineModel.load(f"{path}/model"), row.best_model


def decode_requests(spark: SparkSession, body: str, cols: list[str], content_type: str = "application/json") -> DataFrame:
    """Rows of a request: a JSON object is one row, a list is many; any other type is an error."""
    if content_type != "application/json":
        raise ValueError(f"unsupported content type {content_type}")
    data = json.loads(body)
    rows = [data] if isinstance(data, dict) else data
    kind = "array<struct<" + ",".join(f"`{c}`:double" for c in cols) + ">>"
    one = spark.createDataFrame([(json.dumps(rows),)], "body string")
    return one.select(F.explode(F.from_json("body", kind)).alias("r")).select("r.*")


def response(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """One row ``body``: {"prediction": [...]} in request order; requests are a handful of rows."""
    p = model.transform(requests.withColumn("_i", F.monotonically_increasing_id()))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_i", "prediction"))), lambda x: x["prediction"])
    return p.agg(F.to_json(F.struct(listed.alias("prediction"))).alias("body"))
