"""Queries: components, models and scores; rows only, since no SQL expresses a fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import models, prep, scorecard, training
from lakeloom.plans.adapters import frame
from lakeloom.plans.queries_scorecard import features
from lakeloom.plans.registry import register
from lakeloom.scratch import cut


def _split(spark, d):
    f = cut(prep.stratified_split(features(spark, d), "label", "customer_id"), "split")
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    return models.fit_preparation(train, scorecard.NUMERIC), train, test


@register("pca_components")
def _(spark, d):
    prepared, train, _test = _split(spark, d)
    return models.pca_variance(prepared.transform(train), max_components=3)


def _scores(spark, d, fit):
    prepared, train, test = _split(spark, d)
    ready = cut(prepared.transform(train), "train")  # a fit reads it many times
    return models.score(fit(ready, "label"), prepared.transform(test)).select("customer_id", "label", F.round("probability", 6).alias("probability"), "prediction")


@register("logistic_scores")
def _(spark, d):
    return _scores(spark, d, models.fit_logistic)


@register("boosted_scores")
def _(spark, d):
    return _scores(spark, d, models.fit_boosted)


def _regression(spark, d):
    h = cut(prep.house_price_chain(frame(spark, d, "housing"), "target", "id"), "housing")
    h = models.dealt(h)
    return models.fit_regression(h, ["size", "price", "rooms"], "target"), h


@register("regression_scores")
def _(spark, d):
    m, h = _regression(spark, d)
    return m.transform(h).select("id", "target", F.round("prediction", 6).alias("prediction"))


@register("regression_response")
def _(spark, d):
    m, _h = _regression(spark, d)
    return models.response(models.decode_requests(spark, '[{"size": 1.0, "price": 0.5, "rooms": 2.0}, {"size": -1, "price": 0, "rooms": 1}]', ["size", "price", "rooms"]), m)


@register("scorecard_metrics")
def _(spark, d):
    """The whole training flow over the retail view: metrics of both models, and which is the best."""
    s = training.train_scorecard(frame(spark, d, "tx_retail"))
    rows = [(m, *(round(x[k], 6) for k in ("auc", "precision", "recall")), m == s.best) for m, x in s.metrics.items()]
    return spark.createDataFrame(rows, "model string, auc double, precision double, recall double, best boolean")


@register("synthetic_transactions")
def _(spark, d):
    """As many generated transactions as there are turns of talk, eight a customer."""
    from lakeloom.sources.readers import synthetic_transactions

    n = spark.read.parquet(f"{d}/conversations.parquet").count()
    return synthetic_transactions(spark, n, max(1, n // 8), seed=42)
