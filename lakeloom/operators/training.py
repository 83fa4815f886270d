"""The scorecard's training as one thing: features, selection, preparation, two fits, metrics, choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import evaluate, models, prep, scorecard
from lakeloom.operators.boosting import Params, TreeModel, fit_trees
from lakeloom.operators.registry import ModelRegistry, scored
from lakeloom.scratch import cut, fresh

FITS = {"logistic": models.fit_logistic, "boosted": models.fit_boosted}


@dataclass(frozen=True)
class Scorecard:
    """What train_scorecard() found; score() takes rows with the features."""

    numeric: list[str]
    categorical: list[str]
    blocks: models.Blocks
    fitted: dict[str, PipelineModel | TreeModel]
    #: Per model: auc, precision, recall over the test rows.
    metrics: dict[str, dict[str, float]]
    best: str

    def score(self, rows: DataFrame, model: str | None = None, threshold: float = 0.5) -> DataFrame:
        """rows with probability and prediction, of the best model or the one named."""
        return _scored(self.fitted[model or self.best], self.blocks.transform(rows), threshold)

    def register(self, registry: ModelRegistry, name: str, run_id: str | None = None) -> dict[str, int]:
        """A version of each model under name.model, with its metrics; trees go with their bundle. Versions by model."""
        trees = {m: f if isinstance(f, TreeModel) else None for m, f in self.fitted.items()}
        return {m: registry.register(f"{name}.{m}", self.metrics[m]["auc"], trees[m], run_id, **{k: v for k, v in self.metrics[m].items() if k != "auc"}) for m in self.fitted}


def unpacked(df: DataFrame, size: int, features: str = "features") -> tuple[DataFrame, list[str]]:
    """df with a column for each place of a vector, and their names."""
    names = [fresh(df, f"{features}_{i}") for i in range(size)]
    a = vector_to_array(features)
    return df.withColumns({n: F.get(a, F.lit(i)) for i, n in enumerate(names)}), names


def _scored(model: PipelineModel | TreeModel, ready: DataFrame, threshold: float) -> DataFrame:
    if not isinstance(model, TreeModel):
        return models.score(model, ready, threshold)
    d, names = unpacked(ready, len(model.columns))
    return scored(d, model, threshold).drop(*names)


def train_scorecard(tx: DataFrame, *, days_limit: int = 60, iv_limit: float = 0.01, corr_limit: float = 0.9, components: int | None = None, threshold: float = 0.5, categorical: tuple[str, ...] = (), second_order: Params | None = None) -> Scorecard:
    """Train on transactions: labels and features, correlation and information-value selection, a stratified split, both models, and the better one by AUC.

    The features are written once and every later step reads them. ``components`` puts
    principal components of the numbers in their place. With ``second_order`` the boosted
    model is fitted by gradients and hessians, and is portable. Of equal models the logistic one is
    the best. No feature left by the selection is an error.
    """
    split = cut(prep.stratified_split(scorecard.features_with_label(tx, days_limit), "label", "customer_id"), "split")
    numeric, categories = scorecard.select_features(split, scorecard.NUMERIC, list(categorical), iv_limit, corr_limit)
    if not numeric:
        raise ValueError("no numeric feature passed the selection")
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    blocks = models.fit_blocks(train, numeric, categories, components=components)
    ready = cut(blocks.transform(train), "train")
    fitted, metrics = {}, {}
    for name, fit in FITS.items():
        if name == "boosted" and second_order:
            fitted[name] = fit_trees(*unpacked(ready, len(ready.first()["features"])), "label", params=second_order)
        else:
            fitted[name] = fit(ready, "label")
        s = cut(_scored(fitted[name], blocks.transform(test), threshold).select("label", "probability"), "scored")
        one = evaluate.precision_recall(s, "label", "probability", threshold).first()
        metrics[name] = {"auc": evaluate.auc(s, "label", "probability").first().auc, "precision": one.precision, "recall": one.recall}
    best = max(FITS, key=lambda m: (metrics[m]["auc"] or 0.0, m == "logistic"))
    return Scorecard(numeric, categories, blocks, fitted, metrics, best)
