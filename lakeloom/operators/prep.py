"""Preparation of numeric tables: union, imputation, filters, projection, scaling, split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.ranking import exact_medians
from lakeloom.scratch import fresh


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns are matched by name and missing ones are null. No frame is an error."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def median_impute(df: DataFrame, cols: list[str], fitted: dict[str, float | None] | None = None) -> DataFrame:
    """Nulls of the columns replaced by their exact median, of df or as fitted elsewhere."""
    m = exact_medians(df, cols) if fitted is None else fitted
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m[c])) for c in cols if m[c] is not None})


def constant_impute(df: DataFrame, cols: list[str], value: str = "missing") -> DataFrame:
    return df.fillna(value, subset=cols)


def positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def target_last(df: DataFrame, target: str) -> DataFrame:
    """Features are all columns but the target, which comes last."""
    return df.select(*(c for c in df.columns if c != target), target)


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one pass; a zero deviation becomes 1."""
    row = df.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: list[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    s = fit_scaler(df, cols) if fitted is None else fitted
    return df.withColumns({c: (F.col(c) - F.lit(s[c][0])) / F.lit(s[c][1]) for c in cols if s[c][0] is not None})


def house_price_chain(df: DataFrame, target: str, key: str) -> DataFrame:
    """Impute all numeric columns, target included; keep positive targets; target last; scale the rest over all rows left."""
    cols = [c for c in df.columns if c != key]
    d = target_last(positive(median_impute(df, cols), target), target)
    return standardize(d, [c for c in cols if c != target])


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """df with ``split``: per label the share of rows with the least key hashes is test, rounded to whole rows.

    Rows are ranked inside hash ranges, so a label that holds most rows is still spread.
    """
    h, p, n, rn, shift, quota = (fresh(df, c) for c in ("_h", "_p", "_n", "_rn", "_before", "_quota"))
    d = df.withColumn(h, F.xxhash64(F.col(key), F.lit(seed))).withColumn(p, F.shiftrightunsigned(h, 58))
    sizes = d.groupBy(label, p).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(label)
    before = sizes.select(F.col(label), p, (F.sum(n).over(w.orderBy(p)) - F.col(n)).alias(shift), F.round(F.sum(n).over(w) * test_share).cast("bigint").alias(quota))
    d = d.withColumn(rn, F.row_number().over(Window.partitionBy(label, p).orderBy(F.shiftleft(h, 6), key))).join(F.broadcast(before), [label, p])
    return d.withColumn("split", F.when(F.col(shift) + F.col(rn) <= F.col(quota), "test").otherwise("train")).drop(h, p, shift, quota, rn)


def target_encode(df: DataFrame, col: str, target: str, smoothing: float = 0.3) -> DataFrame:
    """(col, encoded): mean of the target per value, drawn to the mean of all by n / (n + smoothing)."""
    per = df.groupBy(col).agg(F.count(target).alias("n"), F.avg(target).alias("m"))
    every = df.agg(F.avg(target).alias("g"))
    w = F.col("n") / (F.col("n") + smoothing)
    return per.crossJoin(F.broadcast(every)).select(col, (w * F.coalesce("m", "g") + (1 - w) * F.col("g")).alias("encoded"))
