"""Customer scorecard: labels, recency/frequency/monetary features and their selection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.ranking import long_ranks, quantile_bucket
from lakeloom.scratch import cut

NUMERIC = ["recency_days", "frequency", "monetary", "avg_amount", "qty_mean", "channels", "tenure_days"]


def whole_days(a: Column, b: Column) -> Column:
    """Whole 24-hour periods from a to b, rounded down; a calendar difference would count midnights."""
    return F.timestamp_diff("DAY", a, b)


def _per_customer(tx: DataFrame) -> DataFrame:
    """All that labels and features need of the transactions, in one aggregate, written once."""
    return cut(
        tx.groupBy("customer_id").agg(
            F.max("purchase_datetime").alias("last_purchase"), F.min("purchase_datetime").alias("first_purchase"), F.count(F.lit(1)).alias("frequency"), F.sum("amount").alias("monetary"),
            F.avg("amount").alias("avg_amount"), F.avg("quantity").alias("qty_mean"), F.countDistinct("channel").alias("channels"),
        ),
        "customers",
    )


def _labelled(per: DataFrame, days_limit: int) -> DataFrame:
    """per with _last, days_since_last and label."""
    # the median is over counts, whose distinct values are few
    line = per.agg(F.max("last_purchase").alias("_last"), F.median("frequency").alias("_median"))
    d = per.crossJoin(F.broadcast(line)).withColumn("days_since_last", whole_days(F.col("last_purchase"), F.col("_last")).cast("int"))
    return d.withColumn("label", ((F.col("days_since_last") < days_limit) & (F.col("frequency") > F.col("_median"))).cast("int"))


def _features(d: DataFrame) -> list[Column]:
    ref = F.col("_last") + F.expr("INTERVAL 1 DAY")
    days = lambda c: whole_days(F.col(c), ref).cast("int")
    return [F.col("customer_id"), days("last_purchase").alias("recency_days"), *map(F.col, ("frequency", "monetary", "avg_amount", "qty_mean", "channels", "first_purchase")), days("first_purchase").alias("tenure_days")]


def customer_labels(tx: DataFrame, days_limit: int = 60) -> DataFrame:
    """customer_id, last_purchase, total_amount, tx_count, days_since_last, label.

    label is 1 if the last purchase is less than ``days_limit`` days before the latest of
    all and the customer has more transactions than the median customer; both strict.
    """
    per = cut(tx.groupBy("customer_id").agg(F.max("purchase_datetime").alias("last_purchase"), F.sum("amount").alias("total_amount"), F.count(F.lit(1)).alias("frequency")), "customers")
    d = _labelled(per, days_limit)
    return d.select("customer_id", "last_purchase", "total_amount", F.col("frequency").alias("tx_count"), "days_since_last", "label")


def rfm_features(tx: DataFrame) -> DataFrame:
    """One aggregation per customer; the first purchase is a minimum in it and needs no join."""
    per = _per_customer(tx)
    d = per.crossJoin(F.broadcast(per.agg(F.max("last_purchase").alias("_last"))))
    return d.select(*_features(d))


def features_with_label(tx: DataFrame, days_limit: int = 60) -> DataFrame:
    """Features and label, of one aggregate over the transactions: every customer with features has a label."""
    return labelled_features(_per_customer(tx), days_limit)


def labelled_features(per: DataFrame, days_limit: int = 60) -> DataFrame:
    """Features and label from the aggregates of each customer."""
    d = _labelled(per, days_limit)
    return d.select(*_features(d), "label")


def first_purchase_join(tx: DataFrame) -> DataFrame:
    """The same first purchase by the literal left join of a second aggregate."""
    first = tx.groupBy("customer_id").agg(F.min("purchase_datetime").alias("purchase_datetime")).withColumnRenamed("purchase_datetime", "first_purchase")
    return tx.groupBy("customer_id").agg(F.count(F.lit(1)).alias("frequency")).join(first, "customer_id", "left")


def corr_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, a, b, r): absolute Pearson correlation of each pair of columns, in one pass; null where a column is constant."""
    pairs = list(combinations(range(len(cols)), 2))
    moments = [F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]
    # dividing by a zero deviation raises, so a constant column gives null
    co = [F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]
    one = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).agg(*moments, *co)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.abs(F.try_divide(F.col(f"c{i}_{j}"), F.col(f"s{i}") * F.col(f"s{j}"))).alias("r")) for i, j in pairs]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def corr_dropped(df: DataFrame, cols: list[str], limit: float = 0.9) -> DataFrame:
    """Columns whose correlation with any earlier column is above the limit; dropped ones still count as earlier."""
    return corr_long(df, cols).where(F.col("r") > limit).select(F.col("b").alias("feature")).distinct()


def _buckets(df: DataFrame, features: list[str], target: str, key: str, bins: int) -> DataFrame:
    """(f, bucket, n, event) for every feature, numbered in order."""
    near = df.agg(*(F.approx_count_distinct(c).alias(c) for c in features)).first()
    # only a column with few values can have fewer than the bins; those are counted exactly
    few = [c for c in features if near[c] < 8 * bins]
    exact = df.agg(*(F.countDistinct(c).alias(c) for c in few)).first() if few else {}
    q = {c: max(1, min(bins, exact[c])) if c in few else bins for c in features}
    ranked, n = long_ranks(df, features, key, [target])
    of = lambda d, kind: F.element_at(F.array(*(F.lit(d[c]).cast(kind) for c in features)), F.col("f") + 1)
    bucket = quantile_bucket(F.col("rn"), of(n, "bigint"), of(q, "int"))
    return ranked.groupBy("f", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("event"))


def bucket_counts(df: DataFrame, feature: str, target: str = "label", key: str = "customer_id", bins: int = 6) -> DataFrame:
    """(bucket, n, event) of equal-count buckets over ranks; ties rank by key. Fewer distinct values than bins give as many buckets."""
    return _buckets(df, [feature], target, key, bins).drop("f")


def woe_iv(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """counts with event_rate, non_event_rate, woe and iv, half an event added to each bucket. A handful of rows."""
    every = Window.partitionBy(*by)
    k = F.count(F.lit(1)).over(every)
    non = F.col("n") - F.col("event")
    er = (F.col("event") + 0.5) / (F.sum("event").over(every) + 0.5 * k)
    nr = (non + 0.5) / (F.sum(non).over(every) + 0.5 * k)
    d = counts.withColumns({"event_rate": er, "non_event_rate": nr})
    woe = F.ln(F.col("event_rate") / F.when(F.col("non_event_rate") == 0, 1e-6).otherwise(F.col("non_event_rate")))
    return d.withColumn("woe", woe).withColumn("iv", (F.col("event_rate") - F.col("non_event_rate")) * F.col("woe"))


def information_value(df: DataFrame, features: list[str], target: str = "label", key: str = "customer_id", bins: int = 6) -> DataFrame:
    """(feature, iv), all features in one pass; a feature with one value, or none, has 0."""
    iv = woe_iv(_buckets(df, features, target, key, bins), ["f"]).groupBy("f").agg(F.when(F.count(F.lit(1)) > 1, F.sum("iv")).otherwise(0.0).alias("iv"))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "f int, feature string")
    return names.join(iv, "f", "left").select("feature", F.coalesce("iv", F.lit(0.0)).alias("iv"))


def category_iv(df: DataFrame, feature: str, target: str = "label") -> DataFrame:
    """iv of a categorical feature, a bucket per value."""
    c = df.where(F.col(feature).isNotNull()).groupBy(feature).agg(F.count(F.lit(1)).alias("n"), F.sum(target).cast("bigint").alias("event"))
    return woe_iv(c).agg(F.sum("iv").alias("iv")).select(F.lit(feature).alias("feature"), "iv")


def select_features(df: DataFrame, numeric: list[str], categorical: list[str] = (), iv_limit: float = 0.01, corr_limit: float = 0.9, bins: int = 6) -> tuple[list[str], list[str]]:
    """Names kept by the correlation rule and then by information value (strictly above the limit)."""
    gone = {r.feature for r in corr_dropped(df, numeric, corr_limit).collect()}
    left = [c for c in numeric if c not in gone]
    iv = {r.feature: r.iv for r in information_value(df, left, bins=bins).collect()} if left else {}
    iv |= {c: category_iv(df, c).first().iv for c in categorical}
    return [c for c in left if iv[c] > iv_limit], [c for c in categorical if (iv[c] or 0) > iv_limit]

