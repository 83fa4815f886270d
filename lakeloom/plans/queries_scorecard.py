"""Queries: labels, features, selection, preparation, evaluation and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import evaluate, prep, scorecard
from lakeloom.plans.adapters import frame, sql
from lakeloom.plans.registry import register
from lakeloom.scratch import cut

RETAIL, EVENTS, HOUSING, SCORED = sql("tx_retail"), sql("tx_events"), sql("housing"), sql("scored")


def labels_sql(tx: str, limit: int) -> str:
    return f"""
    SELECT p.customer_id, p.last_purchase, round(p.total_amount, 2) AS total_amount, p.tx_count,
           CAST(datesub('day', p.last_purchase, g.last_ts) AS INTEGER) AS days_since_last,
           CAST(CASE WHEN datesub('day', p.last_purchase, g.last_ts) < {limit} AND p.tx_count > g.med THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM (SELECT customer_id, max(purchase_datetime) AS last_purchase, sum(amount) AS total_amount, count(*) AS tx_count FROM {tx} t GROUP BY 1) p,
         (SELECT max(last_purchase) AS last_ts, median(tx_count) AS med FROM (SELECT customer_id, max(purchase_datetime) AS last_purchase, count(*) AS tx_count FROM {tx} t GROUP BY 1)) g"""


def features_sql(tx: str) -> str:
    return f"""
    SELECT customer_id, CAST(datesub('day', mx, ref) AS INTEGER) AS recency_days, frequency, round(monetary, 2) AS monetary, round(avg_amount + 1e-7, 4) AS avg_amount,
           round(qty_mean + 1e-7, 4) AS qty_mean, channels, first_purchase, CAST(datesub('day', first_purchase, ref) AS INTEGER) AS tenure_days
    FROM (SELECT customer_id, max(purchase_datetime) AS mx, count(*) AS frequency, sum(amount) AS monetary, avg(amount) AS avg_amount, avg(quantity) AS qty_mean,
                 count(DISTINCT channel) AS channels, min(purchase_datetime) AS first_purchase FROM {tx} t GROUP BY 1),
         (SELECT max(purchase_datetime) + INTERVAL 1 DAY AS ref FROM {tx} t)"""


FEATURES_LABEL = f"SELECT f.*, coalesce(l.label, 0) AS label FROM ({features_sql(RETAIL)}) f LEFT JOIN (SELECT customer_id, label FROM ({labels_sql(RETAIL, 60)})) l ON l.customer_id = f.customer_id"


def rounded(df: DataFrame) -> DataFrame:
    # means of cents often end in a five; a small shift makes the order of addition immaterial
    digits = {"monetary": (2, 0.0), "total_amount": (2, 0.0), "avg_amount": (4, 1e-7), "qty_mean": (4, 1e-7)}
    return df.select(*(F.round(F.col(c) + digits[c][1], digits[c][0]).alias(c) if c in digits else F.col(c) for c in df.columns))


def features(spark, sf_dir: str) -> DataFrame:
    """Rounded features with label over the retail view; both engines select and bin the same values."""
    return cut(rounded(scorecard.features_with_label(frame(spark, sf_dir, "tx_retail"))), "features")


@register("rfm_features", features_sql(RETAIL))
def _(spark, d):
    return rounded(scorecard.rfm_features(frame(spark, d, "tx_retail")))


@register("rfm_features_events", features_sql(EVENTS))
def _(spark, d):
    return rounded(scorecard.rfm_features(frame(spark, d, "tx_events")))


@register("customer_labels", labels_sql(RETAIL, 60))
def _(spark, d):
    return rounded(scorecard.customer_labels(frame(spark, d, "tx_retail")))


@register("customer_labels_events", labels_sql(EVENTS, 1))
def _(spark, d):
    return rounded(scorecard.customer_labels(frame(spark, d, "tx_events"), days_limit=1))


@register("features_with_label", FEATURES_LABEL)
def _(spark, d):
    return features(spark, d)


@register("first_purchase_left_join", f"SELECT a.customer_id, a.frequency, b.first_purchase FROM (SELECT customer_id, count(*) AS frequency FROM {RETAIL} t GROUP BY 1) a LEFT JOIN (SELECT customer_id, min(purchase_datetime) AS first_purchase FROM {RETAIL} t GROUP BY 1) b ON a.customer_id = b.customer_id")
def _(spark, d):
    return scorecard.first_purchase_join(frame(spark, d, "tx_retail"))


def _corr_sql() -> str:
    cols = scorecard.NUMERIC
    parts = [f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, '{cols[i]}' AS a, '{cols[j]}' AS b, abs(CASE WHEN stddev_pop({cols[i]}) = 0 OR stddev_pop({cols[j]}) = 0 THEN NULL ELSE covar_pop({cols[i]}, {cols[j]}) / (stddev_pop({cols[i]}) * stddev_pop({cols[j]})) END) AS r FROM f" for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return f"WITH f AS ({FEATURES_LABEL}) " + " UNION ALL ".join(parts)


@register("corr_matrix_long", f"SELECT i, j, a, b, round(r, 6) AS r FROM ({_corr_sql()})")
def _(spark, d):
    return scorecard.corr_long(features(spark, d), scorecard.NUMERIC).withColumn("r", F.round("r", 6))


@register("corr_dropped_features", f"SELECT DISTINCT b AS feature FROM ({_corr_sql()}) WHERE r > 0.5")
def _(spark, d):
    return scorecard.corr_dropped(features(spark, d), scorecard.NUMERIC, limit=0.5)


@register("corr_dropped_at_default", f"SELECT DISTINCT b AS feature FROM ({_corr_sql()}) WHERE r > 0.9")
def _(spark, d):
    return scorecard.corr_dropped(features(spark, d), scorecard.NUMERIC)


def _bucket_sql(feature: str) -> str:
    return f"""
    SELECT bucket, count(*) AS n, CAST(sum(label) AS BIGINT) AS event FROM (
        SELECT label, CAST(1 + (CASE WHEN rn > 1 + (1 * (1.0::DOUBLE / q)) * 100 / 100 * (n - 1) AND 1 < q THEN 1 ELSE 0 END) + (CASE WHEN rn > 1 + (2 * (1.0::DOUBLE / q)) * 100 / 100 * (n - 1) AND 2 < q THEN 1 ELSE 0 END)
             + (CASE WHEN rn > 1 + (3 * (1.0::DOUBLE / q)) * 100 / 100 * (n - 1) AND 3 < q THEN 1 ELSE 0 END) + (CASE WHEN rn > 1 + (4 * (1.0::DOUBLE / q)) * 100 / 100 * (n - 1) AND 4 < q THEN 1 ELSE 0 END)
             + (CASE WHEN rn > 1 + (5 * (1.0::DOUBLE / q)) * 100 / 100 * (n - 1) AND 5 < q THEN 1 ELSE 0 END) AS INTEGER) AS bucket
        FROM (SELECT label, row_number() OVER (ORDER BY {feature}, customer_id) AS rn, count(*) OVER () AS n, (SELECT least(6, count(DISTINCT {feature})) FROM f) AS q FROM f WHERE {feature} IS NOT NULL)
    ) GROUP BY 1"""


def _woe_sql(feature: str) -> str:
    return f"""
    SELECT bucket, n, event, er AS event_rate, nr AS non_event_rate, ln(er / nr) AS woe, (er - nr) * ln(er / nr) AS iv FROM (
        SELECT bucket, n, event, (event + 0.5) / (sum(event) OVER () + 0.5 * count(*) OVER ()) AS er, (n - event + 0.5) / (sum(n - event) OVER () + 0.5 * count(*) OVER ()) AS nr FROM ({_bucket_sql(feature)}))"""


@register("rank_bucket_counts", f"WITH f AS ({FEATURES_LABEL}) {_bucket_sql('monetary')}")
def _(spark, d):
    return scorecard.bucket_counts(features(spark, d), "monetary")


@register("rank_bucket_counts_ties", f"WITH f AS ({FEATURES_LABEL}) {_bucket_sql('channels')}")
def _(spark, d):
    return scorecard.bucket_counts(features(spark, d), "channels")


@register("woe_iv_detail", f"WITH f AS ({FEATURES_LABEL}) SELECT bucket, n, event, round(event_rate, 6) AS event_rate, round(non_event_rate, 6) AS non_event_rate, round(woe, 6) AS woe, round(iv, 6) AS iv FROM ({_woe_sql('frequency')})")
def _(spark, d):
    w = scorecard.woe_iv(scorecard.bucket_counts(features(spark, d), "frequency"))
    return w.select("bucket", "n", "event", *(F.round(c, 6).alias(c) for c in ("event_rate", "non_event_rate", "woe", "iv")))


def _iv_sql() -> str:
    parts = [f"SELECT '{c}' AS feature, CASE WHEN count(*) > 1 THEN sum(iv) ELSE 0.0 END AS iv FROM ({_woe_sql(c)})" for c in scorecard.NUMERIC]
    return f"WITH f AS ({FEATURES_LABEL}) " + " UNION ALL ".join(parts)


@register("iv_by_feature", f"SELECT feature, round(iv, 6) AS iv FROM ({_iv_sql()})")
def _(spark, d):
    return scorecard.information_value(features(spark, d), scorecard.NUMERIC).withColumn("iv", F.round("iv", 6))


@register("iv_selected", f"SELECT feature FROM ({_iv_sql()}) WHERE iv > 0.01")
def _(spark, d):
    return scorecard.information_value(features(spark, d), scorecard.NUMERIC).where("iv > 0.01").select("feature")


@register("category_iv", f"""WITH f AS (SELECT o.o_orderpriority AS c, CASE WHEN o.o_totalprice > 150000 THEN 1 ELSE 0 END AS label FROM orders o),
    g AS (SELECT c, count(*) AS n, sum(label) AS event FROM f WHERE c IS NOT NULL GROUP BY 1),
    r AS (SELECT (event + 0.5) / (sum(event) OVER () + 0.5 * count(*) OVER ()) AS er, (n - event + 0.5) / (sum(n - event) OVER () + 0.5 * count(*) OVER ()) AS nr FROM g)
    SELECT 'o_orderpriority' AS feature, round(sum((er - nr) * ln(er / nr)), 6) AS iv FROM r""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", (F.col("o_totalprice") > 150000).cast("int").alias("label"))
    return scorecard.category_iv(o, "o_orderpriority").withColumn("iv", F.round("iv", 6))


_IMPUTED = f"SELECT id, coalesce(size, (SELECT median(size) FROM h)) AS size, coalesce(price, (SELECT median(price) FROM h)) AS price, coalesce(rooms, (SELECT median(rooms) FROM h)) AS rooms, coalesce(target, (SELECT median(target) FROM h)) AS target FROM h"
_COLS = ["size", "price", "rooms", "target"]


@register("median_impute", f"WITH h AS {HOUSING} SELECT id, round(size, 6) AS size, round(price, 6) AS price, round(rooms, 6) AS rooms, round(target, 6) AS target FROM ({_IMPUTED})")
def _(spark, d):
    return prep.median_impute(frame(spark, d, "housing"), _COLS).select("id", *(F.round(c, 6).alias(c) for c in _COLS))


@register("positive_target_filter", f"SELECT * FROM {HOUSING} h WHERE target > 0")
def _(spark, d):
    return prep.positive(frame(spark, d, "housing"), "target")


@register("target_last_projection", f"SELECT id, price, rooms, target, size FROM {HOUSING} h")
def _(spark, d):
    return prep.target_last(frame(spark, d, "housing"), "size")


@register("standardize_pop", f"WITH h AS {HOUSING} SELECT id, round((size - (SELECT avg(size) FROM h)) / (SELECT stddev_pop(size) FROM h), 6) AS size, round((price - (SELECT avg(price) FROM h)) / (SELECT stddev_pop(price) FROM h), 6) AS price FROM h")
def _(spark, d):
    return prep.standardize(frame(spark, d, "housing"), ["size", "price"]).select("id", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


@register("house_price_chain", f"""WITH h AS {HOUSING}, c AS (SELECT * FROM ({_IMPUTED}) WHERE target > 0)
    SELECT id, round((size - (SELECT avg(size) FROM c)) / (SELECT stddev_pop(size) FROM c), 6) AS size, round((price - (SELECT avg(price) FROM c)) / (SELECT stddev_pop(price) FROM c), 6) AS price,
           round((rooms - (SELECT avg(rooms) FROM c)) / (SELECT stddev_pop(rooms) FROM c), 6) AS rooms, round(target, 6) AS target FROM c""")
def _(spark, d):
    out = prep.house_price_chain(frame(spark, d, "housing"), "target", "id")
    return out.select("id", *(F.round(c, 6).alias(c) for c in _COLS))


@register("union_by_name", f"SELECT id, size, price, NULL::DOUBLE AS rooms FROM {HOUSING} a WHERE id % 2 = 0 UNION ALL SELECT id, size, NULL::DOUBLE AS price, rooms FROM {HOUSING} b WHERE id % 2 = 1")
def _(spark, d):
    h = frame(spark, d, "housing")
    return prep.union_by_name([h.where("id % 2 = 0").select("id", "size", "price"), h.where("id % 2 = 1").select("rooms", "id", "size")]).select("id", "size", "price", "rooms")


@register("stratified_split_counts", f"""WITH f AS ({FEATURES_LABEL}), c AS (SELECT label, count(*) AS n, CAST(round(count(*) * 0.25) AS BIGINT) AS t FROM f GROUP BY 1)
    SELECT label, 'test' AS split, t AS n FROM c WHERE t > 0 UNION ALL SELECT label, 'train' AS split, n - t AS n FROM c WHERE n > t""")
def _(spark, d):
    return prep.stratified_split(features(spark, d), "label", "customer_id").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@register("target_encode", f"""WITH t AS (SELECT o_orderpriority AS c, o_totalprice AS y FROM orders), g AS (SELECT avg(y) AS g FROM t)
    SELECT c, round(count(y) / (count(y) + 0.3) * avg(y) + (1 - count(y) / (count(y) + 0.3)) * any_value(g.g), 4) AS encoded FROM t, g GROUP BY 1""")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("c"), F.col("o_totalprice").alias("y"))
    return prep.target_encode(o, "c", "y").withColumn("encoded", F.round("encoded", 4))


def _auc_sql(score: str) -> str:
    return f"""SELECT CASE WHEN n1 = 0 OR n0 = 0 THEN NULL ELSE (sr - n1 * (n1 + 1) / 2.0) / (n1 * n0) END AS auc FROM (
        SELECT sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS sr, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (label <> 1) AS DOUBLE) AS n0
        FROM (SELECT label, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM {SCORED} s))"""


@register("auc_exact", f"SELECT round(auc, 6) AS auc FROM ({_auc_sql('score_a')})")
def _(spark, d):
    return evaluate.auc(frame(spark, d, "scored"), "label", "score_a").select(F.round("auc", 6).alias("auc"))


@register("best_model", f"SELECT CASE WHEN b.auc > a.auc THEN 'boosted' ELSE 'logistic' END AS best_model, round(greatest(a.auc, b.auc), 6) AS auc FROM ({_auc_sql('score_a')}) a, ({_auc_sql('score_b')}) b")
def _(spark, d):
    s = frame(spark, d, "scored")
    return evaluate.best_model(evaluate.auc(s, "label", "score_a"), evaluate.auc(s, "label", "score_b")).withColumn("auc", F.round("auc", 6))


_CELLS = f"(SELECT count(*) FILTER (label = 0 AND score_a < 0.5) AS c00, count(*) FILTER (label = 0 AND score_a >= 0.5) AS c01, count(*) FILTER (label = 1 AND score_a < 0.5) AS c10, count(*) FILTER (label = 1 AND score_a >= 0.5) AS c11 FROM {SCORED} s)"


@register("precision_recall", f"SELECT round(coalesce(c11 / nullif(c11 + c01, 0), 0.0), 6) AS precision, round(coalesce(c11 / nullif(c11 + c10, 0), 0.0), 6) AS recall FROM {_CELLS} c")
def _(spark, d):
    return evaluate.precision_recall(frame(spark, d, "scored"), "label", "score_a").select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("confusion", f"SELECT 0 AS actual, 0 AS predicted, c00 AS n FROM {_CELLS} UNION ALL SELECT 0, 1, c01 FROM {_CELLS} UNION ALL SELECT 1, 0, c10 FROM {_CELLS} UNION ALL SELECT 1, 1, c11 FROM {_CELLS}")
def _(spark, d):
    return evaluate.confusion(frame(spark, d, "scored"), "label", "score_a")


@register("class_report", f"""WITH c AS {_CELLS}, m AS (
    SELECT coalesce(c00 / nullif(c00 + c10, 0), 0.0) AS p0, coalesce(c00 / nullif(c00 + c01, 0), 0.0) AS r0, coalesce(c11 / nullif(c11 + c01, 0), 0.0) AS p1, coalesce(c11 / nullif(c11 + c10, 0), 0.0) AS r1,
           c00 + c01 AS s0, c10 + c11 AS s1, c00 + c01 + c10 + c11 AS s, coalesce((c00 + c11) / nullif(c00 + c01 + c10 + c11, 0), 0.0) AS acc FROM c),
    f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1 FROM m),
    u AS (SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f UNION ALL SELECT '1', p1, r1, f1, s1 FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, s FROM f
          UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM f UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM f)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""")
def _(spark, d):
    r = evaluate.class_report(frame(spark, d, "scored"), "label", "score_a")
    return r.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


_VERSIONS = "(SELECT 'm' || CAST(n_regionkey AS VARCHAR) AS name, n_nationkey AS version, CASE WHEN n_nationkey % 11 = 7 THEN NULL ELSE CAST((n_nationkey * 7) % 10 AS DOUBLE) / 10 END AS auc FROM nation)"


@register("promotion_fold", f"""WITH v AS (SELECT *, row_number() OVER w = 1 OR max(auc) OVER (PARTITION BY name ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL
        OR coalesce(auc > max(auc) OVER (PARTITION BY name ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS promoted FROM {_VERSIONS} x WINDOW w AS (PARTITION BY name ORDER BY version))
    SELECT name, version, auc, promoted, CASE WHEN NOT promoted THEN 'None' WHEN version = max(CASE WHEN promoted THEN version END) OVER (PARTITION BY name) THEN 'Production' ELSE 'Archived' END AS stage FROM v""")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    auc = F.when(F.col("n_nationkey") % 11 == 7, None).otherwise(((F.col("n_nationkey") * 7) % 10).cast("double") / 10)
    return evaluate.promotion(n.select(F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("name"), F.col("n_nationkey").alias("version"), auc.alias("auc")))
