"""Customer features kept up to date: what each batch adds is merged into a table of sums, and nothing is recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeloom.operators import scorecard
from lakeloom.sources.keyed import Combine, KeyedTable

#: How the sums of a customer before and of a batch become those of both.
COMBINE: Combine = {
    "last_purchase": F.greatest, "first_purchase": F.least, "frequency": lambda a, b: a + b,
    **{c: (lambda a, b: F.coalesce(a + b, a, b)) for c in ("monetary", "amounts", "quantity", "quantities")},
    "channel_set": lambda a, b: F.array_sort(F.array_union(a, b)),
}


def partials(tx: DataFrame) -> DataFrame:
    """Sums of each customer's transactions that can be added up; channels are few and kept as a set."""
    return tx.where("customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.max("purchase_datetime").alias("last_purchase"), F.min("purchase_datetime").alias("first_purchase"), F.count(F.lit(1)).alias("frequency"),
        F.sum(F.col("amount").cast("double")).alias("monetary"), F.count("amount").alias("amounts"), F.sum(F.col("quantity").cast("double")).alias("quantity"), F.count("quantity").alias("quantities"),
        F.array_sort(F.collect_set("channel")).alias("channel_set"),
    )


def feature_table(spark: SparkSession, path: str, transactions: StructType, buckets: int = 64) -> KeyedTable:
    """The table of sums at a path, made if it is not there; ``transactions`` is the type of the rows to come."""
    return KeyedTable(spark, path, ["customer_id"], partials(spark.createDataFrame([], transactions)).schema, buckets)


def add_batch(table: KeyedTable, tx: DataFrame, source: str, batch: int) -> int:
    """Add a batch of transactions; one that the source delivered before, or an older one, changes nothing."""
    return table.merge(partials(tx), source=source, batch=batch, combine=COMBINE)


def follow(transactions: DataFrame, table: KeyedTable, checkpoint: str, source: str = "transactions") -> StreamingQuery:
    """Add all that has come to a stream since the last run, batch by batch, and stop.

    Run it as often as features are to be fresh. A batch that failed half-way is delivered
    again after a restart and counted once, as the table notes a batch with its rows.
    """
    add = lambda rows, batch: add_batch(table, rows, source, batch)
    return transactions.writeStream.foreachBatch(add).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()


def current_features(table: KeyedTable, days_limit: int = 60) -> DataFrame:
    """Features and label of all customers, as scorecard.features_with_label() makes them of all transactions."""
    per = table.read().select(
        "customer_id", "last_purchase", "first_purchase", "frequency", "monetary", F.try_divide("monetary", "amounts").alias("avg_amount"),
        F.try_divide("quantity", "quantities").alias("qty_mean"), F.size("channel_set").cast("bigint").alias("channels"),
    )
    return scorecard.labelled_features(per, days_limit)
