"""The lookups as SQL table functions, with parameters, for those who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators import rates as R
from lakeloom.operators.vectors import normalize

FUNCTIONS = {
    "exchange_rate": """(from_ccy STRING, to_ccy STRING, kind STRING DEFAULT '', until TIMESTAMP DEFAULT NULL)
        RETURNS TABLE (ccy STRING, rate_type STRING, effective_date TIMESTAMP, exchange_type STRING, buying_price STRING, selling_price STRING)
        RETURN SELECT ccy, rate_type, effective_date, exchange_type, buying_price, selling_price FROM lakeloom_exchange
        WHERE ccy IN (from_ccy, to_ccy) AND startswith(rate_type, kind) AND (until IS NULL OR effective_date <= until)""",
    "savings_rate": """(products ARRAY<STRING> DEFAULT NULL, interest ARRAY<STRING> DEFAULT NULL, terms ARRAY<STRING> DEFAULT NULL, currency STRING DEFAULT NULL)
        RETURNS TABLE (id BIGINT, client_type STRING, saving_type STRING, product_name STRING, product_type STRING, term_name STRING, term_day INT, int_freq STRING, cr_int_freq STRING, full_rate STRING, balance BIGINT, ccy STRING)
        RETURN SELECT id, client_type, saving_type, product_name, product_type, term_name, term_day, int_freq, cr_int_freq, full_rate, balance, ccy FROM lakeloom_savings
        WHERE (products IS NULL OR array_contains(products, product_type)) AND (interest IS NULL OR array_contains(interest, int_type))
        AND (terms IS NULL OR array_contains(terms, term)) AND (currency IS NULL OR ccy = currency)""",
    "nearest": """(query ARRAY<DOUBLE>, k INT DEFAULT 3) RETURNS TABLE (key BIGINT, score DOUBLE)
        RETURN SELECT key, score FROM (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS place
            FROM (SELECT key, aggregate(zip_with(unit, query, (x, y) -> x * y), 0D, (s, x) -> s + x) / coalesce(nullif(sqrt(aggregate(query, 0D, (s, x) -> s + x * x)), 0D), 1D) AS score FROM lakeloom_vectors WHERE size(unit) = size(query)))
        WHERE place <= k""",
}


def register_functions(spark: SparkSession, fx: DataFrame | None = None, saving: DataFrame | None = None, vectors: DataFrame | None = None) -> list[str]:
    """Make exchange_rate(), savings_rate() and nearest() over the tables given; returns the names made.

    They are temporary functions of the session, in-lined where they are called: what a
    caller asks for or filters by reaches the scans. ``vectors`` has key and embedding. An
    omitted list asks for all, as it does in operators.rates. Rows come in no order.
    """
    made = []
    if fx is not None:
        R.exchange_rates(fx, None, ordered=False).createOrReplaceTempView("lakeloom_exchange")
        made.append("exchange_rate")
    if saving is not None:
        known = saving.where((F.col("ccy") != "VND") | (F.col("actual_rate") > 0))
        known.select(F.col("id").cast("bigint").alias("id"), *R.savings_columns(), "term", "int_type").createOrReplaceTempView("lakeloom_savings")
        made.append("savings_rate")
    if vectors is not None:
        vectors.select(F.col("key").cast("bigint").alias("key"), normalize(F.col("embedding")).alias("unit")).createOrReplaceTempView("lakeloom_vectors")
        made.append("nearest")
    for name in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {FUNCTIONS[name]}")
    return made
