"""Sources: files, SQL, catalog, JSON documents and a generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeloom.scratch import cut


def parquet(spark: SparkSession, path: str, needs: list[str] = ()) -> DataFrame:
    """A Parquet table; columns it lacks of ``needs`` are an error."""
    df = spark.read.parquet(path)
    missing = [c for c in needs if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return df


def csv_folder(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Every *.csv in a folder, with header; none is an error. Without schema types are inferred once."""
    r = spark.read.option("header", True).option("pathGlobFilter", "*.csv")
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    try:
        df = r.csv(path)
    except Exception as e:  # Spark says so while it infers a schema
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(f"no csv file in {path}") from e
        raise
    if not df.inputFiles():
        raise FileNotFoundError(f"no csv file in {path}")
    return df


def sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """A query over named frames and catalog tables."""
    return spark.sql(query, **frames)


def whole_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """An external table, read in ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def catalog_tables(spark: SparkSession, system: tuple[str, ...] = ("information_schema", "pg_catalog")) -> DataFrame:
    """(schema_name, table_name) of base tables, system schemas left out, in order."""
    rows = [(d.name, t.name) for d in spark.catalog.listDatabases() if d.name not in system for t in spark.catalog.listTables(d.name) if not t.isTemporary and t.tableType in ("MANAGED", "EXTERNAL")]
    return spark.createDataFrame(sorted(rows), "schema_name string, table_name string")


def json_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents or lists of records. A missing path gives no rows, and a file with anything corrupt in it gives none either."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    wanted = spark.createDataFrame([], schema).schema
    bad, file = "_corrupt_record", "_file"
    d = spark.read.schema(StructType([*wanted.fields, StructField(bad, StringType())])).option("multiLine", True).option("columnNameOfCorruptRecord", bad).json(path)
    d = cut(d.withColumn(file, F.input_file_name()), "parsed")  # what was corrupt is known only of rows that were parsed and kept
    return d.join(d.where(F.col(bad).isNotNull()).select(file).distinct(), file, "left_anti").select(*wanted.names)


#: Fixed values of the generated transactions: unit prices, channels, how many at once with their upper shares, and the share without promotion.
PRICES = (10.0, 20.0, 30.0, 50.0, 100.0)
CHANNELS = ("web", "app", "store")
QUANTITIES = ((1, 0.8), (2, 0.9), (3, 1.0))
NO_PROMOTION = 0.85


def synthetic_transactions(spark: SparkSession, n: int = 8_000, customers: int = 1_000, seed: int = 42) -> DataFrame:
    """Transactions of the fixed domains, by a hash of row and seed: the same rows on any cluster."""

    def u(k: int):
        return F.pmod(F.xxhash64("transaction_id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003

    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (F.floor(u(k) * len(values)) + 1).cast("int"))
    d = spark.range(1, n + 1).withColumnRenamed("id", "transaction_id")
    seconds = (F.floor(u(2) * 365) * 86_400 + F.floor(u(3) * 24) * 3_600).cast("int")
    quantity = F.lit(QUANTITIES[-1][0])
    for n, share in reversed(QUANTITIES[:-1]):
        quantity = F.when(u(5) < share, n).otherwise(quantity)
    d = d.select(
        "transaction_id", (F.floor(u(1) * customers) + 1).cast("bigint").alias("customer_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("_t"), seconds.alias("_s"), (F.floor(u(4) * 199) + 1).cast("int").alias("product_id"),
        quantity.alias("quantity"), F.round(pick(6, PRICES) * (1 + u(7) * 0.3), 2).alias("price"),
        pick(8, CHANNELS).alias("channel"), (u(9) >= NO_PROMOTION).cast("int").alias("promo_flag"),
    )
    d = d.withColumn("purchase_datetime", F.col("_t") + F.make_dt_interval(secs=F.col("_s"))).drop("_t", "_s")
    return d.withColumn("amount", F.col("quantity") * F.col("price"))
