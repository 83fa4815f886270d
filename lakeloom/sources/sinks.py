"""Sinks: files, tables and object-store mirrors through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.stores import mirror_files


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Records added to a log; nothing is read or rewritten."""
    df.write.mode("append").json(path)


def append_rows(df: DataFrame, table: str) -> None:
    df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)


def create_tables(spark: SparkSession, tables: dict[str, str]) -> None:
    """Databases and tables that are missing, in the order given: name -> column DDL."""
    for name, ddl in tables.items():
        if "." in name:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.split('.')[0]}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def drop_tables(spark: SparkSession, tables: list[str], databases: list[str] = ()) -> None:
    """Tables in reverse order of creation, then whole databases."""
    for name in reversed(tables):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for db in databases:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def replace_table(df: DataFrame, table: str) -> None:
    """Rewrite a table from rows that may come from it.

    They are written aside, then the tables change names. A failure in between leaves the
    old rows in <table>_before and the new ones in <table>_incoming, both whole.
    """
    spark = df.sparkSession
    aside, before = f"{table}_incoming", f"{table}_before"
    df.write.mode("overwrite").format("parquet").saveAsTable(aside)
    spark.sql(f"DROP TABLE IF EXISTS {before}")
    spark.sql(f"ALTER TABLE {table} RENAME TO {before}")
    spark.sql(f"ALTER TABLE {aside} RENAME TO {table}")
    spark.sql(f"DROP TABLE {before}")


def mirror(spark: SparkSession, local: str, remote: str) -> list[str]:
    """mirror_files(), and the keys that were deleted, which should be few."""
    gone = mirror_files(spark, local, remote).where("action = 'deleted'")
    return sorted(r.key for r in gone.select("key").collect())


def scaffold(spark: SparkSession, root: str, prefixes: list[str]) -> list[str]:
    """Make each prefix with a ``.keep`` file if it is not there; returns those made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    made = []
    for prefix in prefixes:
        p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{prefix.strip('/')}")
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            fs.mkdirs(p)
            fs.create(jvm.org.apache.hadoop.fs.Path(p, ".keep")).close()
            made.append(prefix)
    return made
