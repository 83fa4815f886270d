"""Exact cosine retrieval over array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.session import ship


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """v at length one; a zero vector stays. Doubles throughout."""
    n = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def parse_embedding(s: Column) -> Column:
    """A vector stored as text; never evaluated as code."""
    return F.from_json(s, "array<float>")


def bad_dimensions(df: DataFrame, vec: str, d: int) -> DataFrame:
    return df.where(F.size(vec) != d)


def top_k(index: DataFrame, key: str, vec: str, query: list[float], k: int) -> DataFrame:
    """(key, score): the k rows nearest to one query, ties by key. Wrong dimensions are an error."""
    q = np.asarray(query, float)
    n = float(np.sqrt((q * q).sum())) or 1.0
    lit = F.array(*(F.lit(float(x) / n) for x in q))
    ok = F.assert_true(F.size(vec) == len(query), F.lit("query and index dimensions differ"))
    score = F.when(ok.isNull(), inner_product(normalize(F.col(vec)), lit))
    return index.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


#: Queries and rows that one task's product takes, and queries of a tile of it.
QUERIES, ROWS, TILE = 4096, 8192, 128


def _nearest(m: np.ndarray, u: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, key, score) of the k best rows of u for each row of m, ties by key; a tile of queries at a time.

    Products only tell who may be among the best. Those are scored again, component by
    component in order, so that equal vectors score the same wherever they stand.
    """
    found = []
    for a in range(0, len(m), TILE):
        q = m[a : a + TILE]
        s = q @ u.T
        if 0 < k < len(u):
            least = np.partition(-s, k - 1, axis=1)[:, k - 1 : k] + 1e-9
            who, row = np.nonzero(~(-s > least))
        else:
            who, row = (x.ravel() for x in np.indices(s.shape))
        exact = np.zeros(len(who))
        for c in range(u.shape[1]):
            exact += q[who, c] * u[row, c]
        order = np.lexsort((keys[row], -exact, who))
        who, row, exact = who[order], row[order], exact[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < k
        found.append((who[best] + a, keys[row[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(v: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length one; other lengths are an error."""
    flat = np.concatenate([np.zeros(0), *(np.asarray(c.flatten().to_numpy(zero_copy_only=False), float) for c in v.chunks)])
    sizes = np.unique(np.concatenate([np.zeros(0, int), *(pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in v.chunks)]))
    if len(sizes) > 1:
        raise ValueError(f"vectors of lengths {sizes.min()} to {sizes.max()}")
    return _unit(flat.reshape(len(v), *sizes))


def _nearest_of_block(k: int, queries: pa.Table, rows: pa.Table) -> pa.Table:
    schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])
    if not len(queries) or not len(rows):
        return schema.empty_table()
    ids, keys = queries["key"].to_numpy(), rows["key"].to_numpy()
    who, key, score = _nearest(_matrix(queries["v"]), _matrix(rows["v"]), keys, k)
    return pa.table([ids[who], key, score], schema=schema)


def batched_top_k(queries: DataFrame, index: DataFrame, key: str, vec: str, k: int, block: int = QUERIES) -> DataFrame:
    """(query, key, score, rank) for many queries by matrix products.

    Queries are dealt to blocks of about ``block`` and the index to blocks of about ROWS, by
    a hash of key and vector. Each pair of blocks is one group of a shuffle and keeps its k
    best, so no task or driver holds more than two blocks and a tile of their product. The
    comparisons are queries times rows by nature. Exact; ties by key.
    """
    ship(index.sparkSession)
    q = queries.select(F.col(key).cast("bigint").alias("key"), F.col(vec).alias("v")).where("v is not null")
    rows = index.select(F.col(key).cast("bigint").alias("key"), F.col(vec).alias("v")).where("v is not null")
    qs, ms = max(1, -(-q.count() // block)), max(1, -(-rows.count() // ROWS))
    part = lambda n: F.pmod(F.xxhash64("key", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.select("key", "v", part(qs).alias("q"), every(ms).alias("m"))
    there = rows.select("key", "v", part(ms).alias("m"), every(qs).alias("q"))

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return _nearest_of_block(k, queries, rows)

    out = asked.groupBy("q", "m").cogroup(there.groupBy("q", "m")).applyInArrow(best, "query bigint, key bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context(hits: DataFrame, docs: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """One row: the texts of the hits, best first, joined. Hits are a handful of rows."""
    d = hits.join(docs.select(key, text), key)
    return d.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), F.col(text).alias("t")))), lambda x: x["t"]), separator).alias("context"))


def build_index(docs: DataFrame, key: str, embedding: str, path: str) -> DataFrame:
    """Normalised vectors beside their rows, as a table; embeddings may be arrays or text."""
    v = F.col(embedding)
    if dict(docs.dtypes)[embedding] == "string":
        v = parse_embedding(v)
    docs.withColumn(embedding, normalize(v)).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def load_index(spark: SparkSession, path: str, key: str, embedding: str) -> DataFrame:
    """A stored index; rows without key or vector, vectors that differ in length and repeated keys are an error, found in one pass."""
    d = spark.read.parquet(path)
    per = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(embedding)).alias("low"), F.max(F.size(embedding)).alias("high"), F.count(embedding).alias("set"))
    f = per.agg(F.count_if(F.col(key).isNull() | (F.col("set") < F.col("n"))).alias("bare"), F.count_if(F.col("n") > 1).alias("twice"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if f.bare or f.twice or f.low != f.high:
        raise ValueError(f"{path}: {f.bare} keys or vectors missing, {f.twice} keys repeated, lengths {f.low} to {f.high}")
    return d


def count_mismatch(vectors: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """One row: vectors without document and documents without vector."""
    v, d = vectors.select(key), docs.select(key)
    a = v.join(d, key, "left_anti").agg(F.count(F.lit(1)).alias("no_document"))
    return a.crossJoin(d.join(v, key, "left_anti").agg(F.count(F.lit(1)).alias("no_vector")))
