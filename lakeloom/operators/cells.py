"""A vector index in cells: exact top-k that reads only the cells which may hold an answer.

Vectors are normalised and go to the cell of the nearest of some centres. Each cell knows how
far, as an angle, its vectors lie from the centre; with the query's angle to the centre that
bounds their cosine from above, and cells below the k-th best answer are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lakeloom.operators.vectors import inner_product, normalize, parse_embedding
from lakeloom.scratch import cut, fresh, release
from lakeloom.session import ship

#: Vectors that centres are chosen from, and the most centres: both bound what the driver holds.
SAMPLE, CELLS = 4_096, 1_024
_SLACK = 1e-7


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors, each the farthest from those before; fewer if they repeat."""
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(n, len(sample)) and near.min() < 1.0 - 1e-12:
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def _place(centres: np.ndarray, embedding: str, cell: str, cosine: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the nearest centre's number and the cosine with it."""
    for b in batches:
        if b.num_rows:
            scores = b[embedding].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ centres.T
            yield b.append_column(cell, pa.array(scores.argmax(1).astype(np.int32))).append_column(cosine, pa.array(scores.max(1)))


def build_cells(docs: DataFrame, key: str, embedding: str, path: str, cells: int = 256) -> None:
    """Write the index of docs under ``path``: rows with the normalised vector by cell, and the cells' bounds.

    Embeddings are arrays or text. Rows without key or vector are left out; vectors of
    different lengths are an error. ``cells`` up to CELLS; centres are fitted on SAMPLE rows
    at most, every row is indexed.
    """
    v = parse_embedding(F.col(embedding)) if dict(docs.dtypes)[embedding] == "string" else F.col(embedding)
    cell, cosine = fresh(docs, "cell"), fresh(docs, "cosine")
    rows = cut(docs.where(F.col(key).isNotNull()).withColumn(embedding, normalize(v)).where(F.col(embedding).isNotNull()), "vectors")
    ends = rows.agg(F.min(F.size(embedding)).alias("low"), F.max(F.size(embedding)).alias("high")).first()
    if ends.low != ends.high:
        raise ValueError(f"vectors of {ends.low} to {ends.high} numbers")
    some = [r[0] for r in rows.orderBy(F.xxhash64(key), key).select(embedding).limit(SAMPLE).collect()]
    if not some:
        raise ValueError("no vectors to index")
    centres = _centres(np.array(some, float), min(cells, CELLS))
    kind = StructType([*rows.schema.fields, StructField(cell, IntegerType()), StructField(cosine, DoubleType())])
    ship(docs.sparkSession)
    placed = rows.mapInArrow(partial(_place, centres, embedding, cell, cosine), kind)
    # a cell may hold a large share of all rows: its partition is split where it is too large
    placed.hint("rebalance", cell).write.mode("overwrite").partitionBy(cell).parquet(f"{path}/rows")
    written = docs.sparkSession.read.schema(kind).parquet(f"{path}/rows")
    bounds = written.groupBy(F.col(cell).alias("cell")).agg(F.min(cosine).alias("cosine"), F.count(F.lit(1)).alias("n"))
    named = docs.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    bounds.join(F.broadcast(named), "cell").select("cell", "centre", "cosine", "n", F.lit(key).alias("key"), F.lit(embedding).alias("embedding"), F.lit(cell).alias("column"), F.lit(cosine).alias("distance")).write.mode("overwrite").parquet(f"{path}/cells")
    release(rows)


@dataclass(frozen=True)
class CellIndex:
    """An index of at least one vector that build_cells() wrote; it holds the cells' bounds, CELLS rows at most."""

    spark: SparkSession
    path: str
    key: str
    embedding: str
    column: str
    centres: np.ndarray
    angle: np.ndarray
    sizes: np.ndarray
    cells: list[int]

    def rows(self, cells: list[int]) -> DataFrame:
        """The rows of some cells; no other cell's files are read."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col(self.column).isin(cells))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The largest cosine that each cell may hold."""
        there = np.arccos(np.clip(self.centres @ query, -1.0, 1.0))
        return np.cos(np.maximum(0.0, there - self.angle)) + _SLACK

    def top_k(self, query: list[float], k: int) -> tuple[DataFrame, float]:
        """(key, score) of the k nearest, ties by key, and the share of the vectors that was read.

        The most promising cells that hold k rows together give a score that answers have
        to reach; then the cells that may reach it are read. A query of another length than
        the vectors is an error.
        """
        q = np.asarray(query, float)
        if len(q) != self.centres.shape[1]:
            raise ValueError(f"a query of {len(q)} numbers for vectors of {self.centres.shape[1]}")
        if k < 1:
            return self.rows([]).select(self.key, F.lit(0.0).alias("score")), 0.0
        length = float(np.sqrt(q @ q))
        q = q / length if length else q
        bound = self.bounds(q) if length else np.full(len(self.cells), 1.0)
        order = np.argsort(-bound, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1]
        near = self._best(first, q, k)
        least = near.agg(F.min("score"), F.count(F.lit(1))).first()
        used = order if least[1] < k else np.union1d(first, np.flatnonzero(bound >= least[0] - _SLACK))
        return self._best(used, q, k), float(self.sizes[used].sum() / self.sizes.sum())

    def _best(self, places: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
        score = inner_product(F.col(self.embedding), F.array(*(F.lit(float(x)) for x in q)))
        return self.rows([self.cells[i] for i in places]).select(self.key, score.alias("score")).orderBy(F.desc("score"), self.key).limit(k)


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    found = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    if not found:
        raise ValueError(f"{path}: an index without vectors")
    one = found[0]
    angle = np.arccos(np.clip([r.cosine for r in found], -1.0, 1.0)) + _SLACK
    return CellIndex(spark, path, one.key, one.embedding, one.column, np.array([r.centre for r in found]), angle, np.array([r.n for r in found]), [r.cell for r in found])
