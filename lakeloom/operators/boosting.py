"""Boosted trees by gradients and hessians, and their scoring as a column expression.

Columns are cut into bins at their quantiles once. Every level of a tree is one aggregate:
tasks add up gradients and hessians by (node, column, bin), Spark sums the tasks' cells, and
the driver picks splits from some thousand sums, whatever the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.scratch import cut, release
from lakeloom.session import ship


@dataclass(frozen=True)
class Params:
    """How trees are grown. The shares are drawn anew for each tree."""

    rounds: int = 100
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    min_gain: float = 0.0
    min_weight: float = 1.0
    rows: float = 0.9
    columns: float = 0.9
    bins: int = 256
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: the children of inner node i are 2i+1 and 2i+2, the leaves come last.

    A row goes right if its value is not below the threshold, or is missing and ``missing``
    says so. Where nothing is split, every row goes left.
    """

    column: list[int]
    threshold: list[float]
    missing: list[bool]
    leaf: list[float]


@dataclass(frozen=True)
class TreeModel:
    """Trees over named columns, added to ``base``; ``objective`` is logistic or squared."""

    columns: list[str]
    objective: str
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TreeModel:
        x = json.loads(text)
        return cls(x["columns"], x["objective"], x["base"], x["depth"], [Tree(**t) for t in x["trees"]])

    def margin(self) -> Column:
        """The sum of the trees for a row, as an expression in the JVM; the trees are one constant in the plan."""
        if not self.trees:
            return F.lit(self.base)
        kind = "array<struct<column:array<int>,threshold:array<double>,missing:array<boolean>,leaf:array<double>>>"
        trees = F.from_json(F.lit(json.dumps([asdict(t) for t in self.trees])), kind)
        x = F.array(*(number(c) for c in self.columns))
        inner = 2**self.depth - 1

        def leaf(t: Column) -> Column:
            right = lambda i: F.coalesce(F.get(x, F.get(t["column"], i)) >= F.get(t["threshold"], i), F.get(t["missing"], i))
            walk = F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), lambda i, _: 2 * i + 1 + right(i).cast("int"))
            return F.get(t["leaf"], walk - inner)

        return F.aggregate(trees, F.lit(self.base), lambda s, t: s + leaf(t))

    def prediction(self) -> Column:
        """The probability of class 1, or the value of a regression."""
        return 1.0 / (1.0 + F.exp(-self.margin())) if self.objective == "logistic" else self.margin()

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        return cls.from_json(spark.read.text(path, wholetext=True).first().value)


def number(c: str) -> Column:
    """A column as a double, NaN as null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


# --- what tasks do


def walk(tree: Tree, x: np.ndarray, depth: int, go: str = "value") -> np.ndarray:
    """The node of each row at ``depth``, counted from the level's first; x has values, missing ones NaN."""
    at = np.zeros(len(x), np.int64)
    column, threshold, missing = np.array(tree.column), np.array(tree.threshold), np.array(tree.missing)
    rows = np.arange(len(x))
    for _ in range(depth):
        v = x[rows, column[at]]
        with np.errstate(invalid="ignore"):
            right = np.where(np.isnan(v), missing[at], v >= threshold[at])
        at = 2 * at + 1 + right
    return at - (2**depth - 1)


def sampled(ids: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree is grown on, by a hash of the row, the tree and the seed."""
    x = ids.astype(np.uint64) + np.uint64(((seed << 20) + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


_BLOCK = pa.schema([("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("margin", pa.binary()), ("ids", pa.binary())])


def _blocks(width: int, base: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as blocks: values (missing ones NaN), label, margin and number of each row."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 36
    for b in batches:
        if n := b.num_rows:
            x = np.column_stack([b[f"x{i}"].to_numpy(zero_copy_only=False) for i in range(width)]).astype(np.float64)
            y = b["y"].to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_pylist([{"n": n, "x": x.tobytes(), "y": y.tobytes(), "margin": np.full(n, base).tobytes(), "ids": np.arange(at, at + n).tobytes()}], _BLOCK)
            at += n


def _opened(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = b["n"][k].as_py()
    x, y, margin = (np.frombuffer(b[c][k].as_py(), np.float64) for c in ("x", "y", "margin"))
    return x.reshape(n, -1), y, margin, np.frombuffer(b["ids"][k].as_py(), np.int64)


def _grown(x: np.ndarray, margin: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    for t in trees:
        margin = margin + np.array(t.leaf)[walk(t, x, depth)]
    return margin


def _advance(trees: list[Tree], depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the trees added to their margins."""
    for b in batches:
        new = [_grown(x, m, trees, depth).tobytes() for x, _, m, _ in (_opened(b, k) for k in range(b.num_rows))]
        yield b.set_column(3, "margin", pa.array(new, pa.binary()))


def gradients(objective: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y, np.maximum(p * (1.0 - p), 1e-16)
    return margin - y, np.ones(len(y))


def _sums(job: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, g, h) of a task's rows; a cell is a (node, column, bin), bin 0 holds missing values."""
    edges, width, wide = job["edges"], len(job["edges"]), job["bins"]
    g_all = h_all = None
    for b in batches:
        for k in range(b.num_rows):
            x, y, margin, ids = _opened(b, k)
            keep = sampled(ids, job["tree"], job["rows"], job["seed"])
            x, y, margin = x[keep], y[keep], margin[keep]
            g, h = gradients(job["objective"], y, _grown(x, margin, job["since"], job["depth"]))
            node = walk(job["growing"], x, job["level"])
            if g_all is None:
                g_all, h_all = np.zeros((2, 2 ** job["level"] * width * wide))
            for f in job["columns"]:
                v = x[:, f]
                place = (node * width + f) * wide + np.where(np.isnan(v), 0, 1 + np.searchsorted(edges[f], v, side="right"))
                g_all += np.bincount(place, g, len(g_all))
                h_all += np.bincount(place, h, len(h_all))
    if g_all is not None:
        cell = np.flatnonzero(h_all)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(g_all[cell]), pa.array(h_all[cell])], ["cell", "g", "h"])


# --- what the driver does


def best_splits(g: np.ndarray, h: np.ndarray, columns: list[int], edges: list[np.ndarray], p: Params) -> list[tuple[int, int, bool, float, float, float, float] | None]:
    """For each node (column, bin edge, missing goes right, sums of the left and of the right), or None.

    g and h are sums by node, column and bin. The gain is the growth of G^2 / (H + l2). Gains
    that differ by rounding only count as equal; then the first column, edge and side win.
    """
    out = []
    for gn, hn in zip(g, h):
        best, found = max(p.min_gain, 1e-10), None
        for f in columns:
            n = len(edges[f])
            if not n:
                continue
            total_g, total_h = gn[f].sum(), hn[f].sum()
            left_g, left_h = np.cumsum(gn[f, 1 : n + 1]), np.cumsum(hn[f, 1 : n + 1])
            for right in (True, False):
                a, b = (left_g, left_h) if right else (left_g + gn[f, 0], left_h + hn[f, 0])
                c, d = total_g - a, total_h - b
                gain = (a * a / (b + p.l2) + c * c / (d + p.l2) - total_g**2 / (total_h + p.l2)) / 2
                gain[(b < p.min_weight) | (d < p.min_weight)] = -np.inf
                k = int(np.argmax(gain >= gain.max() - 1e-9 * abs(gain.max()))) if np.isfinite(gain.max()) else 0
                if gain[k] > best * (1 + 1e-9):
                    best, found = float(gain[k]), (f, k, right, float(a[k]), float(b[k]), float(c[k]), float(d[k]))
        out.append(found)
    return out


def quantile_edges(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Up to bins - 2 values of each column to split below, at its quantiles; in one pass."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    row = df.agg(*(F.percentile_approx(number(c), shares, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(columns)), *(F.min(number(c)).alias(f"m{i}") for i, c in enumerate(columns))).first()
    return [np.unique([v for v in row[f"q{i}"] or () if v > row[f"m{i}"]]).astype(np.float64) for i in range(len(columns))]


#: Trees after which the rows' margins are written anew: each level walks the trees since, for all rows.
EVERY = 4


def fit_trees(df: DataFrame, columns: list[str], label: str, objective: str = "logistic", params: Params = Params(), edges: list[np.ndarray] | None = None) -> TreeModel:
    """Fit boosted trees to the rows with a label; columns are numbers, null and NaN are missing.

    A split sends missing values to the side with the larger gain. A leaf is -G / (H + l2) of
    its rows times the rate. The model starts at the mean label (its log-odds). ``edges``
    gives the values to split at, else they are quantile_edges(). Rows without a label are
    left out; without rows, or with labels of one class, there are no trees.
    """
    if objective not in ("logistic", "squared"):
        raise ValueError(f"no objective {objective}")
    ship(df.sparkSession)
    p, width = params, len(columns)
    d = df.where(number(label).isNotNull())
    mean = d.agg(F.avg(number(label))).first()[0]
    if mean is None or not columns:
        return TreeModel(list(columns), objective, 0.0 if mean is None else float(mean), p.depth)
    if objective == "logistic":
        if not 0.0 < mean < 1.0:
            return TreeModel(list(columns), objective, 36.0 if mean >= 1.0 else -36.0, p.depth)
        base = float(np.log(mean / (1.0 - mean)))
    else:
        base = float(mean)
    edges = quantile_edges(d, columns, p.bins) if edges is None else edges
    wide = max(len(e) for e in edges) + 2
    rows = d.select(*(number(c).alias(f"x{i}") for i, c in enumerate(columns)), number(label).alias("y"))
    schema = "n bigint, x binary, y binary, margin binary, ids binary"
    blocks = cut(rows.mapInArrow(partial(_blocks, width, base), schema), "boosting")
    trees: list[Tree] = []
    since: list[Tree] = []
    for t in range(p.rounds):
        drawn = np.random.default_rng((p.seed, t)).permutation(width)[: max(1, int(p.columns * width))]
        used = sorted(int(c) for c in drawn)
        inner = 2**p.depth - 1
        tree = Tree([0] * inner, [np.inf] * inner, [False] * inner, [0.0] * 2**p.depth)
        open_nodes = {0}
        for level in range(p.depth):
            if not open_nodes:
                break
            job = {"edges": edges, "bins": wide, "tree": t, "rows": p.rows, "seed": p.seed, "objective": objective, "since": since, "depth": p.depth, "growing": tree, "level": level, "columns": used}
            cells = blocks.mapInArrow(partial(_sums, job), "cell bigint, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            g, h = np.zeros((2, 2**level * width * wide))
            g[cells["cell"].to_numpy()], h[cells["cell"].to_numpy()] = cells["g"].to_numpy(), cells["h"].to_numpy()
            g, h = g.reshape(2**level, width, wide), h.reshape(2**level, width, wide)
            if not level:
                _settle(tree, 0, 0, float(g[0, used[0]].sum()), float(h[0, used[0]].sum()), p)
            below = set()
            for k, s in enumerate(best_splits(g, h, used, edges, p)):
                if s is None or k not in open_nodes:
                    continue
                f, edge, right, *sums = s
                i = 2**level - 1 + k
                tree.column[i], tree.threshold[i], tree.missing[i] = f, float(edges[f][edge]), right
                _settle(tree, level + 1, 2 * k, sums[0], sums[1], p)
                _settle(tree, level + 1, 2 * k + 1, sums[2], sums[3], p)
                below |= {2 * k, 2 * k + 1}
            open_nodes = below
        trees.append(tree)
        since.append(tree)
        if len(since) == EVERY and t + 1 < p.rounds:
            old, blocks = blocks, cut(blocks.mapInArrow(partial(_advance, since, p.depth), schema), "boosting")
            release(old)
            since = []
    release(blocks)
    return TreeModel(list(columns), objective, base, p.depth, trees)


def _settle(tree: Tree, level: int, k: int, g: float, h: float, p: Params) -> None:
    """The weight of a node of these sums, at the leaf its rows come to while nothing below splits."""
    tree.leaf[k << (p.depth - level)] = -g / (h + p.l2) * p.rate
