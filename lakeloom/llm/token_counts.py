"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by length; suffix sums over the histogram then answer, for every
context limit, how many documents exceed it and how many tokens truncation to it leaves.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, fresh, map_arrow

_ENCODERS: dict = {}


def byte_bpe(path: str, pattern: str):
    """The encoder of a public rank file, loaded once per Python worker."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def with_lengths(docs: DataFrame, name: str, keep: Sequence[str] = ("doc_id",), *, path: str | None = None, pattern: str | None = None, end: int = 0) -> DataFrame:
    """The columns ``keep`` of docs and the length of every whole text by the byte-level vocabulary at ``path``.

    ``end`` ids are added to each. Null or empty text has no tokens of its own. Repeated
    rows stay. Columns that are not kept are not read, the text apart.
    """
    if path is None:
        import public_tokenizers as P

        path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    text = fresh(docs, "_text")
    d = docs.select(*keep, F.col("text").cast("string").alias(text), F.lit(0).cast("bigint").alias(name))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = byte_bpe(path, pattern)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) + end if t else end for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(n, pa.int64())], [*keep, name])

    return map_arrow(d, count, d.drop(text).schema)


def encoded_lengths(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every whole text; see with_lengths()."""
    return with_lengths(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "n_tokens", path=path, pattern=pattern)


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): exact, one row per distinct length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(hist: DataFrame, width: int = 1024) -> DataFrame:
    """For each length that occurs, taken as a context limit L, the answers by suffix sums.

    n_tokens (= L), n_docs of that length, docs_up_to and docs_over (lengths <= L and > L),
    tokens_up_to, tokens_over, truncated_total (sum of min(length, L)), fraction_up_to (the
    quantile at which L stands). The answers at a limit that does not occur follow from the
    next lower row: docs_over is the same and truncated_total grows by docs_over for each
    token, so the table answers every limit; see truncated_total().

    Sums run inside ranges of ``width`` lengths and then over the ranges' totals, so no
    task has to see the whole histogram. It is written once, as it is read twice here. An
    empty histogram gives no rows.
    """
    h = cut(hist, "histogram").select(F.col("n_tokens").cast("bigint"), F.col("n_docs").cast("bigint"), F.floor(F.col("n_tokens") / width).alias("r"))
    h = h.withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    upward = Window.orderBy(F.col("r").desc())
    over = lambda c, w: F.sum(c).over(w) - F.col(c)
    totals = h.groupBy("r").agg(F.sum("n_docs").alias("rd"), F.sum("t").alias("rt"))
    totals = totals.select("r", over("rd", upward).alias("rd_over"), over("rt", upward).alias("rt_over"), F.sum("rd").over(Window.partitionBy()).alias("all_d"), F.sum("rt").over(Window.partitionBy()).alias("all_t"))
    inside = Window.partitionBy("r").orderBy(F.col("n_tokens").desc())
    h = h.join(totals, "r").select(
        "n_tokens", "n_docs", (over("n_docs", inside) + F.col("rd_over")).alias("docs_over"), (over("t", inside) + F.col("rt_over")).alias("tokens_over"), "all_d", "all_t",
    )
    return h.select(
        "n_tokens", "n_docs", (F.col("all_d") - F.col("docs_over")).alias("docs_up_to"), "docs_over",
        (F.col("all_t") - F.col("tokens_over")).alias("tokens_up_to"), "tokens_over",
        (F.col("all_t") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("all_d") - F.col("docs_over")) / F.col("all_d")).alias("fraction_up_to"),
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut to ``limit``, from limit_table()."""
    low = limits.where(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("n_tokens", "truncated_total", "docs_over"), "n_tokens").alias("b"))
    every = limits.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"))
    return low.crossJoin(F.broadcast(every)).select(
        F.lit(limit).cast("bigint").alias("n_tokens"),
        F.when(F.col("b").isNull(), limit * F.col("docs")).otherwise(F.col("b.truncated_total") + (limit - F.col("b.n_tokens")) * F.col("b.docs_over")).cast("bigint").alias("truncated_total"),
    )


def quantiles(limits: DataFrame, at: list[float]) -> DataFrame:
    """(q, n_tokens): the least length that at least a share q of the documents does not exceed."""
    return limits.agg(*(F.min(F.when(F.col("fraction_up_to") >= q, F.col("n_tokens"))).alias(f"v{i}") for i, q in enumerate(at))).select(
        F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), F.col(f"v{i}").alias("n_tokens")) for i, q in enumerate(at)))).alias("x")
    ).select("x.q", "x.n_tokens")
