"""The pipeline's stages against plain versions of what they must do."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import AWKWARD, CLASH


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "packing"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            assert {r.doc_id: r.text for r in docs.collect()} == before and {"batch_id", "bucket", "n_tokens"} <= set(docs.columns)
            break
        assert docs.columns == columns
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= ids and all(r.n_chars == len(r.text) for r in rows)
        if name == "near_dedup":
            assert set(after) == {c for _, c in brute.near(list(before.items()), percent=80).values()}
        if name == "suffix_dedup":
            for (i, t), (_, removed, _, kept) in zip(before.items(), brute.repeats(list(before.values()))):
                want = kept.decode("utf-8", "ignore") if removed else t
                assert after.get(i, "").strip() == want.strip()
        if name == "decontaminate":
            for (i, t), (n, hit, _) in zip(before.items(), brute.benchmark_hits(list(before.values()), items)):
                assert (after[i] == t) if not hit else (i not in after) == (len(hit) == n)


def test_language_stage_follows_the_model(spark, sf_dir):
    """Noise goes by the parse alone: it has letters, and goes only where a language was learned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=3000))
    more = docs.limit(1).select(*(F.lit(-5).cast("bigint").alias(c) if c == "doc_id" else F.lit(noise).alias(c) if c == "text" else c for c in docs.columns))
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    every = docs.unionByName(more)
    assert {r.doc_id for r in stage(spark, every, sf_dir).collect()} == {r.doc_id for r in docs.collect()}
    blind = every.withColumn("lang", F.lit(None).cast("string"))
    assert stage(spark, blind, sf_dir).count() == every.count()


def test_run_ends_in_batches(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "batch_id", "bucket"} <= set(out.columns)


def run_over(spark, sf_dir, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    out = run_over(spark, sf_dir, tmp_path, docs)
    assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns


def test_run_on_nulls_repeats_and_clashing_names(spark, sf_dir, tmp_path):
    """Nulls in every column, rows and ids that repeat, blank texts, and extra columns named like the operators' own."""
    kinds = CLASH.replace("n_chars bigint", "n_chars int")
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s" if i else None, None, *["x"] * (CLASH.count(",") - 4)) for i, t in AWKWARD]
    out = run_over(spark, sf_dir, tmp_path, spark.createDataFrame(rows, kinds).repartition(3))
    got = out.collect()
    asked = [c.split()[0] for c in CLASH.split(", ")]
    assert out.columns[: len(asked)] == asked
    texts = [r.text for r in got]
    assert all(texts) and [(r.n_chars, r.node) for r in got] == [(len(r.text), "x") for r in got]
    kept = {r.doc_id for r in got}
    assert {3, 13, 15} <= kept and not kept & {0, 1, 2}  # null and blank texts go
    assert len(texts) == len(set(texts))  # one of each group of copies
