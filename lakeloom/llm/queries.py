"""The operators' queries, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import chat, decontaminate, hard_negatives, language_id, line_clean, near_dedup, oracles, packing, periodic, repeats, token_counts, token_records, url_filter, warc
from lakeloom.llm.common import table
from lakeloom.session import text_batches


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for every context limit, over all documents."""
    return token_counts.limit_table(token_counts.histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents"))))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 6) for c in ("score", "threshold")})


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_log(chat.messages_as_stream(talks)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.sample(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))[0]


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removal(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", repeats.removed_bytes(F.col("spans")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_records.write_records(table(spark, sf_dir, "documents"), token_records.record_path(spark), token_records.default_vocabulary())
    return token_records.read_records(files, with_ids=False).drop("ids")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_clean.line_clean(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", "n_navigation", "n_noise", "n_boilerplate", "n_punctuation",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.with_planted_period(table(spark, sf_dir, "documents")))
    by_length = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))))
    found = found.withColumn("longest", F.get(by_length, F.lit(0)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    start, length, period = (F.col(f"longest.{c}") for c in ("start", "length", "period"))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    found = hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, scale=256.0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_path(spark))
    read = warc.read_archives(written, with_payload=False).where("record_type IN ('response', 'revisit')")
    page_id = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("bigint")
    return read.select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))


_ALL = (op1_token_counts, op2_url_filter, op3_chat_format, op4_language_id, op5_packing, op6_suffix_dedup, op7_token_records, op8_near_dedup, op9_line_clean, op10_decontaminate, op11_periodic_runs, op12_hard_negatives, op13_warc)

ORACLES: dict[str, str] = {"op2_url_filter": oracles.OP2, "op3_chat_format": oracles.OP3, "op6_suffix_dedup": oracles.OP6, "op8_near_dedup": oracles.OP8, "op9_line_clean": oracles.OP9, "op10_decontaminate": oracles.OP10, "op12_hard_negatives": oracles.OP12, "op13_warc": oracles.OP13}


def _on_texts(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _on_texts(f) for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
