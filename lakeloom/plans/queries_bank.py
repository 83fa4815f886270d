"""Queries: rates, table operations, retrieval, text, chat state and usage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.functions import arithmetic
from lakeloom.functions import text as T
from lakeloom.operators import rates, relational, vectors
from lakeloom.plans.adapters import frame, sql
from lakeloom.plans.registry import register
from lakeloom.scratch import cut, drop_path, scratch

FX, SAVING = sql("rates_fx"), sql("rates_saving")
DISTINCT_FX = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY effective_date, ccy, rate_type ORDER BY last_change) AS rn FROM {FX} x WHERE branch = '001') WHERE rn = 1)"


def _fx_sql(where: str) -> str:
    return f"""SELECT ccy, rate_type, effective_date, CASE WHEN rate_type = 'TRS' THEN 'transfer' ELSE 'cash' END AS exchange_type,
        CASE WHEN rate_type IN ('TRS', 'CA1') THEN CAST(CAST(buy_rate AS DOUBLE) AS VARCHAR) || ' VND' END AS buying_price,
        CASE WHEN rate_type IN ('TRS', 'CA3') THEN CAST(CAST(sell_rate AS DOUBLE) AS VARCHAR) || ' VND' END AS selling_price
        FROM {DISTINCT_FX} r WHERE rate_type IN ('CA1', 'CA3', 'TRS') AND {where}"""


@register("fx_rates", _fx_sql("ccy IN ('USD', 'EUR') AND rate_type LIKE 'CA%'"))
def _(spark, d):
    return rates.exchange_rates(_fx(spark, d), ["USD", "EUR"], "CA")


@register("fx_rates_as_of_filter", _fx_sql("ccy IN ('USD', 'JPY') AND effective_date <= TIMESTAMP '2024-02-01'"))
def _(spark, d):
    return rates.exchange_rates(_fx(spark, d), ["USD", "JPY"], "", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


def _fx(spark, d):
    f = frame(spark, d, "rates_fx")
    return f.withColumns({"effective_date": F.col("effective_date").cast("timestamp_ntz"), "buy_rate": F.col("buy_rate").cast("double"), "sell_rate": F.col("sell_rate").cast("double")})


@register("fx_distinct_on", f"SELECT effective_date, ccy, rate_type, last_change FROM {DISTINCT_FX} r")
def _(spark, d):
    return relational.distinct_on(_fx(spark, d).where("branch = '001'"), ["effective_date", "ccy", "rate_type"], ["last_change"]).select("effective_date", "ccy", "rate_type", "last_change")


@register("fx_cross_rate", f"SELECT a.effective_date, a.rate_type, round(CAST(a.buy_rate AS DOUBLE) / nullif(CAST(b.sell_rate AS DOUBLE), 0), 6) AS cross_rate FROM {DISTINCT_FX} a JOIN {DISTINCT_FX} b ON a.effective_date = b.effective_date AND a.rate_type = b.rate_type WHERE a.ccy = 'USD' AND b.ccy = 'EUR'")
def _(spark, d):
    return rates.cross_rate(_fx(spark, d), "USD", "EUR").withColumn("cross_rate", F.round("cross_rate", 6))


def _replaced(column: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for old, new in pairs:
        column = f"replace({column}, '{old}', '{new}')"
    return column


def _listed(codes: tuple[str, ...]) -> str:
    return "product_type IN (" + ", ".join(f"'{c}'" for c in codes) + ")"


_TERM_NAME = _replaced("term", T.TERM_WORDS)
_TERM_DAYS = "CAST(regexp_replace(term, '[^0-9]', '', 'g') AS INTEGER) * CASE " + " ".join(f"WHEN position('{u}' IN term) > 0 THEN {n}" for u, n in T.TERM_DAYS) + f" ELSE {T.OTHER_TERM_DAYS} END"
_PRODUCT_NAME = "CASE " + " ".join(
    [*(f"WHEN product_type = '{c}' AND ccy = 'VND' THEN '{n}' WHEN product_type = '{c}' THEN '{rates.FOREIGN}'" for c, n in rates.HOME_NAMES.items()), *(f"WHEN product_type = '{c}' THEN '{n}'" for c, n in rates.NAMES.items()), "ELSE product_type END"]
)


def _savings_sql(where: str = "TRUE") -> str:
    return f"""SELECT id, CASE WHEN {_listed(rates.PERSONAL_CODES)} THEN '{rates.CLIENTS[0]}' WHEN {_listed(rates.BUSINESS_CODES)} THEN '{rates.CLIENTS[1]}' END AS client_type,
        CASE WHEN {_listed(rates.ONLINE_CODES)} THEN '{rates.PLACES[0]}' WHEN {_listed(rates.COUNTER_CODES)} THEN '{rates.PLACES[1]}' END AS saving_type,
        {_PRODUCT_NAME} AS product_name, product_type, {_TERM_NAME} AS term_name, {_TERM_DAYS} AS term_day,
        coalesce({_replaced("cr_int_freq", T.PAYMENT_WORDS)}, '{T.AT_THE_END}') AS int_freq, cr_int_freq, regexp_replace(CAST(actual_rate AS VARCHAR), '\\.0$', '') || '%/năm' AS full_rate, balance, ccy
        FROM (SELECT * REPLACE (CAST(actual_rate AS DOUBLE) AS actual_rate) FROM {SAVING} z) r WHERE (ccy != 'VND' OR actual_rate > 0) AND {where}"""


@register("savings_rates", _savings_sql())
def _(spark, d):
    return rates.savings_rates(_saving(spark, d))


def _saving(spark, d):
    return frame(spark, d, "rates_saving").withColumn("actual_rate", F.col("actual_rate").cast("double"))


@register("savings_rates_expanded", _savings_sql("product_type IN ('524', 'TDE') AND int_type IN ('IT1', 'TDE') AND term IN ('6M', '1Y', '17D')"))
def _(spark, d):
    products, interest = rates.expand_products("")
    return rates.savings_rates(_saving(spark, d), products, interest, ["6M", "1Y", "17D"])


@register("savings_tiers", f"""WITH a AS ({_savings_sql()}), b AS (SELECT *, CASE WHEN coalesce(balance, 0) <> 0 THEN format('{{:,}}', balance) || ' VND' ELSE '' END AS from_amount FROM a)
    SELECT id, from_amount, CASE WHEN lead(id) OVER w IS NOT NULL AND lead(ccy) OVER w IS NOT DISTINCT FROM ccy THEN 'dưới ' || lead(from_amount) OVER w ELSE '' END AS to_amount
    FROM b WINDOW w AS (ORDER BY product_type NULLS LAST, term_day NULLS LAST, cr_int_freq NULLS LAST, balance NULLS LAST, id NULLS LAST)""")
def _(spark, d):
    return rates.savings_tiers(rates.savings_rates(_saving(spark, d))).select("id", "from_amount", "to_amount")


@register("term_text", f"SELECT id, {_TERM_NAME} AS term_name FROM {SAVING} r")
def _(spark, d):
    return _saving(spark, d).select("id", T.term_name(F.col("term")).alias("term_name"))


@register("term_days", f"SELECT id, {_TERM_DAYS} AS term_day FROM {SAVING} r")
def _(spark, d):
    return _saving(spark, d).select("id", T.term_days(F.col("term")).alias("term_day"))


@register("interest_amount", f"SELECT id, round(balance * CAST(actual_rate AS DOUBLE) / 100 / 12 * 3, 4) AS interest FROM {SAVING} r")
def _(spark, d):
    return _saving(spark, d).select("id", F.round(rates.interest_amount(F.col("balance"), F.col("actual_rate"), F.lit(3)), 4).alias("interest"))


OLD, NEW = sql("settings_old"), sql("settings_new")


@register("setting_upsert", f"SELECT coalesce(o.id, n.id) AS id, coalesce(o.create_at, n.create_at) AS create_at, coalesce(n.update_at, o.update_at) AS update_at, coalesce(n.config, o.config) AS config FROM {OLD} o FULL JOIN {NEW} n ON o.id = n.id")
def _(spark, d):
    return relational.upsert(frame(spark, d, "settings_old"), frame(spark, d, "settings_new"), "id", ["update_at", "config"])


@register("tail_append", "SELECT c_custkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) WHERE rn > 70")
def _(spark, d):
    return relational.tail_beyond(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment"), 70, "c_custkey")


@register("key_difference", f"SELECT id FROM {OLD} o EXCEPT SELECT id FROM {NEW} n")
def _(spark, d):
    return relational.key_difference(frame(spark, d, "settings_old"), frame(spark, d, "settings_new"), "id")


@register("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return relational.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@register("orphan_rows", "SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return relational.orphans(docs.select("doc_id", "lang"), "doc_id", labels, "doc_id")


SLOTS = sql("slots")
_LAST = f"""(SELECT user_id, arg_max(muc_dich, seq) FILTER (muc_dich IS NOT NULL) AS muc_dich, arg_max(thu_nhap, seq) FILTER (thu_nhap IS NOT NULL) AS thu_nhap,
    arg_max(han_muc, seq) FILTER (han_muc IS NOT NULL) AS han_muc FROM {SLOTS} s GROUP BY 1)"""
_SLOT_NAMES = ["muc_dich", "thu_nhap", "han_muc"]


def _slots(spark, d):
    return relational.last_non_null(frame(spark, d, "slots"), "user_id", "seq", _SLOT_NAMES)


@register("slots_last_non_null", f"SELECT * FROM {_LAST} x")
def _(spark, d):
    return _slots(spark, d)


@register("next_slot", f"SELECT user_id, CASE WHEN muc_dich IS NULL THEN 'muc_dich' WHEN thu_nhap IS NULL THEN 'thu_nhap' WHEN han_muc IS NULL THEN 'han_muc' END AS next_slot FROM {_LAST} x")
def _(spark, d):
    return _slots(spark, d).select("user_id", relational.first_unmet(_SLOT_NAMES).alias("next_slot"))


@register("slots_complete", f"SELECT user_id, muc_dich IS NOT NULL AND thu_nhap IS NOT NULL AND han_muc IS NOT NULL AS complete FROM {_LAST} x")
def _(spark, d):
    return _slots(spark, d).select("user_id", relational.all_set(_SLOT_NAMES).alias("complete"))


_UNIT = "list_transform(embedding, lambda x: CASE WHEN n = 0 THEN 0.0 ELSE CAST(x AS DOUBLE) / n END)"
_VECS = f"(SELECT vec_id, label, {_UNIT} AS u FROM (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings))"


def _emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


@register("vec_normalize", f"SELECT vec_id, round(u[1], 6) AS first, round(u[len(u)], 6) AS last, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS squared FROM {_VECS} v")
def _(spark, d):
    u = _emb(spark, d).select("vec_id", vectors.normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(vectors.inner_product(F.col("u"), F.col("u")), 6).alias("squared"))


def _query(spark, d):
    return [float(x) for x in _emb(spark, d).where("vec_id = 0").first()["embedding"]]


TOP5 = f"(SELECT v.vec_id, list_inner_product(v.u, q.u) AS score FROM {_VECS} v, (SELECT u FROM {_VECS} w WHERE vec_id = 0) q ORDER BY score DESC, v.vec_id LIMIT 5)"


@register("vec_topk", f"SELECT vec_id, round(score, 6) AS score FROM {TOP5} t")
def _(spark, d):
    return vectors.top_k(_emb(spark, d), "vec_id", "embedding", _query(spark, d), 5).withColumn("score", F.round("score", 6))


@register("vec_topk_batch", f"""SELECT query, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT q.vec_id AS query, v.vec_id AS key, list_inner_product(v.u, q.u) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(v.u, q.u) DESC, v.vec_id) AS rank
    FROM {_VECS} q, {_VECS} v WHERE q.vec_id % 20 = 0) WHERE rank <= 3""")
def _(spark, d):
    e = _emb(spark, d)
    return vectors.batched_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3).select("query", "key", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@register("vec_dim_check", "SELECT vec_id, len(embedding) AS dim FROM embeddings WHERE len(embedding) <> 32")
def _(spark, d):
    return vectors.bad_dimensions(_emb(spark, d), "embedding", 32).select("vec_id", F.size("embedding").cast("bigint").alias("dim"))


@register("vec_count_mismatch", "SELECT (SELECT count(*) FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id)) AS no_document, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE d.doc_id = e.vec_id)) AS no_vector")
def _(spark, d):
    v = _emb(spark, d).select(F.col("vec_id").alias("id"))
    return vectors.count_mismatch(v, spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id")), "id")


@register("context_join", f"SELECT string_agg(d.text, chr(10) || chr(10) ORDER BY t.score DESC, t.vec_id) AS context FROM {TOP5} t JOIN documents d ON d.doc_id = t.vec_id")
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "text")
    return vectors.context(vectors.top_k(_emb(spark, d), "vec_id", "embedding", _query(spark, d), 5), docs, "vec_id", "text")


CHAT = sql("chat_pairs")
_PAIRS = f"(SELECT user_id, turn, said, nxt FROM (SELECT user_id, turn, said, role, lead(said) OVER w AS nxt, lead(role) OVER w AS nrole FROM {CHAT} c WINDOW w AS (PARTITION BY user_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant')"


def _pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("turn")
    c = frame(spark, d, "chat_pairs").withColumns({"nxt": F.lead("said").over(w), "nrole": F.lead("role").over(w)})
    return c.where("role = 'user' AND nrole = 'assistant'").select("user_id", "turn", "said", "nxt")


@register("history_last2", f"SELECT user_id, turn, said AS \"user\", nxt AS ai FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn DESC) AS rn FROM {_PAIRS} p) WHERE rn <= 2")
def _(spark, d):
    return relational.last_turns(_pairs(spark, d), "user_id", "turn", 2).select("user_id", "turn", F.col("said").alias("user"), F.col("nxt").alias("ai"))


@register("history_text", f"SELECT user_id, string_agg('H: ' || coalesce(said, '') || chr(10) || 'A: ' || coalesce(nxt, ''), chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn DESC) AS rn FROM {_PAIRS} p) WHERE rn <= 2 GROUP BY 1")
def _(spark, d):
    last = relational.last_turns(_pairs(spark, d), "user_id", "turn", 2)
    line = F.struct("turn", T.history_line(F.col("said"), F.col("nxt")).alias("line"))  # two at most for each user
    return last.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("history"))


ANSWERS = sql("answers")


@register("json_label", f"SELECT page_id, coalesce(json_extract_string(regexp_extract(raw, '(?s)\\{{.*\\}}', 0), '$.response'), 'OTHERS') AS label FROM {ANSWERS} a")
def _(spark, d):
    return frame(spark, d, "answers").select("page_id", T.json_label(F.col("raw")).alias("label"))


@register("route_label", f"SELECT page_id, CASE WHEN position('PRODUCT_INFO' IN raw) > 0 THEN 'PRODUCT_INFO' WHEN position('CREDIT_CARD' IN raw) > 0 THEN 'CREDIT_CARD' ELSE 'OTHERS' END AS agent FROM {ANSWERS} a")
def _(spark, d):
    return frame(spark, d, "answers").select("page_id", T.route_label(F.col("raw")).alias("agent"))


@register("strip_fences", f"SELECT page_id, trim(replace(replace(raw, '```json', ''), '```', ''), ' ') AS body FROM {ANSWERS} a")
def _(spark, d):
    return frame(spark, d, "answers").select("page_id", T.strip_fences(F.col("raw")).alias("body"))


@register("md_links", f"SELECT page_id, replace(regexp_replace(answer, '\\[.*?\\]\\((https?://[^\\s)]+)\\)', '\\1', 'g'), chr(10) || chr(10), chr(10)) AS answer FROM {sql('md_text')} m")
def _(spark, d):
    return frame(spark, d, "md_text").select("page_id", T.links_to_urls(F.col("answer")).alias("answer"))


@register("template_fill", "SELECT page_id, 'Page ' || CAST(page_id AS VARCHAR) || ' at ' || url || '.' AS prompt FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.fill_template("Page ${ID} at ${URL}.", {"ID": F.col("page_id").cast("string"), "URL": F.col("url")}).alias("prompt"))


@register("prefix_snippet", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS snippet FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.snippet(F.col("text"), 500).alias("snippet"))


@register("user_hash", "SELECT c_custkey, md5(c_name) AS hash FROM customer")
def _(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.md5("c_name").alias("hash"))


@register("arithmetic_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 2.5 WHEN p_partkey % 3 = 1 THEN p_size / 4.0 END AS value FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(" + 2.5"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("/4"))).otherwise(F.concat(size, F.lit("; drop")))
    return p.select("p_partkey", arithmetic.two_operand(text).alias("value"))


@register("usage_running_tokens", f"SELECT handler, seq, CAST(sum(prompt_tokens) OVER w AS BIGINT) AS cumulative_input_tokens, CAST(sum(completion_tokens) OVER w AS BIGINT) AS cumulative_output_tokens FROM {sql('usage_log')} u WINDOW w AS (PARTITION BY handler ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    u = relational.running_totals(frame(spark, d, "usage_log"), "handler", "seq", {"prompt_tokens": "cumulative_input_tokens", "completion_tokens": "cumulative_output_tokens"})
    return u.select("handler", "seq", "cumulative_input_tokens", "cumulative_output_tokens")


@register("head_cap", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100")
def _(spark, d):
    return relational.head_cap(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), 100, 100, ["c_custkey"])


@register("head_cap_wide", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM customer) <= 500 OR c_custkey IN (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 200)")
def _(spark, d):
    """Over 500 rows the first 200 stay; 500 and fewer all do."""
    return relational.head_cap(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), 500, 200, ["c_custkey"])


@register("migrated_settings", f"SELECT id, create_at, update_at, config FROM {OLD} o")
def _(spark, d):
    """An empty table is filled, and what comes after that is not taken."""
    name = f"lakeloom_migrated_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    spark.sql(f"CREATE TABLE {name} (id BIGINT, create_at BIGINT, update_at BIGINT, config STRING) USING parquet LOCATION '{path}'")
    for view in ("settings_old", "settings_new"):
        relational.migrate_if_empty(spark, frame(spark, d, view), name)
    kept = cut(spark.table(name), "migrated")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path)
    return kept


@register("vec_index_topk", f"SELECT vec_id, round(score, 6) AS score FROM {TOP5} t")
def _(spark, d):
    """The index is built, stored, loaded with its checks and searched."""
    path = scratch(spark, "index")
    vectors.build_index(_emb(spark, d), "vec_id", "embedding", path)
    return vectors.top_k(vectors.load_index(spark, path, "vec_id", "embedding"), "vec_id", "embedding", _query(spark, d), 5).withColumn("score", F.round("score", 6))
