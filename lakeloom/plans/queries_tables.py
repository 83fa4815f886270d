"""Queries: keyed tables and logs that are written, the registry, set-wise expansion, column arithmetic, second-order trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.functions import arithmetic
from lakeloom.functions import text as T
from lakeloom.operators import boosting, cells, expansion, registry, vectors
from lakeloom.plans import sql_functions
from lakeloom.plans.adapters import frame, sql
from lakeloom.plans.queries_bank import DISTINCT_FX, TOP5
from lakeloom.plans.queries_scorecard import features_sql, labels_sql, rounded
from lakeloom.plans.registry import register
from lakeloom.scratch import cut, drop_path, scratch
from lakeloom.session import table
from lakeloom.sources import readers, sinks
from lakeloom.sources.keyed import KeyedTable
from lakeloom.streaming import incremental


@register("table_merge", f"SELECT coalesce(o.id, n.id) AS id, coalesce(o.create_at, n.create_at) AS create_at, coalesce(n.update_at, o.update_at) AS update_at, coalesce(n.config, o.config) AS config FROM {sql('notes_old')} o FULL JOIN {sql('notes_new')} n ON o.id = n.id")
def _(spark, d):
    """An upsert as a write: a keyed table is filled, merged into and read back."""
    old = frame(spark, d, "notes_old")
    t = KeyedTable(spark, scratch(spark, "table"), ["id"], old.schema, buckets=16)
    t.append_if_empty(old)
    t.merge(frame(spark, d, "notes_new"), update=["update_at", "config"])
    return t.read()


_QUALITY = "(SELECT coalesce(d.lang, 'none') AS name, row_number() OVER (PARTITION BY coalesce(d.lang, 'none') ORDER BY d.source) AS version, round(avg(l.quality), 6) AS auc FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY coalesce(d.lang, 'none'), d.source)"


@register("registry_stages", f"""WITH p AS (SELECT *, max(auc) OVER (PARTITION BY name ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {_QUALITY} v)
    SELECT name, CAST(version AS INTEGER) AS version, auc, CASE WHEN NOT (best IS NULL OR coalesce(auc > best, FALSE)) THEN 'None'
        WHEN version = max(CASE WHEN best IS NULL OR coalesce(auc > best, FALSE) THEN version END) OVER (PARTITION BY name) THEN 'Production' ELSE 'Archived' END AS stage FROM p""")
def _(spark, d):
    """The quality of each language's sources registered as versions one after another, and the stages that follow."""
    docs, labels = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("name"), "source"), table(spark, d, "labels")
    found = docs.join(labels, "doc_id", "left").groupBy("name", "source").agg(F.round(F.avg("quality"), 6).alias("auc"))
    r = registry.ModelRegistry(spark, scratch(spark, "registry"))
    for v in found.orderBy("name", "source").collect():  # a version is an event, and they come one by one
        r.register(v.name, v.auc, run_id=v.source)
    return r.stages().select("name", "version", "auc", "stage")


def _rule_rows() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({who}, '{code}', {', '.join(map(text, r[:6]))}, {r.ends})" for (who, code), r in expansion.RULES.items())


@register("expanded_requests", f"""WITH RECURSIVE rule(personal, code, online_keep, counter_keep, always, online_adds, counter_adds, queues, ends) AS (VALUES {_rule_rows()}),
    asked AS (SELECT id, products, coalesce(client = 'CN', FALSE) AS personal, coalesce(list_contains(list_transform(str_split(channels, ','), lambda x: trim(x)), 'ONLINE'), FALSE) AS online,
        coalesce(list_contains(list_transform(str_split(channels, ','), lambda x: trim(x)), 'COUNTER'), FALSE) AS counter FROM {sql("requests")} q),
    walk AS (SELECT id, personal, online, counter, CASE WHEN coalesce(products, '') = '' THEN list_filter([CASE WHEN online AND personal THEN '524' WHEN online THEN '588' END, CASE WHEN counter THEN 'TDE' END], lambda x: x IS NOT NULL)
            ELSE list_transform(str_split(products, ','), lambda x: trim(x)) END AS waiting, 1 AS place, CAST([] AS VARCHAR[]) AS kept, CAST([] AS VARCHAR[]) AS interest, FALSE AS done FROM asked
        UNION ALL
        SELECT id, w.personal, online, counter, CASE WHEN counter AND queues IS NOT NULL THEN list_append(waiting, queues) ELSE waiting END, place + 1,
            list_concat(kept, list_filter([coalesce(CASE WHEN online THEN online_keep END, CASE WHEN counter THEN counter_keep END, always)], lambda x: x IS NOT NULL), CASE WHEN counter AND ends THEN waiting[place + 1:] ELSE [] END),
            list_concat(interest, list_filter([CASE WHEN online THEN online_adds END, CASE WHEN counter THEN counter_adds END], lambda x: x IS NOT NULL)), coalesce(counter AND ends, FALSE)
        FROM walk w LEFT JOIN rule r ON r.personal = w.personal AND r.code = w.waiting[w.place] WHERE NOT done AND place <= len(waiting))
    SELECT id, array_to_string(kept, ',') AS products, array_to_string(interest, ',') AS interest FROM walk WHERE done OR place > len(waiting)""")
def _(spark, d):
    e = expansion.expand_requests(frame(spark, d, "requests"))
    return e.select("id", F.array_join("product_codes", ",").alias("products"), F.array_join("interest_types", ",").alias("interest"))


@register("arithmetic_column", f"""SELECT id, round(CASE kind WHEN 0 THEN (n + 2.5) * -(m - 3) WHEN 1 THEN CASE WHEN m <> 0 THEN n / m - 2.0 / 4 / 8 END
    WHEN 2 THEN -(floor(-n / 3) - 5 * floor(floor(-n / 3) / 5)) END, 6) AS value FROM {sql("sums")} s""")
def _(spark, d):
    return frame(spark, d, "sums").select("id", F.round(arithmetic.evaluated(F.col("text")), 6).alias("value"))


#: Trees of the two queries below; every level of a tree is a job of its own.
_TREES = 20
_SHAPES = ("n_chars", "n_words", "n_lines", "n_digits", "n_capitals", "n_marks")


def _shapes(spark, d):
    """Numbers that describe each document's text."""
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("double")
    x = table(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"), count("\n").alias("n_lines"), count("[0-9]").alias("n_digits"), count("[A-Z]").alias("n_capitals"), count("[#*$%&|<>]").alias("n_marks"))
    return x.withColumns({c: F.try_divide(F.col(c), F.col("n_chars")) for c in _SHAPES[1:]})


@register("second_order_scores")
def _(spark, d):
    """Trees by gradients and hessians over the labelled documents; an expression scores all documents."""
    shapes = cut(_shapes(spark, d), "shapes")
    labelled = shapes.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    m = boosting.fit_trees(labelled, list(_SHAPES), "quality", params=boosting.Params(rounds=_TREES))
    return registry.scored(shapes, m).select("doc_id", F.round("probability", 6).alias("probability"), "prediction")


@register("second_order_regression")
def _(spark, d):
    """The number of words from a text's other shapes, at a regression's depth; the model is saved and loaded before it scores."""
    shapes = cut(_shapes(spark, d), "shapes")
    others = [c for c in _SHAPES if c != "n_words"]
    m = boosting.fit_trees(shapes, others, "n_words", "squared", boosting.Params(rounds=_TREES, depth=6, rows=1.0, columns=1.0))
    path = scratch(spark, "model")
    m.save(spark, path)
    return shapes.select("doc_id", F.round("n_words", 6).alias("n_words"), F.round(boosting.TreeModel.load(spark, path).prediction(), 6).alias("prediction"))


@register("text_forms", r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda w: w <> '')) AS n_words, array_to_string(list_transform(str_split(concat(coalesce(lang, ''), ' , ', source), ','), lambda x: trim(x)), '|') AS parts,
    replace(concat('**', source, '** of ', coalesce(lang, '')), '**', '') AS plain, 'Translated: ' || lang || ' → English' AS english FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents")
    lang = F.coalesce("lang", F.lit(""))
    parts = F.array_join(T.split_list(F.concat(lang, F.lit(" , "), "source")), "|")
    plain = T.strip_bold(F.concat(F.lit("**"), "source", F.lit("** of "), lang))
    return docs.select("doc_id", T.words(F.col("text")).cast("bigint").alias("n_words"), parts.alias("parts"), plain.alias("plain"), T.translated(F.col("lang")).alias("english"))


@register("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.iso_timestamp(F.col("ts")).alias("iso"))


@register("history_log", "SELECT conv_id, turn, role, md5(coalesce(text, '')) AS said FROM conversations")
def _(spark, d):
    """Turns are appended to a log of JSON lines by those who said them, and read back."""
    talks, path = table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), scratch(spark, "history")
    sinks.json_lines(talks.where("role = 'user'"), path)
    sinks.append_json(talks.where("role <> 'user'"), path)
    sinks.append_json(talks.where("role IS NULL"), path)
    return spark.read.schema(talks.schema).json(path).select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("said"))


@register("inserted_rows", "SELECT page_id, url FROM pages UNION ALL SELECT doc_id AS page_id, source AS url FROM documents")
def _(spark, d):
    """Rows inserted into a table in two writes, columns in any order, and the whole table read."""
    name = f"lakeloom_inserted_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    spark.sql(f"CREATE TABLE {name} (page_id BIGINT, url STRING) USING parquet LOCATION '{path}'")
    sinks.append_rows(table(spark, d, "pages").select("url", "page_id"), name)
    sinks.append_rows(table(spark, d, "documents").select(F.col("source").alias("url"), F.col("doc_id").alias("page_id")), name)
    kept = cut(readers.whole_table(spark, name), "inserted")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path)
    return kept


TALKS = sql("tx_talks")


@register("incremental_features", f"SELECT f.*, coalesce(l.label, 0) AS label FROM ({features_sql(TALKS)}) f LEFT JOIN (SELECT customer_id, label FROM ({labels_sql(TALKS, 60)})) l ON l.customer_id = f.customer_id")
def _(spark, d):
    """Features of all transactions, merged in four batches of which one comes twice."""
    tx = frame(spark, d, "tx_talks")
    t = incremental.feature_table(spark, scratch(spark, "features"), tx.schema, buckets=16)
    for batch in (0, 1, 1, 2, 3):
        incremental.add_batch(t, tx.where(F.pmod(F.xxhash64("transaction_id"), F.lit(4)) == batch), "talks", batch)
    return rounded(incremental.current_features(t))


@register("vec_pruned_topk", f"SELECT vec_id, round(score, 6) AS score FROM {TOP5} t")
def _(spark, d):
    """The nearest vectors by the index in cells."""
    e = table(spark, d, "embeddings")
    path = scratch(spark, "cells")
    cells.build_cells(e.select("vec_id", "embedding"), "vec_id", "embedding", path, cells=64)
    query = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return cells.load_cells(spark, path).top_k(query, 5)[0].withColumn("score", F.round("score", 6))


@register("sql_nearest", f"SELECT vec_id, round(score, 6) AS score FROM {TOP5} t")
def _(spark, d):
    """The same by an SQL text that calls a table function."""
    e = table(spark, d, "embeddings")
    sql_functions.register_functions(spark, vectors=e.select(F.col("vec_id").alias("key"), "embedding"))
    query = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return spark.sql("SELECT key AS vec_id, round(score, 6) AS score FROM nearest(:query, 5)", {"query": F.array(*map(F.lit, query))})


@register("sql_exchange_rate", f"""SELECT ccy, rate_type, effective_date, CASE WHEN rate_type IN ('TRS', 'CA1') THEN CAST(CAST(buy_rate AS DOUBLE) AS VARCHAR) || ' VND' END AS buying_price
    FROM {DISTINCT_FX} r WHERE rate_type LIKE 'CA%' AND rate_type IN ('CA1', 'CA3') AND ccy IN ('USD', 'EUR') AND effective_date <= TIMESTAMP '2024-02-01 00:00:00'""")
def _(spark, d):
    sql_functions.register_functions(spark, fx=frame(spark, d, "rates_fx").withColumns({c: F.col(c).cast("double") for c in ("buy_rate", "sell_rate")}))
    return spark.sql("SELECT ccy, rate_type, effective_date, buying_price FROM exchange_rate('USD', 'EUR', 'CA', TIMESTAMP '2024-02-01 00:00:00')")


@register("json_rows", "SELECT doc_id, CAST(json_object('id', doc_id, 'lang', coalesce(lang, ''), 'source', source, 'words', json_array(lang || '-ü', 'x \"y\"')) AS VARCHAR) AS body FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    """Rows as JSON texts, letters outside ASCII kept."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL")
    body = F.struct(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("lang"), "source", F.array(F.concat("lang", F.lit("-ü")), F.lit('x "y"')).alias("words"))
    return docs.select("doc_id", F.to_json(body).alias("body"))


@register("embedding_texts", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, len(embedding) AS n FROM embeddings")
def _(spark, d):
    """Vectors stored as text and parsed, never evaluated."""
    e = table(spark, d, "embeddings").select("vec_id", vectors.parse_embedding(F.to_json("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), F.size("v").cast("bigint").alias("n"))
