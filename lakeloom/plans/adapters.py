"""Views that bind the operators to the test tables, as SQL text that both engines run.

``frame`` gives a view as a DataFrame; ``sql`` gives it as a subquery for the oracle. Both
come from one text, so the oracle tests the operator and not the view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lakeloom.session import table

VIEWS = {
    # transactions with non-trivial labels; (order, line) is not unique, so rows are counted
    "tx_retail": """
        SELECT o.o_custkey AS customer_id, o.o_orderdate AS purchase_datetime, l.l_partkey AS product_id,
               l.l_quantity AS quantity, l.l_extendedprice AS amount, o.o_orderpriority AS channel,
               CASE WHEN l.l_discount > 0.05 THEN 1 ELSE 0 END AS promo_flag
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    # transactions with a time of day
    "tx_events": """
        SELECT event_id AS transaction_id, user_id AS customer_id, ts AS purchase_datetime,
               CAST(1 + event_id % 3 AS DOUBLE) AS quantity, value AS amount, event_type AS channel
        FROM {events}""",
    # what was said as transactions with a time of day: sums of whole numbers, so that the order of addition is immaterial
    "tx_talks": """
        SELECT conv_id * 1000 + turn AS transaction_id, conv_id % 5003 AS customer_id, TIMESTAMP '2024-01-01 00:00:00' + ((conv_id * 7919 + turn * 104729) % 31536000) * INTERVAL '1' SECOND AS purchase_datetime,
               CAST(length(text) AS DOUBLE) AS amount, CAST(1 + turn % 3 AS DOUBLE) AS quantity, role AS channel
        FROM {conversations}""",
    "rates_fx": """
        SELECT CASE n.n_nationkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'AUD' WHEN 3 THEN 'JPY' ELSE 'GBP' END AS ccy,
               CASE WHEN p.p_partkey % 7 = 0 THEN '002' ELSE '001' END AS branch,
               CASE p.p_partkey % 4 WHEN 0 THEN 'CA1' WHEN 1 THEN 'CA3' WHEN 2 THEN 'TRS' ELSE 'OTH' END AS rate_type,
               CASE p.p_size % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END AS effective_date,
               p.p_partkey AS last_change, 20000.0 + p.p_partkey AS buy_rate, 20500.5 + p.p_partkey AS sell_rate
        FROM {part} p JOIN {nation} n ON n.n_nationkey = p.p_partkey % 25""",
    "rates_saving": """
        SELECT p_partkey AS id,
               CASE p_partkey % 12 WHEN 0 THEN '524' WHEN 1 THEN '528' WHEN 2 THEN '506' WHEN 3 THEN '401' WHEN 4 THEN 'TDE' WHEN 5 THEN '529'
                    WHEN 6 THEN '502' WHEN 7 THEN '526' WHEN 8 THEN 'FFD' WHEN 9 THEN '588' WHEN 10 THEN 'TMS' ELSE 'FBM' END AS product_type,
               CASE p_partkey % 8 WHEN 0 THEN '7D' WHEN 1 THEN '14D' WHEN 2 THEN '21D' WHEN 3 THEN '17D' WHEN 4 THEN '6M' WHEN 5 THEN '1Y' WHEN 6 THEN '2W' ELSE '1M' END AS term,
               CASE p_partkey % 3 WHEN 0 THEN 'VND' WHEN 1 THEN 'USD' ELSE NULL END AS ccy,
               CASE p_partkey % 5 WHEN 0 THEN 'IT1' WHEN 1 THEN 'TDE' WHEN 2 THEN 'ET3' WHEN 3 THEN 'IT8' ELSE NULL END AS int_type,
               CASE p_partkey % 4 WHEN 0 THEN '30D' WHEN 1 THEN '1T' ELSE NULL END AS cr_int_freq,
               CASE WHEN p_partkey % 11 = 0 THEN 0.0 WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 10 END AS actual_rate,
               CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * 1000000 END AS balance
        FROM {part}""",
    # numeric columns with nulls, and a target
    "housing": """
        SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_retailprice END AS price,
               CAST(p_partkey % 10 AS DOUBLE) AS rooms,
               CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN -1.0 ELSE p_retailprice / 100 + p_size END AS target
        FROM {part}""",
    # a score without a model, with ties
    "scored": """
        SELECT l.doc_id, l.quality AS label, CAST((d.n_chars % 1000) AS DOUBLE) / 1000 AS score_a,
               CAST(((d.n_chars * 7 + l.quality * 300) % 1300) AS DOUBLE) / 1300 AS score_b
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "slots": """
        SELECT user_id, event_id AS seq,
               CASE WHEN event_id % 3 = 0 THEN event_type END AS muc_dich,
               CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR(20)) END AS thu_nhap,
               CASE WHEN user_id % 4 = 0 THEN NULL WHEN event_id % 7 = 0 THEN event_type END AS han_muc
        FROM {events}""",
    "usage_log": """
        SELECT user_id AS handler, event_id AS seq, CAST(event_id % 300 AS BIGINT) AS prompt_tokens, CAST(event_id % 70 AS BIGINT) AS completion_tokens
        FROM {events}""",
    "chat_pairs": """
        SELECT conv_id AS user_id, turn, text AS said, role FROM {conversations} WHERE role <> 'system'""",
    "md_text": """
        SELECT page_id, CONCAT('see [', CAST(page_id AS VARCHAR(20)), '](', url, ')', CHR(10), CHR(10), 'end') AS answer FROM {pages}""",
    "answers": """
        SELECT page_id, CASE page_id % 4
            WHEN 0 THEN CONCAT('Sure: {{"response": "PRODUCT_INFO", "n": ', CAST(page_id AS VARCHAR(20)), '}} done')
            WHEN 1 THEN '{{"response": "CREDIT_CARD"}}'
            WHEN 2 THEN CONCAT('```json', CHR(10), '{{"other": 1}}', CHR(10), '```')
            ELSE '{{"response": "x PRODUCT_INFO or CREDIT_CARD"}}' END AS raw
        FROM {pages}""",
    # requests for products: codes by the bits of a number, some twice, by channel and client
    "requests": """
        SELECT doc_id AS id,
               CONCAT_WS(', ', CASE WHEN (k & 1) <> 0 THEN '401' END, CASE WHEN (k & 2) <> 0 THEN '502' END, CASE WHEN (k & 4) <> 0 THEN '506' END, CASE WHEN (k & 8) <> 0 THEN 'TMS' END,
                         CASE WHEN (k & 16) <> 0 THEN '524' END, CASE WHEN (k & 32) <> 0 THEN '526' END, CASE WHEN (k & 64) <> 0 THEN '528' END, CASE WHEN (k & 128) <> 0 THEN 'TDE' END,
                         CASE WHEN (k & 256) <> 0 THEN 'FFD' END, CASE WHEN (k & 512) <> 0 THEN '529' END, CASE WHEN (k & 1024) <> 0 THEN 'TMS' END, CASE WHEN (k & 2048) <> 0 THEN 'XX' END) AS products,
               CASE doc_id % 5 WHEN 0 THEN 'ONLINE, COUNTER' WHEN 1 THEN 'ONLINE' WHEN 2 THEN 'COUNTER' WHEN 3 THEN 'COUNTER,ONLINE' ELSE NULL END AS channels,
               CASE WHEN doc_id % 3 = 0 THEN 'DN' ELSE 'CN' END AS client
        FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE (doc_id * 37) % 4096 END AS k FROM {documents})""",
    # arithmetic texts whose value SQL can compute, and some that are none
    "sums": """
        SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS n, CAST(doc_id % 7 AS DOUBLE) AS m, doc_id % 4 AS kind,
               CASE doc_id % 4 WHEN 0 THEN CONCAT('(', CAST(n_chars AS VARCHAR(20)), ' + 2.5) * -(', CAST(doc_id % 7 AS VARCHAR(20)), ' - 3)')
                   WHEN 1 THEN CONCAT(CAST(n_chars AS VARCHAR(20)), '/ ', CAST(doc_id % 7 AS VARCHAR(20)), '-2 / 4/ 8')
                   WHEN 2 THEN CONCAT('-', CAST(n_chars AS VARCHAR(20)), ' // 3 % (2+3)  *-1')
                   ELSE CONCAT(CAST(n_chars AS VARCHAR(20)), ' + ') END AS text
        FROM {documents}""",
    # pages entered first, and documents that come later under the same numbers
    "notes_old": "SELECT page_id AS id, CAST(1 AS BIGINT) AS create_at, CAST(1 AS BIGINT) AS update_at, url AS config FROM {pages}",
    "notes_new": "SELECT doc_id AS id, CAST(9 AS BIGINT) AS create_at, CAST(2 AS BIGINT) AS update_at, source AS config FROM {documents} WHERE lang IN ('en', 'de')",
    "settings_old": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS create_at, CAST(1 AS BIGINT) AS update_at, c_name AS config FROM {customer} WHERE c_custkey % 3 <> 0",
    "settings_new": "SELECT c_custkey AS id, CAST(9 AS BIGINT) AS create_at, CAST(2 AS BIGINT) AS update_at, c_mktsegment AS config FROM {customer} WHERE c_custkey % 2 = 0",
}


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    text = VIEWS[view]
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def sql(view: str) -> str:
    text = VIEWS[view]
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    return f"({text.format(**{n: n for n in names})})"
