"""Bank rate lookups: product-code expansion, savings rates and exchange rates."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import text as T
from lakeloom.operators.ranking import with_next
from lakeloom.operators.relational import distinct_on

PERSONAL = "CN"
ONLINE, COUNTER = "ONLINE", "COUNTER"
#: For a person's product, the channel it needs and the interest type it adds.
_PERSONAL_RULE = {"401": (ONLINE, "SA1"), "502": (COUNTER, "S"), "506": (ONLINE, None), "524": (ONLINE, "IT1"), "526": (COUNTER, "FT2"), "TDE": (COUNTER, "TDE"), "FFD": (COUNTER, None)}
#: Codes by client, by channel, and their names.
PERSONAL_CODES = ("524", "528", "506", "401", "TDE", "529", "502", "526", "FFD")
BUSINESS_CODES = ("588", "TMS", "FBM")
ONLINE_CODES = ("524", "528", "506", "401", "588")
COUNTER_CODES = ("TDE", "529", "502", "526", "FFD", "TMS", "FBM")
CLIENTS = ("cá nhân", "doanh nghiệp")
PLACES = ("trực tuyến", "tại quầy")
HOME_NAMES = {"524": "trực tuyến", "TMS": "có kỳ hạn"}
FOREIGN = "ngoại tệ"
NAMES = {"528": "iDepo", "506": "mục tiêu", "401": "tự động", "TDE": "có kỳ hạn", "529": "iDepo", "502": "gửi góp", "526": "lãi đầu kỳ", "FFD": "linh hoạt", "588": "có kỳ hạn", "FBM": "linh hoạt"}


def expand_products(products: str, channels: str = "ONLINE, COUNTER", client: str = PERSONAL) -> tuple[list[str], list[str]]:
    """(product codes, interest types) that a request asks for.

    Codes wait in a queue; one code's rule may queue another, which is then judged by its
    own rule. A business request for TMS at the counter ends the work with what waits
    taken over unjudged. No surviving code gives two lists, the first empty.
    """
    asked = {c.strip() for c in channels.split(",")}
    online, counter, personal = ONLINE in asked, COUNTER in asked, client == PERSONAL
    waiting = deque(p.strip() for p in products.split(",")) if products else deque()
    if not waiting:
        waiting.extend((["524" if personal else "588"] if online else []) + (["TDE"] if counter else []))
    kept: list[str] = []
    interest: list[str] = []
    while waiting:
        code = waiting.popleft()
        if personal and code in _PERSONAL_RULE:
            needs, adds = _PERSONAL_RULE[code]
            if needs in asked:
                kept.append(code)
                interest += [adds] if adds else []
        elif personal and code == "528":
            kept.append(code)
            interest += (["ET3"] if online else []) + (["ET2"] if counter else [])
            waiting.extend(["529"] if counter else [])
        elif personal and code == "TMS":
            kept.append("524" if online else code)
            interest += (["IT1"] if online else []) + (["TDE"] if counter else [])
            waiting.extend(["TDE"] if counter else [])
        elif not personal and code == "TDE":
            kept.append(code)
            interest += (["IT8"] if online else []) + (["TMS"] if counter else [])
            waiting.extend(["TMS"] if counter else [])
        elif not personal and code == "FFD" and counter:
            kept.append("FBM")
        elif not personal and code == "TMS" and counter:
            kept += [code, *waiting]
            interest.append("TMS")
            break
    return kept, interest


def _name(product: Column, ccy: Column) -> Column:
    out = product
    for code, name in NAMES.items():
        out = F.when(product == code, name).otherwise(out)
    for code, name in HOME_NAMES.items():
        out = F.when(product == code, F.when(ccy == "VND", name).otherwise(FOREIGN)).otherwise(out)
    return out


def savings_rates(rates: DataFrame, products: list[str] = (), interest: list[str] = (), terms: list[str] = (), currencies: list[str] = ()) -> DataFrame:
    """The savings table as answers show it. Each list filters only if it is not empty.

    Unknown currencies stay only with a positive rate; a null rate in VND goes. Rows come
    by product, term, payment of interest, balance and id, nulls last.
    """
    d = rates
    for col, wanted in (("product_type", products), ("int_type", interest), ("term", terms), ("ccy", currencies)):
        if wanted:
            d = d.where(F.col(col).isin(list(wanted)))
    d = d.where((F.col("ccy") != "VND") | (F.col("actual_rate") > 0))
    return in_answer_order(d.select("id", *savings_columns()))


def savings_columns() -> list[Column]:
    """What an answer says about a savings rate, beside its id."""
    p = F.col("product_type")
    return [
        F.when(p.isin(*PERSONAL_CODES), CLIENTS[0]).when(p.isin(*BUSINESS_CODES), CLIENTS[1]).alias("client_type"),
        F.when(p.isin(*ONLINE_CODES), PLACES[0]).when(p.isin(*COUNTER_CODES), PLACES[1]).alias("saving_type"),
        _name(p, F.col("ccy")).alias("product_name"), p, T.term_name(F.col("term")).alias("term_name"), T.term_days(F.col("term")).alias("term_day"),
        T.interest_frequency(F.col("cr_int_freq")).alias("int_freq"), F.col("cr_int_freq"), T.yearly_rate(F.col("actual_rate")).alias("full_rate"), F.col("balance"), F.col("ccy"),
    ]


#: The order of savings answers; nulls come last.
SAVINGS_ORDER = ("product_type", "term_day", "cr_int_freq", "balance", "id")


def in_answer_order(answers: DataFrame, order: tuple[str, ...] = SAVINGS_ORDER) -> DataFrame:
    return answers.orderBy(*(F.col(c).asc_nulls_last() for c in order))


def savings_tiers(answers: DataFrame) -> DataFrame:
    """answers with from_amount and to_amount: up to the next row's amount if that has the same currency.

    The next row is the next of the whole ordered answer, across products and terms.
    """
    d = with_next(answers.withColumn("from_amount", T.amount(F.col("balance"))), list(SAVINGS_ORDER), {"id": "_id", "ccy": "_ccy", "from_amount": "_amount"})
    same = F.col("_ccy").eqNullSafe(F.col("ccy")) & F.col("_id").isNotNull()
    return d.withColumn("to_amount", F.when(same, F.concat(F.lit("dưới "), F.col("_amount"))).otherwise("")).drop("_id", "_ccy", "_amount")


def exchange_rates(rates: DataFrame, currencies: list[str] | None, rate_type: str = "", until=None, branch: str = "001", ordered: bool = True) -> DataFrame:
    """ccy, rate_type, effective_date, exchange_type, buying_price, selling_price; one row per (date, ccy, type).

    ``until`` keeps every date up to it, not the latest only. Buying prices are for TRS and
    CA1, selling prices for TRS and CA3. Without ``currencies`` all are given. Rows come by currency and type, nulls last, if ``ordered``.
    """
    d = rates if currencies is None else rates.where(F.col("ccy").isin(currencies))
    d = d.where(F.col("rate_type").isin("CA1", "CA3", "TRS") & (F.col("branch") == branch) & F.col("rate_type").like(f"{rate_type}%"))
    if until is not None:
        d = d.where(F.col("effective_date") <= until)
    d = distinct_on(d, ["effective_date", "ccy", "rate_type"], ["last_change"])
    t = F.col("rate_type")
    d = d.select(
        "ccy", "rate_type", "effective_date", F.when(t == "TRS", "transfer").otherwise("cash").alias("exchange_type"),
        F.when(t.isin("TRS", "CA1"), F.concat(F.col("buy_rate").cast("string"), F.lit(" VND"))).alias("buying_price"),
        F.when(t.isin("TRS", "CA3"), F.concat(F.col("sell_rate").cast("string"), F.lit(" VND"))).alias("selling_price"),
    )
    return in_answer_order(d, ("ccy", "rate_type", "effective_date")) if ordered else d


def cross_rate(rates: DataFrame, from_ccy: str, to_ccy: str) -> DataFrame:
    """(effective_date, rate_type, cross_rate): buying rate of one currency over selling rate of the other, through VND."""
    r = distinct_on(rates.where("branch = '001'"), ["effective_date", "ccy", "rate_type"], ["last_change"])
    a = r.where(F.col("ccy") == from_ccy).select("effective_date", "rate_type", F.col("buy_rate").alias("a"))
    b = r.where(F.col("ccy") == to_ccy).select("effective_date", "rate_type", F.col("sell_rate").alias("b"))
    return a.join(b, ["effective_date", "rate_type"]).select("effective_date", "rate_type", F.try_divide("a", "b").alias("cross_rate"))


def interest_amount(amount: Column, yearly_percent: Column, months: Column) -> Column:
    return amount * yearly_percent / 100 / 12 * months
