"""Text and JSON expressions; all are built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What replaces what in a term code and in a payment code, in this order.
TERM_WORDS = (("7D", "1 tuần"), ("14D", "2 tuần"), ("21D", "3 tuần"), ("D", " ngày"), ("M", " tháng"), ("Y", " năm"))
PAYMENT_WORDS = (("D", " ngày"), ("T", " tháng"))
#: Days of a term's unit, asked in this order, and of any other; the text for no payment code.
TERM_DAYS = (("D", 1), ("W", 7), ("M", 30))
OTHER_TERM_DAYS = 365
AT_THE_END = "cuối kỳ"


def _replace(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def term_name(term: Column) -> Column:
    """Vietnamese name of a term code; replacements run in order, so 17D becomes 11 weeks as in the tables served so far."""
    return _replace(term, TERM_WORDS)


def term_days(term: Column) -> Column:
    """Days of a term code: digits times 1, 7, 30 or 365."""
    unit = F.lit(OTHER_TERM_DAYS)
    for letter, days in reversed(TERM_DAYS):
        unit = F.when(F.instr(term, letter) > 0, days).otherwise(unit)
    return F.regexp_replace(term, "[^0-9]", "").cast("int") * unit


def interest_frequency(freq: Column) -> Column:
    return F.coalesce(_replace(freq, PAYMENT_WORDS), F.lit(AT_THE_END))


def plain_number(x: Column) -> Column:
    """A double's shortest digits without a trailing .0, and without an exponent from 0.0001 to 1e16."""
    size = F.abs(x)
    # the engine writes an exponent outside of 0.001 to 1e7
    long = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    digits = F.when(long, F.rtrim(x.cast("decimal(38,18)").cast("string"), F.lit("0"))).otherwise(F.regexp_replace(x.cast("string"), r"0$", ""))
    return F.when(long | x.cast("string").endswith(".0"), F.regexp_replace(digits, r"\.$", "")).otherwise(x.cast("string"))


def yearly_rate(rate: Column) -> Column:
    return F.concat(plain_number(rate), F.lit("%/năm"))


def amount(balance: Column) -> Column:
    """Thousands separated, or empty for zero and null."""
    return F.when(F.coalesce(balance, F.lit(0)) != 0, F.concat(F.format_number(balance, 0), F.lit(" VND"))).otherwise("")


def split_list(s: Column) -> Column:
    return F.transform(F.split(s, ","), lambda x: F.trim(x))


def links_to_urls(s: Column) -> Column:
    """Markdown links become their address; double line breaks become single."""
    return F.replace(F.regexp_replace(s, r"\[.*?\]\((https?://[^\s)]+)\)", "$1"), F.lit("\n\n"), F.lit("\n"))


def json_object(s: Column) -> Column:
    """From the first brace to the last; null if there is none."""
    got = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(got != "", got)


def json_label(s: Column, key: str = "response", default: str = "OTHERS") -> Column:
    return F.coalesce(F.get_json_object(json_object(s), f"$.{key}"), F.lit(default))


def strip_fences(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "```json", ""), "```", ""))


def strip_bold(s: Column) -> Column:
    return F.replace(s, F.lit("**"), F.lit(""))


def route_label(label: Column) -> Column:
    """The agent for a label text; a label may hold more than one name, and the first in this order wins."""
    return F.when(F.instr(label, "PRODUCT_INFO") > 0, "PRODUCT_INFO").when(F.instr(label, "CREDIT_CARD") > 0, "CREDIT_CARD").otherwise("OTHERS")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``${NAME}`` replaced by columns; a name without value is an error when the plan is made."""
    missing = set(re.findall(r"\$\{(.*?)\}", template)) - values.keys()
    if missing:
        raise KeyError(f"no value for {sorted(missing)}")
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("${" + k + "}"), v)
    return out


def snippet(s: Column, n: int) -> Column:
    """The first n characters, with dots where more follow."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def history_line(user: Column, ai: Column) -> Column:
    return F.concat(F.lit("H: "), F.coalesce(user, F.lit("")), F.lit("\nA: "), F.coalesce(ai, F.lit("")))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def translated(s: Column) -> Column:
    return F.concat(F.lit("Translated: "), s, F.lit(" → English"))


def words(s: Column) -> Column:
    """Word count; a stand-in where no tokenizer is at hand."""
    return F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
