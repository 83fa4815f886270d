"""Quality rules, line first: judge each line, remove failures, reject documents that lose too much.

Only built-in functions run here; no Python touches a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import SPACE, text_or_empty

_WORD = r"[^\x20\x09-\x0D]+"
#: Fixed phrases of page furniture, lower case, in English, German, Spanish and French, by a piece that each of them holds.
FURNITURE = {
    "cookie": (
        "accept cookies", "cookie policy", "cookies akzeptieren", "cookie-richtlinie", "aceptar cookies", "política de cookies", "accepter les cookies", "politique de cookies",
    ),
    "privac": ("privacy policy", "política de privacidad"),
    "datenschutz": ("datenschutzerklärung", "datenschutzhinweise"),
    "reserv": ("all rights reserved", "todos los derechos reservados", "reservados todos los derechos"),
    "rechte vorbehalten": ("alle rechte vorbehalten",),
    "droits r": ("tous droits réservés",),
    "javascript": ("enable javascript", "javascript is disabled", "javascript aktivieren", "activar javascript", "activer javascript"),
    "newsletter": ("subscribe to our newsletter", "newsletter abonnieren", "s'abonner à la newsletter"),
    "facebook": ("share on facebook", "auf facebook teilen", "compartir en facebook", "partager sur facebook"),
    "terms of": ("terms of service", "terms of use"),
    "nutzungsbedingungen": ("nutzungsbedingungen",),
    "condi": ("términos y condiciones", "condiciones de uso", "conditions générales", "conditions d'utilisation"),
    "conten": ("skip to content", "saltar al contenido", "ir al contenido", "aller au contenu"),
    "continue": ("sign in to continue",),
    "lorem ipsum": ("lorem ipsum",),
}
BOILERPLATE = tuple(p for phrases in FURNITURE.values() for p in phrases)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the document rule."""

    #: A line fails if at least this share of its words are bare separators.
    separator_share: float = 0.2
    #: A line fails if at least this share of its words end in a symbol or two exclamation marks.
    noisy_share: float = 0.3
    #: A line of at least this many words must hold some sentence punctuation.
    unpunctuated_words: int = 40
    #: Lines of at most this many words without a closing mark are navigation.
    short_words: int = 3
    #: A document is rejected if less than this share of its word characters stays.
    min_kept_share: float = 0.5
    #: Base rule: fewest words.
    min_words: int = 20
    #: Base rule: most repeated words, percent.
    max_repeat_percent: int = 30


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _short(words: int) -> str:
    """A pattern of lines with one to ``words`` words."""
    return rf"\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{0,{words - 1}}}[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+\z"


def _any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def _broken(text: Column, furniture: Column, r: LineRules) -> Column:
    """The rule that a line breaks, or null. What decides most lines is asked first; words and symbols are counted only where they can matter."""
    n = _count(text, _WORD)
    # classes of plain characters are the fastest to search, others are asked for one by one
    odd = text.rlike(r"[!#-&*/<>|\\-]") | _any(text, "»›•")
    ended = text.rlike(r"[.!?]") | _any(text, "…。！？")
    separators = _count(text, r"(?<![^\x20\x09-\x0D])[|»›•>/\\-]+(?![^\x20\x09-\x0D])")
    noisy = _count(text, r"(?:[#*$%&|<>]|!!)[.,;:]?(?![^\x20\x09-\x0D])")
    return (
        F.when(odd & (separators > 0) & (separators >= n * r.separator_share), "navigation")
        .when(odd & (noisy > 0) & (noisy >= n * r.noisy_share), "noise")
        .when(furniture & _any(F.lower(text), BOILERPLATE) & (n <= 40), "boilerplate")
        .when(text.rlike(_short(r.short_words)) & ~text.rlike(r"[.!?:;,…。！？\"')\]”’»][\x20\x09-\x0D]*$"), "navigation")
        .when(~ended & (n >= r.unpunctuated_words), "punctuation")
    )


def line_clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: doc_id, base statistics, verdict, cleaned text and removed lines by rule.

    Null or empty text: no words, base_failed, not kept, cleaned text empty. Repeated
    rows are judged alike, each on its own. Lines without a word are dropped from the
    cleaned text; a line equal to an earlier kept one is a repeat and is removed too.
    Columns of docs other than doc_id and text are not read, so none can clash.
    """
    r = rules
    text = F.col("text")
    d = docs.select("doc_id", text_or_empty().alias("text"))
    # words in document order; a text that starts with white space gives an empty first piece
    d = d.select("doc_id", "text", F.filter(F.split(text, SPACE), lambda w: w != "").alias("w"))
    n = F.size("w")
    # the hash of each window of eight words, from those of two and four
    word_chars = F.length(F.array_join("w", "")).cast("bigint")
    furniture = _any(F.lower(text), FURNITURE)
    d = d.select("doc_id", "text", n.alias("n_words"), word_chars.alias("word_chars"), furniture.alias("furniture"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    later = lambda k: F.zip_with("h", F.slice("h", k + 1, F.size("h")), lambda a, b: F.xxhash64(a, b))
    for k in (1, 2):
        d = d.withColumn("h", later(k))
    # the array's end stands for no run of four words; a repeated window repeats five such runs
    d = d.withColumn("h", F.slice("h", 1, F.greatest(F.col("n_words") - 3, F.lit(0))))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("h", F.when(F.size("h") - F.size(F.array_distinct("h")) >= 5, F.slice(later(4), 1, F.greatest(F.col("n_words") - 7, F.lit(0)))).otherwise(none))
    # most texts repeat no window: distinct counts say so without a sort
    d = d.select(
        "doc_id", "text", "n_words", "word_chars", "furniture",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("s"),
    )
    same = lambda x, j: (F.coalesce(F.get("s", j + 1)["h"] == x["h"], F.lit(False))) | ((j > 0) & F.coalesce(F.get("s", j - 1)["h"] == x["h"], F.lit(False)))
    d = d.select("doc_id", "text", "n_words", "word_chars", "furniture", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"])).alias("p"))
    # each repeated window covers the words up to the next one, eight at most
    covered = F.aggregate(F.transform("p", lambda x, j: F.least(F.lit(8), F.coalesce(F.get("p", j + 1) - x, F.lit(8)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    d = d.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), covered.alias("n_repeat_words"), "word_chars", "furniture",
        _count(text, r"[#*$%&|<>]").cast("bigint").alias("n_symbols"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    judged = F.transform(F.array_distinct("lines"), lambda x: F.struct(x.alias("t"), _broken(x, F.col("furniture"), r).alias("why")))
    d = d.select("doc_id", "n_words", "n_repeat_words", "word_chars", "n_symbols", F.size("lines").alias("n_lines"), judged.alias("judged"))
    d = d.withColumn("n_dup_lines", (F.col("n_lines") - F.size("judged")).cast("bigint"))
    d = d.withColumn("good", F.transform(F.filter("judged", lambda x: x["why"].isNull()), lambda x: x["t"]))
    d = d.withColumn("clean_text", F.array_join("good", "\n"))
    kept_chars = F.when(F.size("good") == F.col("n_lines"), F.col("word_chars")).otherwise(F.length(F.regexp_replace("clean_text", SPACE, "")).cast("bigint"))
    base = (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words"))
    removed = lambda rule: F.size(F.filter("judged", lambda x: x["why"] == rule)).cast("bigint").alias(f"n_{rule}")
    d = d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        kept_chars.alias("kept_chars"), *(removed(x) for x in ("navigation", "noise", "boilerplate", "punctuation")),
        "clean_text",
    )
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= r.min_kept_share * F.col("word_chars")))
    # a later filter on the verdict must not be copied down into every step above: a generator stops it
    return d.select(F.explode(F.array(F.struct(*d.columns))).alias("r")).select("r.*")
