"""URL filter by rules and by the ratio of two character language models.

Longest-match rules decide what they cover. For the rest, variable-order Markov models of
accepted and of rejected URLs, smoothed by interpolation, give a length-normalised
log-likelihood difference; its threshold is calibrated on URLs that neither model has seen.
The models are a table of exact counts that grows with the URLs; scoring joins it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, map_arrow, mix64, release, spread

#: (host, path prefix, verdict) of the rules.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Characters of context, at most.
ORDER = 5
#: How often a context must be seen for its own counts to weigh as much as the shorter one's.
DOUBT = 4.0
#: Characters in a block of URLs that are scored together.
BLOCK = 500_000
#: Ranges of the score that calibration counts.
BINS = 4001
_U = np.uint64
#: The mark of what is before a text; keys of all characters and of all texts.
_BEFORE, ALL, TEXTS = 300, _U(1), _U(2)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict: the longest rule that fits, null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    d = urls.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return d.withColumns({"rule": rule, "rule_verdict": verdict})


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of every character with the k before it, a row for each k from 0 to ORDER; the text of each; its place.

    Each text ends in a mark of its own, and a mark that never occurs stands for what is before it.
    """
    raw = [t.encode("utf-8", "surrogatepass").replace(b"\0", b" ") + b"\0" for t in texts]
    n = np.array([len(r) for r in raw], np.int64)
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    place = spread(np.zeros(len(n), np.int64), n)
    keys = np.empty((ORDER + 1, len(text)), np.uint64)
    keys[0] = mix64(text + _U(1))
    for k in range(1, ORDER + 1):
        back = np.zeros(len(text), np.uint64)
        back[k:] = text[:-k] + _U(1) if k < len(text) else 0
        keys[k] = mix64(keys[k - 1] * _U(0x9E3779B97F4A7C15) + np.where(place >= k, back, _U(_BEFORE)))
    return keys, np.repeat(np.arange(len(raw)), n), place


def _distinct(keys: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([keys.ravel(), np.array([ALL, TEXTS], np.uint64)]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each gram occurs in rejected and in accepted texts, a batch at a time."""
    for b in batches:
        texts, good = b["text"].to_pylist(), np.array(b["accepted"].to_pylist(), bool)
        if not texts:
            continue
        keys, who, _ = _grams(texts)
        every = _distinct(keys)
        out = [pa.array(every.view(np.int64))]
        for side in (False, True):
            mine = good[who] == side
            found, n = np.unique(keys[:, mine], return_counts=True)
            own = np.zeros(len(every), np.int64)
            own[np.searchsorted(every, found)] = n
            own[np.searchsorted(every, ALL)], own[np.searchsorted(every, TEXTS)] = mine.sum(), (good == side).sum()
            out.append(pa.array(own))
        yield pa.RecordBatch.from_arrays(out, ["key", "rejected", "accepted"])


def gram_counts(ruled: DataFrame) -> DataFrame:
    """(key, rejected, accepted) of every gram in the rows (text, accepted): the two models, as one table.

    Nothing is shared or dropped, so the table grows with the text. A key is 64 bits of hash.
    Counts are combined before the shuffle.
    """
    return map_arrow(ruled.select("text", "accepted"), _count, "key bigint, rejected bigint, accepted bigint").groupBy("key").agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def score(texts: list[str], key: np.ndarray, rejected: np.ndarray, accepted: np.ndarray) -> np.ndarray:
    """Mean over characters of log P(accepted) - log P(rejected), by counts of sorted keys.

    The probability of a character is that of its longest context's counts, mixed with the
    next shorter one's by how often the context was seen, down to a uniform one. A context
    was seen as often as it ended a gram one place earlier.
    """
    keys, who, place = _grams(texts)
    if not len(key):
        return np.zeros(len(texts))
    at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
    hit = key[at] == keys
    start = place == 0
    logs = []
    for counts in (rejected, accepted):
        own = np.where(hit, counts[at], 0)
        one = lambda k: counts[i] if (i := int(np.searchsorted(key, k))) < len(key) and key[i] == k else 0  # noqa: E731, B023
        p = np.full(len(who), 1 / 256)
        for k in range(ORDER + 1):
            total = np.full(len(who), one(ALL), np.int64)
            if k:
                total[1:] = own[k - 1][:-1]
                total[start] = one(TEXTS)
            weight = total / (total + DOUBT)
            p = weight * own[k] / np.maximum(total, 1) + (1 - weight) * p
        logs.append(np.log(p))
    return np.bincount(who, weights=logs[1] - logs[0], minlength=len(texts)) / np.bincount(who, minlength=len(texts))


def _into_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills the column block: a number for about BLOCK characters of a task's rows."""
    from pyspark import TaskContext

    block, held = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        out = []
        for t in b["text"].to_pylist():
            if held and held + len(t) > BLOCK:
                block, held = block + 1, 0
            out.append(block)
            held += len(t) + 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()) if c == "block" else b[c] for c in b.schema.names], b.schema.names)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each block, once per task."""
    block, held = None, []

    def ask() -> Iterator[pa.RecordBatch]:
        if held:
            k = np.unique(np.concatenate(held)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k)], ["block", "key"])
            held.clear()

    for b in batches:
        texts, blocks = b["text"].to_pylist(), b["block"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(texts)]])
        for a, z in zip(edges[:-1], edges[1:]):
            if a == z:
                continue
            if blocks[a] != block:
                yield from ask()
                block = int(blocks[a])
            held.append(_distinct(_grams(texts[a:z])[0]))
    yield from ask()


def _score_block(rows: pa.Table, answers: pa.Table) -> pa.Table:
    key = answers["key"].to_numpy().view(np.uint64)
    _, first = np.unique(key, return_index=True)
    s = score(rows["text"].to_pylist(), key[first], answers["rejected"].to_numpy()[first], answers["accepted"].to_numpy()[first])
    return rows.drop_columns(["block", "text"]).append_column("score", pa.array(s, pa.float64()))


def _threshold(scored: DataFrame) -> float:
    """The middle of the scores' range that parts best, by the mean of the classes' hit rates, the URLs kept aside; 0 with one class."""
    scale = (BINS - 1) / 8
    at = np.zeros((2, BINS))
    bin_ = F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), "score")) * scale).cast("int")
    for b, good, n in scored.where("aside").groupBy(bin_.alias("b"), (F.col("rule_verdict") == "allow").alias("good")).agg(F.count(F.lit(1)).alias("n")).collect():
        at[int(good), b + (BINS - 1) // 2] += n
    if not at.sum(1).all():
        return 0.0
    below = np.concatenate([[0], np.cumsum(at[0])]) / at[0].sum()
    above = 1 - np.concatenate([[0], np.cumsum(at[1])]) / at[1].sum()
    gain = below + above
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edge = (best[0] + best[-1]) / 2
    return float((edge - (BINS - 1) / 2 - 0.5) / scale)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score, threshold.

    verdict is the longest rule's, else ``allow`` if the score reaches the threshold and
    ``block`` if not. The score, of host and path, is given for every URL. The models count
    every URL that a rule decides but one in five by a hash of its text, which calibrate the
    threshold. URLs form blocks; a block asks the counts of its distinct grams by a join, so
    neither the models nor the URLs ever have to fit in a task or the driver.

    Null URLs and URLs without ``://`` have empty host and path and are judged by the models
    like any other. Rows that repeat count, and are judged, each. Where rules decide for one
    class only, or none, the threshold is 0; with none every score is 0 too: allow. An empty
    table gives no rows. Columns but page_id and url are not read.
    """
    d = match_rules(pages, rules).withColumn("text", F.concat("host", "path"))
    aside = F.col("rule_verdict").isNotNull() & (F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("int") % 5 == 0)
    d = d.select("page_id", "host", "path", "rule", "rule_verdict", aside.alias("aside"), "text", F.lit(0).cast("bigint").alias("block"))
    urls = cut(map_arrow(d, _into_blocks, d.schema), "urls")
    counts = gram_counts(urls.where("rule_verdict is not null and not aside").select("text", (F.col("rule_verdict") == "allow").alias("accepted")))
    # both sides are many times what the files that they are made of let Spark expect: neither may be broadcast
    answers = map_arrow(urls.select("block", "text"), _wanted, "block bigint, key bigint").join(counts.hint("merge"), "key")
    schema = "page_id bigint, host string, path string, rule string, rule_verdict string, aside boolean, score double"
    scored = cut(urls.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block, schema), "scores")
    release(urls)
    threshold = _threshold(scored)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))
