"""Near-duplicate documents by circulant MinHash.

Two permutations of the hash space make every coordinate of a signature: the first
scatters a document's shingles, the second, shifted circularly by one more step for each
coordinate, orders them. Signatures are banded, and what bands propose is verified by the
exact Jaccard similarity of the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import cut, map_arrow, mix64, release, spread_join, text_or_empty
from lakeloom.llm.graph import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_STEP, _PI1, _PI2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
#: What texts of one class have in common.
_SAME = ["n_shingles", "f1", "f2"]
_PLACE = np.array([0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xD3833E804F4C574B, 0xE7037ED1A0B428DB, 0xC2B2AE3D27D4EB4F], np.uint64)


@dataclass(frozen=True)
class NearRules:
    """What counts as near, and the signature's shape."""

    #: Words in a shingle.
    words: int = 5
    #: Linked if 100 * intersection >= percent * union.
    percent: int = 85
    #: Bands times rows coordinates; at the threshold a pair shares no band once in two million pairs.
    bands: int = 20
    rows: int = 4
    #: Shingles in a block of documents compared with another block.
    block: int = 400_000


class _WordHash(dict):
    """64-bit hashes of words, remembered; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASH = _WordHash()


def shingle_sets(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another; and how many each has.

    With fewer than k words the whole sequence is the one shingle; without words there is none.
    """
    get = _HASH.__getitem__
    parts = [np.fromiter(map(get, t.encode("utf-8", "surrogatepass").translate(_LOWER).split()), np.uint64) for t in texts]
    sets = []
    for w in parts:
        n = len(w)
        if n == 0:
            sets.append(w)
            continue
        m = min(n, k)
        h = np.zeros(n - m + 1, np.uint64)
        for j in range(m):
            h += mix64(w[j : n - m + 1 + j] + _PLACE[j % 5] * _U(2 * (j // 5) + 1)) * _PLACE[(j + 1) % 5]
        sets.append(np.unique(mix64(h + _U(m))))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def signatures(shingles: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """The signature of each non-empty set, a row each: coordinate k is the least of pi(sigma(x) + k * step)."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), coordinates), np.uint64)
    filled = np.flatnonzero(sizes > 0)
    if not len(filled):
        return out
    sigma = mix64(shingles ^ _U(0x5851F42D4C957F2D))
    # sets are taken in runs whose shingles stay in cache
    run = np.cumsum(sizes[filled]) // 32_768
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(filled)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = filled[a:b]
        s0, s1 = starts[part[0]], starts[part[-1]] + sizes[part[-1]]
        x, at = sigma[s0:s1].copy(), starts[part] - s0
        v, t = np.empty_like(x), np.empty_like(x)
        for k in range(coordinates):
            np.right_shift(x, _U(32), out=t)
            np.bitwise_xor(x, t, out=v)
            v *= _PI1
            np.right_shift(v, _U(29), out=t)
            v ^= t
            v *= _PI2
            out[part, k] = np.minimum.reduceat(v, at)
            x += _STEP
    return out


def _batches(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000):
    """(batch, first row, texts) in pieces of about so many characters."""
    for b in batches:
        texts, at = b["text"].to_pylist(), 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and n < chars:
                n += len(texts[end])
                end += 1
            yield b, at, texts[at:end]
            at = end


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _prints(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two fingerprints of each set, a column each; 0 for empty sets."""
    starts, full = np.cumsum(n) - n, n > 0
    prints = np.zeros((2, len(n)), np.uint64)
    if len(s):
        for i, salt in enumerate((0x2545F4914F6CDD1D, 0x632BE59BD9B4E019)):
            prints[i, full] = np.add.reduceat(mix64(s ^ _U(salt)), starts[full])
    return prints


def _sign(r: NearRules, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_shingles", "f1", "f2", *(f"k{i}" for i in range(r.bands))]
    for b, at, texts in _batches(batches):
        s, n = shingle_sets(texts, r.words)
        sig = signatures(s, n, r.bands * r.rows)
        prints, keys = _prints(s, n), []
        for i in range(r.bands):
            h = np.full(len(n), i + 1, np.uint64)
            for j in range(r.rows):
                h = mix64(h * _STEP + sig[:, i * r.rows + j])
            keys.append(_as_long(h))
        yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(n)), pa.array(n), _as_long(prints[0]), _as_long(prints[1]), *keys], names)


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) of the rows whose text is of the class that they are joined with."""
    for b, at, texts in _batches(batches):
        s, n = shingle_sets(texts, k)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        own = [b[c].slice(at, len(n)).to_numpy() for c in _SAME]
        same = (own[0] == n) & np.logical_and.reduce([x.view(np.uint64) == y for x, y in zip(own[1:], _prints(s, n))])
        out = pa.RecordBatch.from_arrays([b["node"].slice(at, len(n)), pa.ListArray.from_arrays(pa.array(offsets), _as_long(s))], ["node", "s"])
        yield out if same.all() else out.filter(pa.array(same))


def _sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, s): one row with the shingle set of each of the classes named in nodes.

    A class's text is that of its smallest doc_id. An id may have several texts, each of its
    own class, and a text several times: neither may repeat a node, as joins on it multiply.
    """
    named = classes.select("node", "doc_id", *_SAME).join(nodes, "node", "left_semi")
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).join(named, "doc_id").drop("doc_id")
    sets = cut(map_arrow(text, partial(_sets, k), "node bigint, s array<bigint>"), "sets")
    if sets.count() == nodes.count():
        return sets
    once = cut(sets.groupBy("node").agg(F.first("s").alias("s")), "sets")
    release(sets)
    return once


def _links(percent: int, table: pa.Table) -> pa.Table:
    """Links between a block's asking rows and its other rows of other labels, as pairs of labels, thinned to a forest."""
    label, asks, answers = (table[c].to_numpy() for c in ("label", "asks", "answers"))
    sets = [np.asarray(x) for x in table["s"].to_numpy()]
    all_rows, queries = np.flatnonzero(answers), np.flatnonzero(asks)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    out: list[tuple[int, int]] = []
    if len(all_rows) and len(queries):
        size = np.array([len(sets[i]) for i in all_rows])
        values, owner = np.concatenate([sets[i] for i in all_rows]), np.repeat(np.arange(len(all_rows)), size)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for q in queries:
            lo, hi = np.searchsorted(values, sets[q], "left"), np.searchsorted(values, sets[q], "right")
            hits = hi - lo
            at = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
            both = np.bincount(owner[at], minlength=len(all_rows))
            for k in np.flatnonzero(100 * both >= percent * (size + len(sets[q]) - both)):
                a, b = int(label[q]), int(label[all_rows[k]])
                if (ra := root(a)) != (rb := root(b)):
                    up[max(ra, rb)] = min(ra, rb)
                    out.append((a, b))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _sharing_rare(sets: DataFrame, percent: int) -> DataFrame:
    """(size, node, hub) of nodes that share one of their rare shingles, met at the smallest of them.

    With shingles in one order for all, two sets of the wanted similarity share one of the
    first n - ceil(n * percent / 100) + 1 of either. The order goes by how many sets have a
    shingle, so what a template brings to all of its texts comes last and parts nothing.
    """
    each = cut(sets.select("node", F.size("s").alias("n"), F.explode("s").alias("x")), "shingles")
    often = cut(each.groupBy("x").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1").withColumn("f", F.col("weight")), "often")
    shared = spread_join(each, often, ["x"], "weight", each.count())
    w = Window.partitionBy("node")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    # shingles that no other set has stand before these
    picked = cut(shared.withColumn("place", F.col("n") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("f", "x"))).where(F.col("place") <= first).select("node", "x"), "picked")
    hubs = picked.groupBy("x").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("weight")).where("weight > 1").withColumn("size", F.col("weight"))
    out = cut(spread_join(picked, hubs, ["x"], "weight", picked.count()).where("node <> hub").groupBy("node", "hub").agg(F.max("size").alias("size")), "members")
    release(each, often, picked)
    return out


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame, rules: NearRules, sets: DataFrame | None = None) -> DataFrame:
    """(node, component): who is connected by exact links among buckets' members (size, node, hub).

    Every node is first compared with its hubs, and the links found make components. A
    hub whose nodes are then all of one component, or claimed by it, is done, and so is one
    whose buckets hold it and one node. For the others similarity's complement serves: it
    is a metric, so with D the distance from the hub, two nodes can be linked only if their
    Ds differ by at most the threshold. Nodes that the hub did not claim are compared with
    its nodes in neighbouring ranges of D, block by block; the blocks are hash parts of
    bounded size, so no hub's nodes have to fit in a task.

    Texts on one template meet at one hub and are all about equally far from it, so ranges
    would not part them. Hubs of more than a block are therefore taken apart first: their
    nodes meet anew by the rare shingles that linked sets share, which loses no link. Only
    what is still in large groups then (``sets`` given) goes by ranges.
    """
    r, anew = rules, sets is None
    pairs = members.select("node", "hub")
    if sets is None:
        ends = pairs.select("node").union(pairs.select("hub")).distinct()
        sets = _sets_of(docs, classes, ends, r.words)
    # a hub of very many nodes is dealt to several tasks, and its set with it
    often = pairs.groupBy(F.col("hub").alias("node")).agg(F.count(F.lit(1)).alias("weight"))
    hubs = cut(often.join(sets.withColumnRenamed("s", "c").hint("merge"), "node").withColumnRenamed("node", "hub"), "hubs")
    met = spread_join(pairs.join(sets.hint("merge"), "node"), hubs, ["hub"], "weight", pairs.count(), large=True)
    both, n, m = F.size(F.array_intersect("s", "c")), F.size("s"), F.size("c")
    met = met.select("node", "hub", n.alias("n"), (n + m - both).alias("any"), both.alias("both"))
    star = cut(met.select("node", "hub", "n", (100 * F.col("both") >= r.percent * F.col("any")).alias("near"), (1 - F.col("both") / F.col("any")).alias("d")), "star")
    release(hubs)
    first = components(star.where("near").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    star = star.join(first, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    # nodes of buckets of three and more, the hub left out
    rest = cut(members.where("size > 2").select("node", "hub").join(star, ["node", "hub"]), "rest")
    facts = rest.groupBy("hub").agg(F.count(F.lit(1)).alias("weight"), F.count_if(~F.col("near")).alias("open"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("total"))
    open_ = cut(facts.where("open > 0 and low < high").select("hub", "weight", "total"), "open")
    if open_.isEmpty():
        release(rest, open_, *([sets] if anew else []))
        return first
    width = (100 - r.percent) / 100 + 1e-6
    far = cut(spread_join(rest, open_, ["hub"], "weight", rest.count()).withColumn("bin", F.floor(F.col("d") / width).cast("int")), "far")
    # a hub whose sets fit in a block is one; others go by ranges of D and hash parts
    whole, wide = far.where(F.col("total") <= r.block), far.where(F.col("total") > r.block)
    again = None
    if anew and not wide.isEmpty():
        closer = _sharing_rare(sets.join(wide.select("node").distinct(), "node", "left_semi"), r.percent)
        again = cut(_linked(docs, classes, closer, r, sets), "again")
        release(closer)
        wide = wide.limit(0)
    asking = wide.where("not near").select("node", "hub", "n", "label", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    size = lambda df, name: df.groupBy("hub", "bin").agg(F.ceil(F.sum("n") / r.block).cast("int").alias(name))
    grid = size(asking, "qs").join(size(wide, "ms"), ["hub", "bin"])
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = ["hub", "bin", "q", "m"]
    of = lambda df, q, m, asks, answers: df.select("node", "label", "hub", "bin", q.alias("q"), m.alias("m"), asks.alias("asks"), answers.alias("answers"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    one = of(whole.withColumn("bin", zero), zero, zero, ~F.col("near"), yes)
    q = of(asking.join(grid, ["hub", "bin"]), part("qs"), every("ms"), yes, no)
    m = of(wide.join(grid, ["hub", "bin"]), every("qs"), part("ms"), no, yes)
    rows = one.union(q).union(m).join(sets.hint("merge"), "node")

    def links_of(table: pa.Table) -> pa.Table:
        return _links(r.percent, table)

    # components of components
    links = rows.groupBy(*block).applyInArrow(links_of, "a bigint, b bigint")
    if again is not None:
        labels = first.select("node", F.col("component").alias("label"))
        ends = again.join(labels, "node", "left").join(labels.select(F.col("node").alias("component"), F.col("label").alias("other")), "component", "left")
        links = links.unionByName(ends.select(F.coalesce("label", "node").alias("a"), F.coalesce("other", "component").alias("b")).where("a <> b").distinct())
    second = components(links)
    release(rest, far, open_, *([sets] if anew else []), *([again] if again is not None else []))
    merged = second.select(F.col("node").alias("component"), F.col("component").alias("into"))
    every_node = first.unionByName(second.join(first, "node", "left_anti"))
    return every_node.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))


def _one_each_id(found: DataFrame, some: DataFrame, classes: DataFrame) -> DataFrame:
    """found, with the classes of an id that has several texts in one component."""
    several = cut(some.groupBy("doc_id").agg(F.min(F.struct(*_SAME)).alias("a"), F.max(F.struct(*_SAME)).alias("b")).where("a <> b").select("doc_id"), "several")
    if several.isEmpty():
        return found
    rows = cut(some.select("doc_id", *_SAME).join(several, "doc_id", "left_semi").distinct(), "several")
    rows = cut(spread_join(rows, classes.select("node", *_SAME, "weight"), _SAME, "weight", rows.count()).select("doc_id", "node"), "several")
    low = rows.groupBy("doc_id").agg(F.min("node").alias("low"))
    edges = rows.join(low, "doc_id").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges))


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space after A-Z is lower-cased. component_id is the
    smallest doc_id reachable by links; kept marks it. Texts without words are linked with
    nothing. Texts of equal shingle sets form a class first, by a minimum that is combined
    before the shuffle, so thousands of copies cost one row; classes alone are banded and
    verified. Candidates are never closed into groups: a class is compared with those
    that share a band with it, so texts that merely resemble each other in a chain do not
    gather. Rows that repeat a doc_id are one document: if their texts differ, it is linked with
    what any of them is near to. A null doc_id takes no part: its component_id is null and
    it is kept. Other columns of docs are not read.
    """
    r = rules
    keys = [f"k{i}" for i in range(r.bands)]
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, " + ", ".join(f"{k} bigint" for k in keys)
    sig = cut(map_arrow(d, partial(_sign, r), schema), "signatures")
    same, some = _SAME, sig.where("n_shingles > 0 and doc_id is not null")
    # an id with several texts is in several classes, so ids do not name classes
    classes = some.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("weight"), *(F.min(k).alias(k) for k in keys))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = cut(classes.select("node", F.explode(F.array(*keys)).alias("key")), "banded")
    # who shares a band meets at the smallest of them
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("weight")).where("hub < last").drop("last")
    members = cut(spread_join(banded, hubs.withColumn("size", F.col("weight")), ["key"], "weight", banded.count()).where("node <> hub").groupBy("node", "hub").agg(F.max("size").alias("size")), "members")
    release(banded)
    found = cut(_one_each_id(_linked(docs, classes, members, r), some, classes), "found")
    ids = found.join(classes.select("node", "doc_id"), "node")
    low = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("weight"))
    named = spread_join(found, low, ["component"], "weight", found.count()).select("node", "component_id")
    classes = classes.join(named, "node", "left").select(*same, F.coalesce("component_id", "doc_id").alias("component_id"), "weight")
    out = spread_join(sig.select("doc_id", *same), classes, same, "weight", sig.count(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """docs, same columns, with one document of each group of near duplicates: the smallest doc_id.

    Rows that repeat a doc_id are one document, and one row of it stays. Rows without a
    doc_id stay.
    """
    found = near_duplicates(docs, rules)
    gone = found.where("not kept").select("doc_id").distinct()
    twice = cut(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    kept = docs.join(gone, "doc_id", "left_anti")
    if twice.isEmpty():
        return kept.select(docs.columns)
    again = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))
