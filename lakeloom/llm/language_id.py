"""Language identification by cross-parsing.

For each language a suffix automaton is built of labelled text. A text is parsed greedily
into the longest phrases that occur in a language's text; the language that needs the
fewest phrases, each weighed by the bits that point into its text, wins.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lakeloom.llm.common import fresh, map_arrow

UNKNOWN = "und"
#: Characters of texts parsed together, about; it bounds a task's memory.
PIECE = 2_000_000
#: Texts are stepped together while they are at least so many, counted per language; the longest few go on one by one.
TOGETHER = 80
#: Symbols of unseen text that calibration needs.
CALIBRATE = 500
#: Symbols: 0 for a run of non-letters, 1 for letters that no sample has, then the samples' letters.
_OTHER, _FIRST = 1, 2


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Samples:
    """Labelled text per language, bounded by ``chars_per_language``; and some more that only calibrates."""

    texts: dict[str, str]
    unseen: dict[str, str] = field(default_factory=dict)


def sample(docs: DataFrame, *, chars_per_language: int = 16_384, chars_per_document: int = 1_024, languages: int = 200, folds: int = 5) -> Samples:
    """Text to learn from, chosen by a hash of the document's id.

    The bound is documented: chars_per_language of each of the ``languages`` most frequent
    labels (ties by name), from at most chars_per_document of a document, so the model's size
    does not grow with the corpus or with labels that are dirt; an eighth as much again is
    kept aside for calibration, where there is enough. Rows without text or language
    and held-out rows are not used. Each language's rows are counted first, so that only
    about twice the rows needed ever reach the driver.
    """
    d = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(folds=folds))
    # ids that repeat share a hash; the text breaks the tie
    d = d.select(F.col("lang").cast("string").alias("lang"), (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)).alias("h"), F.col("text").cast("string").alias("text"))
    need = 4 * chars_per_language // chars_per_document
    counts = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages)
    # a language's rows are taken while their hash is below a share of its own
    share = F.broadcast(counts.select("lang", (F.lit(2.0 * need) / F.col("n")).alias("share")))
    rows = d.join(share, "lang").where(F.col("h") < F.col("share")).select("lang", "h", F.substring("text", 1, chars_per_document).alias("text")).collect()
    out: dict[str, list[str]] = {}
    aside: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.text)):
        have = out.setdefault(r.lang, [])
        if sum(map(len, have)) < chars_per_language:
            have.append(r.text)
        elif r.text not in have:  # a copy of what is learned calibrates nothing
            aside.setdefault(r.lang, []).append(r.text)
    return Samples({k: " ".join(v)[:chars_per_language] for k, v in out.items()}, {k: " ".join(v)[: chars_per_language // 8] for k, v in aside.items()})


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: each state's next states by symbol; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def overlaid(rows: list[dict[int, int]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sparse rows laid over each other: (place of each row, owners, next places).

    A row's entry for symbol c stands at its place plus c; the cell's owner is the row's
    place if the entry is its own. Places differ, so a place stands for its row. The widest
    rows are laid first. A row is tried from where the last one as wide went, some hundred
    times, and else goes past all cells in use; rows of one entry fill what is left.
    """
    free: list[int] = []  # the next free cell from each cell on

    def from_(i: int) -> int:
        while i >= len(free) - wide:
            free.extend(range(len(free), 2 * len(free) + 1024 + 2 * wide))
        while free[i] != i:
            free[i] = i = free[free[i]]
        return i

    wide = max(map(max, filter(None, rows)), default=0) + 1
    place, taken, top = [0] * len(rows), set(), 0
    tried: dict[int, int] = {}  # for rows of one entry by its symbol, for others by their width
    for r in sorted(range(len(rows)), key=lambda r: -len(rows[r])):
        symbols = sorted(rows[r])
        if not symbols:
            continue
        kind = -symbols[0] if len(symbols) == 1 else len(symbols)
        cell, tries = from_(tried.get(kind, 0) + symbols[0]), 0
        while (b := cell - symbols[0]) in taken or any(free[b + c] != b + c for c in symbols[1:]):
            tries += 1
            cell = from_(cell + 1 if tries < 100 or cell > top else top + 1)
        place[r], tried[kind] = b, b
        taken.add(b)
        for c in symbols:
            free[b + c] = b + c + 1
        top = max(top, b + symbols[-1])
    spare = max(taken, default=-1) + 1
    for r, row in enumerate(rows):  # rows without entries only need places of their own
        if not row:
            place[r], spare = spare, spare + 1
    ends = [place[r] + c for r, row in enumerate(rows) for c in row]
    owner, target = np.full(max(ends, default=-1) + 1, -1, np.int64), np.zeros(max(ends, default=-1) + 1, np.int64)
    for r, row in enumerate(rows):
        for c, t in row.items():
            owner[place[r] + c], target[place[r] + c] = place[r], place[t]
    return place, owner, target


def _sums(flags: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many flags are set in each text of the sizes given, one text after another."""
    at = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=at[1:])
    return (at[ends] - at[ends - sizes]).astype(np.int64)


class Parser:
    """The automata of all languages in one table, stepped for many texts at once."""

    def __init__(self, samples: Samples):
        self.langs = sorted(samples.texts)
        counts: dict[str, int] = {}
        for t in samples.texts.values():
            for c in t.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.width = len(letters) + _FIRST
        self.classes = self.alpha.astype(np.uint16 if self.width < 1 << 16 else np.int32) * _OTHER
        for k, c in enumerate(letters):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.classes[ord(form)] = k + _FIRST
        entries, targets, starts, self.start, self.bits, base = [], [], [], [], [], 0
        for lang in self.langs:
            symbols = self.symbols([samples.texts[lang]])[0]
            rows = automaton(symbols.tolist())
            place, owner, target = overlaid(rows)
            # a symbol may point past the last cell
            pad = max(0, max(place) + self.width - len(owner))
            # the symbol of an entry tells whose it is, as a cell is a place and a symbol; the width is no symbol
            entries.append(np.concatenate([np.where(owner >= 0, np.arange(len(owner)) - owner, self.width), np.full(pad, self.width)]))
            targets.append(np.concatenate([target + base, np.zeros(pad, np.int64)]))
            # without a next state a phrase ends, and the next one begins with this symbol
            first = np.full(self.width, place[0] + base)
            for c, t in rows[0].items():
                first[c] = place[t] + base
            starts.append(first)
            self.start.append(place[0] + base)
            self.bits.append(math.log2(max(2, len(symbols))))
            base += len(owner) + pad
        none = np.zeros(0, np.int64)
        # symbol and target in one number, so that a step reads one place of memory
        self.shift = self.width.bit_length()
        self.kind = np.int32 if base << self.shift < 1 << 31 else np.int64
        self.cells = (np.concatenate([none, *targets]) << self.shift | np.concatenate([none, *entries])).astype(self.kind)
        self.first = np.array(starts, self.kind).reshape(len(self.langs), self.width)
        self._cells, self._first = array(self.cells.dtype.char, self.cells.tobytes()), [array(self.cells.dtype.char, x.tobytes()) for x in self.first]
        # bits a symbol that each language's own unseen text takes; none known: no text is too dear
        self.usual = np.full(len(self.langs), np.inf)
        for k, lang in enumerate(self.langs):
            symbols, sizes, _ = self.symbols([samples.unseen.get(lang, "")])
            if sizes[0] >= CALIBRATE:
                self.usual[k] = self.phrases(symbols, sizes)[0, k] * self.bits[k] / sizes[0]

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the texts one after another, runs of non-letters as one; symbols and letters per text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array([len(t) for t in texts], np.int64)
        c = self.classes[points]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        ends = np.cumsum(n)
        firsts = (ends - n)[n > 0]
        keep[firsts] = True
        return c[keep], _sums(keep, ends, n), _sums(self.alpha[points], ends, n)

    def phrases(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases per text and language.

        The texts take their steps together, longest first. Few long ones are left at the
        end; each of those goes on alone from the state it has, so that no phrase is cut.
        """
        out = np.ones((len(self.langs), len(sizes)), np.int64)
        if not len(sizes) or not self.langs:
            return out.T
        order = np.argsort(-sizes, kind="stable")
        start, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        state = np.repeat(np.array(self.start, self.kind)[:, None], len(order), 1)
        count = np.ones(state.shape, np.int32)
        mask = (1 << self.shift) - 1
        few, t = -(-TOGETHER // len(self.langs)), 0
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # texts longer than t
        while t < len(active) and active[t] >= few:
            m = active[t]
            c = symbols.take(start[:m] + t)
            v = self.cells.take(state[:, :m] + c)
            ends = (v & mask) != c
            count[:, :m] += ends
            state[:, :m] = np.where(ends, self.first.take(c, 1), v >> self.shift)
            t += 1
        cells, shift = self._cells, self.shift
        for i in range(active[t] if t < len(active) else 0):
            rest = symbols[start[i] + t : start[i] + length[i]].tolist()
            for k, first in enumerate(self._first):
                s, n = int(state[k, i]), 0
                for c in rest:
                    v = cells[s + c]
                    if v & mask == c:
                        s = v >> shift
                    else:
                        n += 1
                        s = first[c]
                count[k, i] += n
        out[:, order] = count
        return out.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and how many times the usual bits a symbol the language's phrases take."""
        symbols, sizes, letters = self.symbols([t or "" for t in texts])
        known = (letters > 0) & bool(self.langs)
        lang, score, excess = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not known.any():
            return lang, score, excess
        cost = self.phrases(symbols, sizes) * np.array(self.bits)
        best = cost.argmin(1)  # ties go to the first by name
        least = cost.min(1)
        chance = 1 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(1)
        times = least / np.maximum(sizes, 1) / self.usual[best]
        for i in np.flatnonzero(known):
            lang[i], score[i], excess[i] = self.langs[best[i]], chance[i], times[i]
        return lang, score, excess


_PARSERS: dict[int, tuple[Samples, Parser]] = {}


def parser(samples: Samples) -> Parser:
    """Built once per Python worker."""
    key = hash(tuple(sorted(samples.texts.items())))
    if key not in _PARSERS or _PARSERS[key][0] != samples:
        _PARSERS.clear()
        _PARSERS[key] = samples, Parser(samples)
    return _PARSERS[key][1]


_NAMES = ("lang_pred", "score", "excess", "n_symbols")
_TYPES = (StringType(), DoubleType(), DoubleType(), LongType())


def _tag(samples: Samples, keep_text: bool, names: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what predict() says, and the number of symbols, under the names given, to batches with a text column."""
    p = parser(samples)
    for b in batches:
        texts = b["text"].to_pylist()
        langs: list[str] = []
        scores, excess, at = [np.zeros(0)], [np.zeros(0)], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < PIECE:
                chars += len(texts[end] or "")
                end += 1
            lang, score, times = p.predict(texts[at:end])
            langs += lang
            scores.append(score)
            excess.append(times)
            at = end
        kept = [c for c in b.schema.names if keep_text or c != "text"]
        size = pa.array([len(t or "") for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(excess)), size], [*kept, *names])


def identify(docs: DataFrame, samples: Samples) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, excess) of every whole text.

    score is the chance of the language if each phrase costs the bits that point into its
    text; excess is their bits a symbol over those of the language's own unseen text, about 1
    for its texts, well above for what is no language, and 0 if not known. Null texts, texts without a
    letter and any text where nothing was learned get ``und`` with score 0. Equal costs go
    to the first language by name. Only text is used. Phrases are never cut, however long
    the text. Rows that repeat are judged each, and an empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(d, partial(_tag, samples, False, _NAMES), "doc_id bigint, held_out boolean, lang_pred string, score double, excess double, n_symbols bigint").drop("n_symbols")


def in_languages(docs: DataFrame, samples: Samples, languages: Sequence[str] | None = None, *, max_excess: float = 2.4, evidence: int = 200) -> DataFrame:
    """The rows of docs, all columns as they were, whose text is in one of the languages; all learned ones if none are named.

    A text goes if it has no letter, if the language found is not wanted, or if its phrases
    take more than ``max_excess`` times the bits a symbol that the language's unseen text
    takes, so that no language explains it. The last two need ``evidence`` characters: a
    shorter text tells too little and stays, unless its language is not wanted and its
    score is 0.9 or more. Where nothing was learned only texts without a letter go.
    """
    names = [fresh(docs, c) for c in _NAMES]
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, _TYPES))])
    d = map_arrow(docs, partial(_tag, samples, True, tuple(names)), schema)
    lang, score, excess, size = map(F.col, names)
    if samples.texts:
        long = size >= evidence
        bad = (lang == UNKNOWN) | (long & (excess > max_excess))
        if languages is not None:
            bad = bad | (~lang.isin(*languages) & (long | (score >= 0.9)))
    else:
        bad = F.col("text").isNull() | ~F.col("text").rlike(r"\p{L}")
    return d.where(~bad).drop(*names)
