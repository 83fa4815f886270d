"""Token ids in length-delimited binary records with an offset index.

A data file is a sequence of records, each
    length of the payload (8 bytes) | masked checksum of those 8 bytes (4) | payload | masked checksum of the payload (4)
all little-endian; the first record of a file is its header. A payload is the document's
id (8 bytes), a null mark (1) and its token ids, two bytes each where the vocabulary
allows and else four. The index beside it holds the offset of every record (8 bytes
each), so readers can fetch records in any order.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import map_arrow, scratch, spread, text_or_empty
from lakeloom.sources.stores import store

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_SUM = struct.Struct("<I")
_ID = struct.Struct("<q?")


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that a checksum of data holding checksums stays sound."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + _SUM.pack(masked(n)) + payload + _SUM.pack(masked(payload))


def read_frame(f) -> bytes | None:
    """The next payload, None at the end; damaged data raise."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    n, check = _HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("damaged length")
    body = f.read(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != _SUM.unpack(body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


class WholeEncoder:
    """Encodes whole texts with a vocabulary of the tokenizers library, whatever its rules."""

    def __init__(self, lib):
        self.lib, self.wide = lib, lib.get_vocab_size() > 65_536

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.array(self.lib.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]


#: Fixed rules of the vocabulary that WordEncoder knows, as its file states them.
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def splits_at_spaces(path: str) -> bool:
    """Whether a vocabulary file has the rules that WordEncoder relies on, and no added token but marked ones."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    plain = all(t["special"] and t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in rules["added_tokens"])
    return plain and rules["model"]["type"] == "BPE" and all(rules.get(k) == v for k, v in _WORD_RULES.items())


class WordEncoder:
    """Encodes with a vocabulary that splits_at_spaces(), remembering words.

    The vocabulary drops white space and never merges across it, so a text's ids are those
    of its words in turn. Plain Latin words are split into runs as the vocabulary's own
    rule says, and the library's model encodes each distinct run once; any other word is
    given to the library whole. The memory is emptied when it holds ``room`` words.
    """

    #: Characters that no normalization changes, once lower case, and whose class is plain.
    _PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ɏ]+")
    _RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^0-9a-zÀ-ÖØ-öø-ɏ]+")

    def __init__(self, lib, room: int = 700_000):
        self.lib = lib
        self.room, self.wide = room, lib.get_vocab_size() > 65_536
        self.kind = "I" if self.wide else "H"
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in letters]
        #: bytes as the printable characters that byte-level vocabularies use
        self.shown = {b: b for b in letters} | {b: 256 + i for i, b in enumerate(rest)}
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.runs: dict[str, bytes] = {}
        #: The ids of all known words one after another, and where each word's begin.
        self.flat, self.start = array(self.kind), array("q", [0])

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        low = text.lower()
        if "<|" in text or not self._PLAIN.fullmatch(low):
            return array(self.kind, self.lib.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for run in self._RUN.findall(low):
            ids = self.runs.get(run)
            if ids is None:
                shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.shown)
                ids = self.runs[run] = array(self.kind, [t.id for t in self.lib.model.tokenize(shown)]).tobytes()
            out.append(ids)
        return b"".join(out)

    def _add(self, word: bytes) -> int:
        k = self.words[word] = len(self.start) - 1
        self.flat.frombytes(self._ids(word))
        self.start.append(len(self.flat))
        return k

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > self.room:
            self.clear()
        get, add = self.words.get, self._add
        known = [np.array([k if (k := get(w)) is not None else add(w) for w in t.encode().split()], np.int64) for t in texts]
        flat, start = np.frombuffer(self.flat, f"u{self.flat.itemsize}"), np.frombuffer(self.start, np.int64)
        return [flat[spread(s := start[k], start[k + 1] - s)] for k in known]


_OPEN: dict[str, WordEncoder | WholeEncoder] = {}


def encoder(path: str) -> WordEncoder | WholeEncoder:
    """The encoder of a vocabulary file, once per Python worker."""
    if path not in _OPEN:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        _OPEN[path] = WordEncoder(lib) if splits_at_spaces(path) else WholeEncoder(lib)
    return _OPEN[path]


def _typed(wide: bool) -> str:
    return "<u4" if wide else "<u2"


_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def _write(path: str, vocabulary: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file of a task's documents, in their order, and its index, under names of this attempt."""
    from pyspark import TaskContext

    enc, task = encoder(vocabulary), TaskContext.get()
    data = index = None
    docs_n = tokens_n = offset = 0
    name = f"{path}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
    fs, at = store(name)
    for b in batches:
        ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
        for i, x in zip(ids, enc.encode(texts)):
            if data is None:
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                data, index = fs.open_output_stream(f"{at}.records", buffer_size=1 << 20), fs.open_output_stream(f"{at}.index", buffer_size=1 << 16)
                offset = data.write(frame(json.dumps({"wide": enc.wide, "end": end_id}).encode()))
            index.write(struct.pack("<Q", offset))
            body = np.append(x, np.uint32(end_id)).astype(_typed(enc.wide)).tobytes()
            offset += data.write(frame(_ID.pack(i or 0, i is None) + body))
            docs_n, tokens_n = docs_n + 1, tokens_n + len(x) + 1
    if data is not None:
        data.close()
        index.close()
        yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "file": f"{name}.records", "n_docs": docs_n, "n_tokens": tokens_n}], _MANIFEST)


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encode every whole text and write record files in ascending doc_id order.

    Returns a manifest, one row per file in order: file, start (ids in earlier files),
    n_docs, n_tokens; it has as many rows as there are files. Each task
    writes its range of ids under a name of its own attempt, so one that runs again spoils
    nothing; the manifest names the files that are complete. ``path`` may be in any store
    that store() opens. The ids are those of the tokenizers library, whatever ``vocabulary``
    holds: words are remembered only for files whose rules are known. Null text is empty; every document ends in ``end_id``. A null doc_id comes first and
    stays null; equal doc_ids are ordered by text. An empty table writes no file.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    # texts part rows that share an id, or have none; their beginnings do, as the ranges' ends are held by the driver
    d = d.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows = sorted(map(tuple, map_arrow(d, partial(_write, path, vocabulary, end_id), "shard int, file string, n_docs bigint, n_tokens bigint").collect()))
    starts = np.cumsum([0] + [r[3] for r in rows])
    files = [(r[1], int(s), r[2], r[3]) for r, s in zip(rows, starts)]
    return docs.sparkSession.createDataFrame(files, "file string, start bigint, n_docs bigint, n_tokens bigint").repartition(max(1, len(files)))


def _read(with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    for b in batches:
        for file, start in zip(b["file"].to_pylist(), b["start"].to_pylist()):
            out, held = [[] for _ in names], 0
            fs, at = store(file)
            with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                wide = json.loads(read_frame(f))["wide"]
                while (p := read_frame(f)) is not None:
                    i, null = _ID.unpack_from(p)
                    ids = np.frombuffer(p, _typed(wide), offset=_ID.size).astype("<u4")
                    for c, v in zip(out, (None if null else i, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None)):
                        c.append(v)
                    start, held = start + len(ids), held + len(ids)
                    if held > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                        out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read files back, streaming: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    ids_crc32 is over the ids as unsigned 32-bit little-endian integers. Without
    ``with_ids`` the column ids is null.
    """

    return map_arrow(manifest.select("file", "start"), partial(_read, with_ids), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")


def read_record(file: str, index: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the file, found through the offset index."""
    fs, at = store(file)
    with fs.open_input_file(re.sub(r"\.records$", ".index", at)) as f:
        f.seek(8 * index)
        offset = struct.unpack("<Q", f.read(8))[0]
    with fs.open_input_file(at) as f:
        wide = json.loads(read_frame(f))["wide"]
        f.seek(offset)
        p = read_frame(f)
    i, null = _ID.unpack_from(p)
    return (None if null else i), np.frombuffer(p, _typed(wide), offset=_ID.size).astype(np.int64)


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def record_path(spark: SparkSession) -> str:
    return scratch(spark, "records")
