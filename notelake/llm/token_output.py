"""Token ids in a compressed binary store: static rANS blocks under one shared frequency table.

Store layout, below one folder:

* ``blocks`` - Parquet, one row per block: ``part`` (range of ids), ``block`` (its number in the part), ``first``
  (ids in the part before it), ``doc_ids`` and ``doc_tokens`` (the documents it holds and their id counts),
  ``count``, ``lanes``, ``interval``, ``words`` (the rANS words), ``states`` and ``positions`` (checkpoints),
  ``crc32`` (of words, states and positions) and ``ids_crc32`` (of the decoded ids as little-endian uint32).
* ``table`` - Parquet, one row: the frequency table (uint32 per id) and its bits.

Parts are ranges of ascending document id; blocks are independent, end between documents, and each holds
checkpoints, so decoding parallelises over blocks and, within one, over segments. Parquet carries the bytes so
that any store Spark can write serves, and a lost task rewrites its own part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .rans import Block, Coder, Frequencies
from .workspace import cut, held, let_go

#: A word: a contraction, letters, one digit, or a run of what is neither; the tokenizer's own rule without white space. A line end parts chunks.
_WORDS = re.compile(r"\n|'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

# The splitting rule for which chunks are known to be told alike.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Chunks of these characters only have their words and cases told alike by both libraries: printable ASCII and Latin letters.
_NOT_LATIN = re.compile("[^\n\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]")


def _byte_letters() -> str:
    """The vocabulary's letter for each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


_BYTE_LETTERS = {b: c for b, c in enumerate(_byte_letters())}

TOKENS = "doc_id long, n_tokens long, ids binary"
BLOCKS = "part int, block int, first long, doc_ids array<long>, doc_tokens array<long>, count long, lanes int, interval int, words binary, states binary, positions array<long>, crc32 long, ids_crc32 long"


class ChunkEncoder:
    """Ids of whole texts, by the tokenizer, through bounded memos of chunks and words.

    Neither the normalizer nor the splitting rule of the rule known here joins anything across an ASCII blank, so
    the ids of a text are those of the chunks between blanks. Arrow splits a slab of texts and numbers its distinct
    chunks; only those that no memo holds are encoded, a chunk of Latin letters word by word by the vocabulary
    model, any other by the whole tokenizer. Under any other rule texts go to the tokenizer whole.
    """

    def __init__(self, tokenizer_json: str, most: int = 350_000) -> None:
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.width, self.model = self.dtype.itemsize, self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self._has_known_rule(json.loads(tokenizer_json))
        #: Stands for the end of a chunk among ids; no id has all its bits set.
        self.stop = b"\xff" * self.width
        self.most, self.chunks, self.words = most, {"": b""}, {"\n": self.stop}

    @staticmethod
    def _has_known_rule(rule: dict) -> bool:
        """Whether normalizer, splitting and model are those that chunks may be told by; added tokens must not reach over blanks."""
        steps = [x.get("type") for x in (rule.get("normalizer") or {}).get("normalizers", [])]
        parts = (rule.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex", "") == _RULE and parts[0].get("invert") and parts[0]["behavior"] == "Removed"
        model = rule.get("model", {})
        added = all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) for t in rule.get("added_tokens", []))
        return bool(steps == ["NFC", "Replace", "Lowercase"] and split and not parts[1].get("add_prefix_space") and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and added)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of words of Latin letters and signs into the memo. A word's tokens are let go at once, as holding those of all words costs more time than making them."""
        tokenize, ids, ends = self.model.tokenize, [], [0]
        for w in words:
            ids += [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            ends.append(len(ids) * self.width)
        packed = self._packed(ids)
        self.words.update(zip(words, map(packed.__getitem__, map(slice, ends, ends[1:])), strict=True))

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, which hold no blanks."""
        if not chunks:
            return []
        whole = "\n".join(chunks) + "\n"
        other = [m.start() for m in _NOT_LATIN.finditer(whole)]
        odd = set(np.searchsorted(np.cumsum([len(c) + 1 for c in chunks]), other, "right").tolist()) if other else set()
        if any(t in whole for t in self.added):
            odd |= {k for k, c in enumerate(chunks) if any(t in c for t in self.added)}
        if odd:
            whole = "".join([("" if k in odd else c) + "\n" for k, c in enumerate(chunks)])
        # The words of all chunks at once, a line end after each chunk.
        found = _WORDS.findall(whole.lower())
        self._learn(list(set(found).difference(self.words)))
        ids = b"".join(map(self.words.__getitem__, found))
        ends = (np.flatnonzero(np.frombuffer(ids, self.dtype) == np.frombuffer(self.stop, self.dtype)[0]) * self.width).tolist()
        out = [ids[lo:hi] for lo, hi in zip([0, *(e + self.width for e in ends)], ends, strict=False)]
        for k in odd:
            out[k] = self._packed(self.tokenizer.encode(chunks[k], add_special_tokens=False).ids)
        return out

    def encode_all(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end`` after each, and how many each text has. Null texts are empty."""
        if not self.plain:
            own = [self._packed(e.ids) + end for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.frombuffer(b"".join(own), self.dtype), np.array([len(x) // self.width for x in own], np.int64)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        numbered = lists.flatten().dictionary_encode()
        distinct = _strings(numbered.dictionary)
        if len(self.words) > self.most:
            self.words = {"\n": self.stop}
        if len(self.chunks) > self.most:
            self.chunks = {"": b""}
        # The chunks' ids in one run, the end of a document as the last of them.
        spelt = [*map(self.chunks.get, distinct), end]
        new = [k for k, x in enumerate(spelt) if x is None]
        names = [distinct[k] for k in new]
        own = self._encoded(names)
        for k, x in zip(new, own, strict=True):
            spelt[k] = x
        self.chunks.update(zip(names, own, strict=True) if max(map(len, names), default=0) <= 64 else [(c, x) for c, x in zip(names, own, strict=True) if len(c) <= 64])
        flat = np.frombuffer(b"".join(spelt), self.dtype)
        # A slab's ids are counted in 32 bits, as its bytes are in Arrow's offsets.
        sizes = np.fromiter(map(len, spelt), np.int32, len(spelt)) // self.width
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        order = np.insert(numbered.indices.to_numpy(), bounds[1:], len(distinct))
        lengths = sizes[order]
        reached = np.cumsum(lengths, dtype=np.int32)
        at = np.repeat(begins[order] - reached + lengths, lengths)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at]
        marks = np.concatenate(([0], reached))[bounds + np.arange(len(bounds))].astype(np.int64)
        return ids, np.diff(marks)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text, read on the driver; a vocabulary bounds its size."""
    return Path(path).read_text(encoding="utf-8")


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, number of ids and ids (uint16 where the vocabulary allows, else uint32), ``end_id`` appended. A null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(shared.value, lambda: ChunkEncoder(shared.value))
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            for at, size in _slabs(batch.column(1)):
                ids, counts = encoder.encode_all(batch.column(1).slice(at, size), end)
                ends = np.concatenate(([0], np.cumsum(counts) * encoder.width)).astype("<i4")
                packed = pa.BinaryArray.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), pa.array(counts, pa.int64()), packed], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, TOKENS)


def _strings(column: pa.StringArray) -> list[str]:
    """The strings of a column without nulls whose strings hold no line end."""
    if not len(column):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "\n")[0].as_py().split("\n")


def _slabs(texts: pa.StringArray, most: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """Bounds (start, number) of runs of texts that end with the text that takes them to ``most`` bytes; an index per id is held for one run at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = min(len(ends), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1)
        yield at, stop - at
        at = stop


def count_ids(tokens: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs in all documents; a row per id and task is all that moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = np.zeros(size, np.int64)
        for batch in batches:
            column = batch.column(0)
            if len(column):
                _, offsets, data = column.buffers()
                lo, hi = np.frombuffer(offsets, "<i4")[[column.offset, column.offset + len(column)]]
                counts += np.bincount(np.frombuffer(data, np.uint8)[lo:hi].view(dtype), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", bits: int = 20, lanes: int = 1024, block_tokens: int = 1 << 18, segment: int = 1 << 17) -> None:
    """Encodes every row's whole text and writes the store at ``path``, rows in ascending order of id (null ids first; equal ids in order of their bytes).

    A block closes with the document that takes it to ``block_tokens`` ids, so a longer document fills one alone.
    """
    spark = docs.sparkSession
    encoder = ChunkEncoder(read_tokenizer(tokenizer_path))
    size, dtype = encoder.size, encoder.dtype.str
    tokens = cut(tokenize(docs, tokenizer_path, end_id, doc_id, text), "tokens", "zstd")
    frequencies = Frequencies.of_counts(count_ids(tokens, size, dtype), bits)
    shared = spark.sparkContext.broadcast(frequencies.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        coder = Coder(Frequencies.from_bytes(shared.value, bits))
        part, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        waiting = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            block = coder.encode(ids, lanes, segment)
            positions = np.array(block.positions, "<i8")
            row = {
                "part": part, "block": number, "first": first, "doc_ids": [d for d, _ in held], "doc_tokens": [len(x) for _, x in held],
                "count": block.count, "lanes": block.lanes, "interval": block.interval, "words": block.words, "states": block.states, "positions": block.positions,
                "crc32": zlib.crc32(positions.tobytes(), zlib.crc32(block.states, zlib.crc32(block.words))), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((d, np.frombuffer(ids, dtype)))
                waiting += len(held[-1][1])
                if waiting >= block_tokens:
                    yield close()
                    number, first, held, waiting = number + 1, first + waiting, [], 0
        if held:
            yield close()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bits, bytearray(frequencies.to_bytes()))], "bits int, counts binary").write.parquet(f"{path}/table")


_BLOCK_SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
        ("count", pa.int64()), ("lanes", pa.int32()), ("interval", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("positions", pa.list_(pa.int64())),
        ("crc32", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, ids (little-endian uint32). A damaged block raises ValueError."""
    head = spark.read.parquet(f"{path}/table").first()
    bits, table = head["bits"], bytes(head["counts"])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("count").alias("n")).orderBy("part").collect()
    before, base = 0, {}
    for row in parts:
        base[row["part"]] = before
        before += row["n"]
    shared = spark.sparkContext.broadcast((table, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts, starts = shared.value
        coder = Coder(Frequencies.from_bytes(counts, bits))
        for batch in batches:
            for row in batch.to_pylist():
                positions = np.array(row["positions"], "<i8")
                if zlib.crc32(positions.tobytes(), zlib.crc32(row["states"], zlib.crc32(row["words"]))) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                ids = coder.decode(Block(row["count"], row["lanes"], row["interval"], row["words"], row["states"], row["positions"])).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} decodes to other ids")
                lengths = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                own = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts[row["part"]] + row["first"] + ends - lengths, pa.int64()), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(own, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
