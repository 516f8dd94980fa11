"""Benchmark decontamination by spaced-seed hashing.

A seed mask is laid on a run of words and hashes only the words under its ones, so a substitution under a zero
goes unnoticed. Hashes of all placements on the benchmark's items are joined with those on every text; around
each hit the item is aligned to the text and the longest overlap is kept in which at least ``similarity`` of the
words agree. The four masks leave no window of 15 words with up to 3 substitutions, nor one of 13 with up to 2,
without a hit (a test enumerates them). Items under 13 words are cut into one piece more than words of them may
differ, and each piece is hashed. An item of up to 13 words counts as a whole, its changed ends included.

The benchmark is a stated query set: it is taken in blocks of at most ``block_seeds`` seeds, each broadcast to
one scan of the texts, so what is broadcast is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import mix
from .workspace import column, free_names

# The seed masks.
MASKS = ("1010101011", "10110001011", "11101101", "11000100111")

#: Words from which on no window with as many substitutions as may be is left without a hit.
_MASKED = 13
_BITS = 22


@dataclass(frozen=True)
class DecontaminationParams:
    #: An overlap counts from this many words on, or from the whole item where that is shorter.
    least_words: int = 13
    similarity: float = 0.8
    #: Items of fewer words can't be told from ordinary prose and match nothing.
    least_item: int = 4
    block_seeds: int = 1_000_000


HITS = "doc_id long, item_id long, item_words int, doc_word long, item_word int, n_words int, n_equal int"

_WORD_CHAR = np.ones(256, bool)
_WORD_CHAR[:128] = [chr(c).isalnum() for c in range(128)]
_RNG = np.random.Generator(np.random.PCG64(41))
_BYTE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = 0x9E3779B97F4A7C15


def words_of(text: str) -> np.ndarray:
    """64-bit hashes of a text's words: runs of letters and digits, case folded; ASCII punctuation parts words."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    out = []
    for lo, hi in _pieces(data):
        out.append(_hash_words(data[lo:hi]))
    return np.concatenate(out)


def _pieces(data: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Cuts bytes between words into pieces of about ``most``."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + most)
        while hi < len(data) and _WORD_CHAR[data[hi]]:
            hi += 1
        yield lo, hi
        lo = hi


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _hash_words(data: np.ndarray) -> np.ndarray:
    n = len(data)
    if len(_powers[0]) < n:
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 12, 2 * len(_powers[0])), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    inside = np.concatenate(([False], _WORD_CHAR[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][:n], out=total[1:])
    return mix((total[end] - total[start]) * _powers[1][start])


def seeds_of(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each placement of a mask, by first word; none where it doesn't fit."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += words[k : k + n] * _LANE[k]
    return mix(out)


def _short_seeds(n: int, similarity: float) -> list[tuple[str, int, int]]:
    """Masks of an item of ``n`` words, and the words from and to which each is laid: one piece more than words may differ, so one is left whole."""
    pieces = min(n, int(n * (1 - similarity) + 1e-9) + 1)
    ends = [n * k // pieces for k in range(pieces + 1)]
    return [("1" * (hi - lo), lo, hi) for lo, hi in zip(ends, ends[1:], strict=False)]


class Probe:
    """Finds the items of one benchmark block in texts."""

    def __init__(self, items: list[tuple[int, np.ndarray]], params: DecontaminationParams) -> None:
        self.items, self.params = items, params
        seeds, item, at = [], [], []
        short = set()
        for k, (_, words) in enumerate(items):
            if len(words) < params.least_item:
                continue
            n = len(words)
            laid = _short_seeds(n, params.similarity) if n < max(_MASKED, params.least_words) else []
            laid += [(m, 0, n) for m in MASKS] if n >= params.least_words else []
            for mask, lo, hi in laid:
                own = seeds_of(words[lo:hi], mask)
                seeds.append(own)
                item.append(np.full(len(own), k))
                at.append(np.arange(lo, lo + len(own)))
                short |= {mask} - set(MASKS)
        self.masks = (*MASKS, *sorted(short))
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds = self.seeds[order]
        self.item = np.concatenate(item)[order] if seeds else np.zeros(0, int)
        self.at = np.concatenate(at)[order] if seeds else np.zeros(0, int)
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item_id, item_words, doc_word, item_word, n_words, n_equal) of the best overlap of each item found, by item."""
        words = words_of(text)
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple] = {}
        for mask in self.masks:
            own = seeds_of(words, mask)
            maybe = np.flatnonzero(self.filter[(own >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(self.seeds, own[maybe]), np.searchsorted(self.seeds, own[maybe], "right")
            for p, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for k, at in zip(self.item[a:b].tolist(), self.at[a:b].tolist(), strict=True):
                    if (k, p - at) not in tried:
                        tried.add((k, p - at))
                        found = self._overlap(words, k, p - at)
                        if found and (k not in best or (found[4], found[5], -found[2]) > (best[k][4], best[k][5], -best[k][2])):
                            best[k] = found
        return [best[k] for k in sorted(best)]

    def _overlap(self, words: np.ndarray, k: int, shift: int) -> tuple | None:
        """The longest window of the item, laid on the text at ``shift``, with enough equal words; its ends are equal words. Of an item no longer than ``least_words`` all words count."""
        item_id, own = self.items[k]
        lo, hi = max(0, -shift), min(len(own), len(words) - shift)
        need = min(len(own), self.params.least_words)
        if hi - lo < need:
            return None
        equal = own[lo:hi] == words[lo + shift : hi + shift]
        if need == len(own):  # the item as a whole; only its own changed ends are left out
            same = np.flatnonzero(equal)
            if len(same) < max(1, self.params.similarity * need - 1e-9):
                return None
            i, j = int(same[0]), int(same[-1]) + 1
            return item_id, len(own), i + shift, i, j - i, len(same)
        # A window (i, j] has enough equal words if this walk is no lower at its end than at its start.
        walk = np.concatenate(([0.0], np.cumsum(equal - self.params.similarity)))
        lowest = np.minimum.accumulate(walk)
        longest = (0, 0, 0)
        for j in range(need, len(walk)):
            if equal[j - 1]:
                i = int(np.searchsorted(-lowest[: j + 1], -(walk[j] + 1e-9)))
                while i < j and not equal[i]:
                    i += 1
                if j - i >= need and j - i > longest[0]:
                    longest = (j - i, i, j)
        n, i, j = longest
        return (item_id, len(own), lo + i + shift, lo + i, n, int(equal[i:j].sum())) if n else None


def _blocks(benchmark: DataFrame, item_id: str, text: str, params: DecontaminationParams) -> Iterator[list[tuple[int, np.ndarray]]]:
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    for row in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        block.append((row["item_id"], words))
        size += len(words) * len(MASKS)
        if size >= params.block_seeds:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, item_words, doc_word, item_word, n_words, n_equal.

    ``doc_word`` and ``item_word`` are the overlap's first words, from 0; ``n_words`` its length. An item found
    more than once in a text gives its longest overlap. Null texts and null items match nothing; a null doc_id is
    returned as null; repeated documents give a row each, repeated items count once (items that share an id but
    not the text give a row each). Other columns are ignored; an empty table gives an empty result.
    """
    params = params or DecontaminationParams()
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    out = None
    for block in _blocks(benchmark, item_id, item_text, params):
        part = source.mapInArrow(_finder(spark, block, params), HITS)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], HITS)


def _finder(spark, block: list[tuple[int, np.ndarray]], params: DecontaminationParams):
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(shared.value, params)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(d, *hit) for hit in probe.find(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "item_words", "doc_word", "item_word", "n_words", "n_equal"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that overlap no benchmark item. Rows without an id or text are kept; rows that share an id go together; an empty table stays empty."""
    name = free_names(docs.columns, "gone")[0]
    gone = contaminated(docs, benchmark, params, doc_id, text).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, column(doc_id).cast("long") == gone[name], "left_anti")
