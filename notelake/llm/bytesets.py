"""Words and hashed word shingles of many texts at once, over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes of one slab of texts hashed together; bounds the temporary arrays, never a text.
SLAB_BYTES = 1 << 19


def _random_table(seed: int) -> np.ndarray:
    table = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table[65:91] = table[97:123]  # A-Z count as a-z
    return table


_TABLE = _random_table(20240607)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), SLAB_BYTES + 8)
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words in UTF-8 bytes; a word is a run of bytes that are no ASCII white space, A-Z folded to a-z."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(data)]))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power, out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of ``width`` words; of the whole sequence as one where it is shorter, none of no words."""
    n = len(words)
    if not n:
        return words
    take = min(width, n)
    out = words[: n - take + 1].copy()
    for k in range(1, take):
        out = mix(out * np.uint64(3) + words[k : n - take + 1 + k])
    return out if take == width else mix(out + np.uint64(take))


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def slabs(texts: Iterable[bytes | None]) -> Iterator[tuple[list[bytes | None], list[int], np.ndarray, np.ndarray]]:
    """Groups texts into slabs and yields each with its texts' byte bounds and its words' starts and hashes. A null text is empty; a white-space byte parts the texts."""
    group: list[bytes | None] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text or b"") + 1
        if held >= SLAB_BYTES:
            yield _slab(group)
            group, held = [], 0
    if group:
        yield _slab(group)


def _slab(group: list[bytes | None]) -> tuple[list[bytes | None], list[int], np.ndarray, np.ndarray]:
    bounds = [0]
    for text in group:
        bounds.append(bounds[-1] + len(text or b"") + 1)
    start, hashes = word_hashes(np.frombuffer(b"\n".join([t or b"" for t in group]) + b"\n", np.uint8))
    return group, bounds, start, hashes


def words_by_text(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order."""
    for group, bounds, start, hashes in slabs(texts):
        at = np.searchsorted(start, bounds)
        for k in range(len(group)):
            yield hashes[at[k] : at[k + 1]]
