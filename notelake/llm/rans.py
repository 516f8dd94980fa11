"""A static range asymmetric numeral system over interleaved lanes, in numpy.

Symbol ``i`` of a block belongs to lane ``i % lanes``; a step decodes one symbol in every lane at once. A lane
is a 64-bit state at or above 2**31 that reads 32-bit words, lower lanes first within a step. A checkpoint
(states and word position) stands before every ``interval``-th step, the first included, so that each
segment between two checkpoints can be decoded by itself, in parallel with the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


@dataclass(frozen=True)
class Frequencies:
    """A shared frequency table: whole numbers over every symbol, each at least 1, that sum to ``2**bits``."""

    table: np.ndarray
    bits: int

    @classmethod
    def of_counts(cls, counts: np.ndarray, bits: int = 20) -> Frequencies:
        """Scales counts to the table; symbols never counted get 1, so that any text can be encoded."""
        n, total = len(counts), 1 << bits
        if n > total // 2:
            raise ValueError(f"{n} symbols need more than {bits} bits")
        weight = counts.astype(np.float64)
        room = total - n
        exact = weight / weight.sum() * room if weight.sum() > 0 else np.full(n, room / n)
        table = np.floor(exact).astype(np.int64)
        # The largest remainders take what rounding left; ties go to the lower symbol.
        short = int(room - table.sum())
        table[np.argsort(-(exact - table), kind="stable")[:short]] += 1
        return cls((table + 1).astype(np.uint64), bits)

    @classmethod
    def from_bytes(cls, data: bytes, bits: int) -> Frequencies:
        return cls(np.frombuffer(data, "<u4").astype(np.uint64), bits)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u4").tobytes()

    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.table)[:-1])).astype(np.uint64)

    def slots(self) -> np.ndarray:
        """The symbol of each of the ``2**bits`` slots."""
        return np.repeat(np.arange(len(self.table), dtype=np.uint32), self.table.astype(np.int64))


@dataclass(frozen=True)
class Block:
    count: int
    lanes: int
    interval: int
    words: bytes
    #: One row of lane states, 64 bits each, per checkpoint.
    states: bytes
    #: The word position of each checkpoint.
    positions: list[int]


class Coder:
    def __init__(self, frequencies: Frequencies) -> None:
        self.f, self.c, self.bits = frequencies.table, frequencies.starts(), np.uint64(frequencies.bits)
        self._frequencies, self._slots = frequencies, None
        self.limit = self.f << np.uint64(63 - frequencies.bits)

    def encode(self, symbols: np.ndarray, lanes: int = 1024, segment: int = 1 << 17) -> Block:
        n = len(symbols)
        lanes = int(max(1, min(lanes, n // 256)))
        steps = -(-n // lanes)
        interval = max(1, segment // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        chunks: list[np.ndarray] = []
        marks: list[tuple[np.ndarray, int]] = []
        written = 0
        for step in range(steps - 1, -1, -1):
            s = symbols[step * lanes : (step + 1) * lanes]
            x = state[: len(s)]
            full = x >= self.limit[s]
            if full.any():
                chunks.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(chunks[-1])
                x = np.where(full, x >> _WORD, x)
            f = self.f[s]
            q = x // f
            state[: len(s)] = (q << self.bits) + (x - q * f) + self.c[s]
            if step % interval == 0:
                marks.append((state.copy(), written))
        marks.reverse()
        return Block(n, lanes, interval, b"".join(x.tobytes() for x in reversed(chunks)), b"".join(s.astype("<u8").tobytes() for s, _ in marks), [written - w for _, w in marks])

    def decode_segment(self, block: Block, k: int) -> np.ndarray:
        """The symbols from checkpoint ``k`` to the next."""
        if self._slots is None:
            self._slots = self._frequencies.slots()
        words = np.frombuffer(block.words, "<u4")
        state = np.frombuffer(block.states, "<u8").reshape(-1, block.lanes)[k].astype(np.uint64)
        at, mask = block.positions[k], np.uint64((1 << int(self.bits)) - 1)
        first = k * block.interval * block.lanes
        out = np.empty(min(block.count - first, block.interval * block.lanes), np.uint32)
        for begin in range(0, len(out), block.lanes):
            width = min(block.lanes, len(out) - begin)
            x = state[:width]
            slot = x & mask
            s = self._slots[slot]
            x = self.f[s] * (x >> self.bits) + slot - self.c[s]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << _WORD) | words[at : at + len(low)].astype(np.uint64)
                at += len(low)
            state[:width] = x
            out[begin : begin + width] = s
        return out

    def decode(self, block: Block) -> np.ndarray:
        return np.concatenate([self.decode_segment(block, k) for k in range(len(block.positions))]) if block.count else np.zeros(0, np.uint32)
