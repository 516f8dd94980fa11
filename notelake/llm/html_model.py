"""A bidirectional LSTM in numpy that labels a page's blocks, and its training."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

from .html_blocks import Block, Element

PATH_DIM, WORD_DIM, EXTRA_DIM, HIDDEN = 256, 64, 10, 24
#: Words from which on a longer block's word counts grow no more; all of its words are counted.
SCALE_WORDS = 32
INPUT_DIM = PATH_DIM + WORD_DIM + EXTRA_DIM
WEIGHTS = Path(__file__).with_name("html_weights.npz")


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) * size >> 32


@lru_cache(50_000)
def _element_marks(names: tuple[str, ...]) -> int:
    """Buckets of an element's tag and names as the bits of a number."""
    out = 0
    for k, w in enumerate(names):
        out |= 1 << _bucket(f"{'' if k else ' '}{w}", PATH_DIM)
    return out


@lru_cache(50_000)
def _leaf_marks(names: tuple[str, ...]) -> int:
    out = 0
    for w in names:
        out |= 1 << _bucket(f"leaf {w}", PATH_DIM)
    return out


@lru_cache(50_000)
def _set_bits(marks: int) -> tuple[int, ...]:
    return tuple(k for k in range(PATH_DIM) if marks >> k & 1)


def path_buckets(path: Element | None) -> tuple[int, ...]:
    """Buckets of a tag path: every element's tag and names, and the innermost element by itself."""
    if path is None:
        return ()
    todo, e = [], path
    while e is not None and e.marks is None:
        todo.append(e)
        e = e.above
    marks = e.marks if e is not None else 0
    for e in reversed(todo):
        marks |= _element_marks(e.names)
        e.marks = marks
    return _set_bits(marks | _leaf_marks(path.names))


def features(page: list[Block]) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The dense part of each block's features (words, numbers) and the buckets of its path."""
    n = len(page)
    dense = np.zeros((n, WORD_DIM + EXTRA_DIM), np.float32)
    paths = []
    for k, b in enumerate(page):
        words = b.text.split(" ")
        counted = Counter(b.text.lower().split(" "))
        for w, times in counted.items():
            dense[k, _bucket(w, WORD_DIM)] += times
        # Shares of the words, on the scale of short blocks' counts.
        dense[k, :WORD_DIM] *= math.sqrt(min(len(words), SCALE_WORDS)) / len(words)
        size = len(b.text)
        stops = sum(map(b.text.count, ".,;?!"))
        dense[k, WORD_DIM:] = (
            math.log1p(size) / 5, math.log1p(len(words)) / 4, b.linked / max(1, size), min(1.0, 10 * stops / max(1, size)), float(b.text[-1] in ".?!:;\"”"),
            k / n, 1.0 / (1 + k), 1.0 / (n - k), min(1.0, (b.path.depth if b.path else 0) / 12), float("©" in b.text or "@" in b.text),
        )
        paths.append(path_buckets(b.path))
    return dense, paths


@dataclass
class BiLstm:
    """Weights by name: for each direction f, b: path (PATH_DIM, 4H), dense (rest, 4H), hidden (H, 4H), bias; out (2H,), out_bias."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> BiLstm:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"{d}path"] = rng.normal(0, 0.2, (PATH_DIM, 4 * HIDDEN)).astype(np.float32)
            w[f"{d}dense"] = rng.normal(0, 0.15, (WORD_DIM + EXTRA_DIM, 4 * HIDDEN)).astype(np.float32)
            w[f"{d}hidden"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"{d}bias"] = np.zeros(4 * HIDDEN, np.float32)
            w[f"{d}bias"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        w["out"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        w["out_bias"] = np.zeros(1, np.float32)
        return cls(w)

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> BiLstm:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def save(self, path: Path = WEIGHTS) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    def _inputs(self, d: str, dense: np.ndarray, paths: list[list[tuple[int, ...]]], index: dict) -> np.ndarray:
        """(pages, steps, 4H): what the gates get from the features. ``index`` numbers the distinct paths."""
        table = np.stack([self.w[f"{d}path"][list(p)].sum(0) for p in index] or [np.zeros(4 * HIDDEN, np.float32)])
        x = dense @ self.w[f"{d}dense"] + self.w[f"{d}bias"]
        for k, page in enumerate(paths):
            if page:
                x[k, : len(page)] += table[[index[p] for p in page]]
        return x

    def forward(self, dense: np.ndarray, paths: list[list[tuple[int, ...]]], keep: bool = False):
        """Logits (pages, steps); dense is padded with zeros at the end. With ``keep`` also what training needs."""
        pages, steps = dense.shape[:2]
        index = {p: k for k, p in enumerate(dict.fromkeys(p for page in paths for p in page))}
        mask = np.zeros((pages, steps, 1), np.float32)
        for k, page in enumerate(paths):
            mask[k, : len(page)] = 1
        hidden, tape = [], {}
        for d in "fb":
            x = self._inputs(d, dense, paths, index)
            h = np.zeros((pages, HIDDEN), np.float32)
            c = np.zeros((pages, HIDDEN), np.float32)
            hs = np.zeros((pages, steps, HIDDEN), np.float32)
            own = []
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                z = x[:, t] + h @ self.w[f"{d}hidden"]
                gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[:, t]
                before, h_before = c, h
                # Past a page's end the state stays empty, so the backward pass starts at its last block.
                c = (f * c + i * g) * m
                u = np.tanh(c)
                h = o * u * m
                hs[:, t] = h
                if keep:
                    own.append((t, i, f, o, g, before, h_before, u, m))
            hidden.append(hs)
            tape[d] = own
        both = np.concatenate(hidden, 2)
        logits = both @ self.w["out"] + self.w["out_bias"][0]
        return (logits, both, tape, index, mask) if keep else logits

    def gradients(self, dense: np.ndarray, paths: list[list[tuple[int, ...]]], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss over blocks and its gradients."""
        logits, both, tape, index, mask = self.forward(dense, paths, keep=True)
        m = mask[:, :, 0]
        count = m.sum()
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        loss = float((-(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9)) * m).sum() / count)
        d_logit = ((p - labels) * m / count).astype(np.float32)
        grads = {"out": (both * d_logit[:, :, None]).sum((0, 1)), "out_bias": np.array([d_logit.sum()], np.float32)}
        for side, d in enumerate("fb"):
            wh = self.w[f"{d}hidden"]
            d_out = d_logit[:, :, None] * self.w["out"][side * HIDDEN : (side + 1) * HIDDEN]
            d_h, d_c = np.zeros_like(d_out[:, 0]), np.zeros_like(d_out[:, 0])
            d_x = np.zeros((*dense.shape[:2], 4 * HIDDEN), np.float32)
            d_wh = np.zeros_like(wh)
            for t, i, f, o, g, before, h_before, u, mt in reversed(tape[d]):
                h_grad = (d_h + d_out[:, t]) * mt
                c_grad = (d_c * mt) + h_grad * o * (1 - u * u)
                c_grad = c_grad * mt
                d_z = np.concatenate([c_grad * g * i * (1 - i), c_grad * before * f * (1 - f), h_grad * u * o * (1 - o), c_grad * i * (1 - g * g)], 1)
                d_x[:, t] = d_z
                d_wh += h_before.T @ d_z
                d_h, d_c = d_z @ wh.T, c_grad * f
            grads[f"{d}hidden"] = d_wh
            grads[f"{d}bias"] = d_x.sum((0, 1))
            grads[f"{d}dense"] = np.tensordot(dense, d_x, ((0, 1), (0, 1)))
            by_path = np.zeros((len(index) or 1, 4 * HIDDEN), np.float32)
            for k, page in enumerate(paths):
                if page:
                    np.add.at(by_path, [index[q] for q in page], d_x[k, : len(page)])
            d_path = np.zeros_like(self.w[f"{d}path"])
            for q, k in index.items():
                d_path[list(q)] += by_path[k]
            grads[f"{d}path"] = d_path
        return loss, grads


def batch_of(pages: list[tuple[np.ndarray, list[tuple[int, ...]]]]) -> tuple[np.ndarray, list[list[tuple[int, ...]]]]:
    steps = max((len(p) for _, p in pages), default=0)
    dense = np.zeros((len(pages), steps, WORD_DIM + EXTRA_DIM), np.float32)
    for k, (d, _) in enumerate(pages):
        dense[k, : len(d)] = d
    return dense, [p for _, p in pages]


def train(examples: list[tuple[list[Block], list[int]]], epochs: int = 10, size: int = 48, rate: float = 0.004, seed: int = 5) -> BiLstm:
    """Fits a fresh model by Adam on pages with a 0/1 label per block."""
    model = BiLstm.fresh(seed)
    rng = np.random.default_rng(seed)
    data = sorted(((features(b), y) for b, y in examples if b), key=lambda e: len(e[1]))
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    groups = [data[k : k + size] for k in range(0, len(data), size)]
    step = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            dense, paths = batch_of([f for f, _ in groups[g]])
            labels = np.zeros(dense.shape[:2], np.float32)
            for k, (_, y) in enumerate(groups[g]):
                labels[k, : len(y)] = y
            _, grads = model.gradients(dense, paths, labels)
            step += 1
            pace = rate * (0.3 if epoch >= epochs * 0.7 else 1)
            for k, v in grads.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.w[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model
