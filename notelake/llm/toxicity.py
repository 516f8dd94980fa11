"""Toxicity scores from a lexicon that survives misspelling, with quotation told from abuse.

Terms come from a short general list and from labelled texts: words, and stems of longer words, found in texts
labelled toxic too often for chance, copies counted once. A term's weight is its log-odds. Each text's words run
through the lexicon's Levenshtein automata (``lexicon``); a hit counts by its term's weight, by how it was met and
by its window: inside quotation marks or beside a reporting word, with nobody addressed, it is a quotation. A
logistic model on the sums, fitted with a prior by Newton's method on a bounded sample of labelled texts, gives
the score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .lexicon import Entry, LexiconAutomaton, allowed_edits
from .workspace import column, cut, free_names, held

# General insults that need no labelled text to be known.
SEED_TERMS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "stupidity", "scum", "scumbag", "trash", "garbage", "worthless",
    "pathetic", "loser", "losers", "disgusting", "clown", "clowns", "imbecile", "dumb", "dumbass", "asshole", "bastard", "bitch", "fuck",
    "fucking", "shit", "shithead", "bullshit", "cunt", "dickhead", "jackass", "retard", "retarded", "vermin", "whore", "slut", "wanker",
)
# Words beside which a term is reported rather than used, and words that address somebody.
REPORTING = frozenset("said says saying wrote writes called calls quoted quotes quoting reported reports claimed term word slur dijo llamó escribió sagte schrieb nannte écrit appelé".split())
ADDRESSING = frozenset("you your youre you're yourself u ur du dein deine dich ihr tu te ton ta vous votre tú usted eres vosotros".split())

_QUOTES = '"“”„«»'
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_JOINED = re.compile(r"[-_/\u2010-\u2015]+")
_MARKS = re.compile(r"[\W_]*")
_FEATURES = 6
#: The prior's mean: bias, evidence of all distinct uses, that of the strongest, any quotation, evidence per hundred words, any use that is only misspelt.
_PRIOR = np.array([-2.5, 0.5, 0.5, 0.5, 0.3, -0.5])
#: Log-odds of a general term, and the most that a learned term and a whole text count for.
SEED_WEIGHT, MOST_WEIGHT, MOST_EVIDENCE = 4.0, 8.0, 15.0


@dataclass(frozen=True)
class ToxicityParams:
    #: Most labelled texts that terms and weights are learned from; those of the smallest hash are taken.
    most_labelled: int = 20_000
    #: Toxic texts that a term must be found in, and the least share of its texts that must be toxic.
    least_texts: int = 6
    purity: float = 0.4
    #: Nats by which a term's share of toxic texts must stand out: as chance has it, under one term in e^16 does. A stem needs a quarter of it beyond its longer terms.
    least_gain: float = 16.0
    #: Words and stems of toxic texts that one scan counts in the other texts; more are taken in further scans.
    most_terms: int = 50_000
    stem_lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    window: int = 6
    ridge: float = 1.0


def words_of(text: str) -> list[str]:
    return text.lower().split()


def bare(word: str) -> str:
    """A word without marks at its ends, its digits and signs read as the letters they stand for."""
    if word.isalpha():
        return word
    word = word[_MARKS.match(word).end() :]
    word = word[: len(word) - _MARKS.match(word[::-1]).end()]
    return word if word.isalpha() else "".join(c for c in word.translate(_LEET) if c.isalpha()) if any(c.isalpha() for c in word) else ""


class Scanner:
    """Finds lexicon terms in texts and sums up how they are used."""

    def __init__(self, entries: list[Entry], window: int, most: int = 400_000) -> None:
        self.automaton, self.window, self.most = LexiconAutomaton(entries), window, most
        self.memo = _Memo(self._weight)

    def _weight(self, word: str) -> float:
        """0 for no term; else the term's weight, negative if misspelt and then lessened to 0.7 and 0.4 at one and two edits."""
        found = self.automaton.match(bare(word))
        if not found and not word.isalnum():  # words joined by marks: the weightiest counts
            return max((self._weight(w) for w in _JOINED.split(word) if w and w != word), key=abs, default=0.0)
        return 0.0 if not found else found.weight * (1.0, -0.7, -0.4)[found.edits]

    def features(self, text: str) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo.clear()
        words = words_of(text)
        weights = [self.memo[w] if len(w) <= 64 else self._weight(w) for w in words]  # long ones would fill the memo
        hits = [i for i, w in enumerate(weights) if w]
        if not hits:
            return np.array([1.0, 0, 0, 0, 0, 0])
        quoted = self._quoted(words, hits)
        used = {words[i]: weights[i] for i, q in zip(hits, quoted, strict=True) if not q}
        use = sum(map(abs, used.values()))
        sure = any(w > 0 for w in used.values())
        return np.array([1.0, min(use, MOST_EVIDENCE), max(map(abs, used.values()), default=0.0), float(any(quoted)), np.log1p(100 * use / len(words)), float(use > 0 and not sure)])

    def _quoted(self, words: list[str], hits: list[int]) -> list[bool]:
        """For each hit: inside quotation marks, or with a reporting word and no addressing one in its window."""
        out, open_, at = [], False, 0
        for i in hits:
            for w in words[at:i]:
                if sum(map(w.count, _QUOTES)) % 2:
                    open_ = not open_
            at = i
            own = words[i]
            marked = open_ or own[0] in _QUOTES
            near = {w.strip(".,;:!?()" + _QUOTES) for w in words[max(0, i - self.window) : i + self.window + 1]}
            out.append(marked and not (near & ADDRESSING) or bool(near & REPORTING) and not near & ADDRESSING)
        return out


class _Memo(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self._make = make

    def __missing__(self, key: str) -> float:
        out = self[key] = self._make(key)
        return out


@dataclass(frozen=True)
class ToxicityModel:
    entries: tuple[Entry, ...]
    weights: tuple[float, ...]
    window: int

    def scanner(self) -> Scanner:
        return Scanner(list(self.entries), self.window)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(features @ np.array(self.weights), -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams, doc_id: str, text: str, label: str, label_id: str) -> DataFrame:
    """i, text, toxic of the labelled texts that learning uses, and ``alike``, which only copies share: a hash of the whole set of a text's words, null without any."""
    own = labels.select(F.col(label_id).cast("long").alias("i"), F.col(label).cast("int").alias("toxic")).where("i IS NOT NULL AND toxic IS NOT NULL")
    own = own.orderBy(F.xxhash64("i"), "i", "toxic").limit(params.most_labelled)
    found = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("text")).join(F.broadcast(own), "i").select("i", "text", "toxic").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_learnable(t) for t in batch.column(1).to_pylist()]
            alike = [_set_key(ws) if ws else None for ws in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alike, pa.binary())], names=["i", "text", "toxic", "alike"])

    return cut(found.mapInArrow(run, "i long, text string, toxic int, alike binary"), "tox-sample")


def _learnable(text: str) -> set[str]:
    return {w for w in map(bare, set(words_of(text))) if 3 <= len(w) <= 30}


def _counted(texts: DataFrame, lengths: tuple[int, ...], wanted: frozenset[tuple[str, bool]] | None = None, most: int = 200_000) -> DataFrame:
    """term, stem, n: in how many texts each word and stem occurs, or those of them that are wanted. Tasks add up before they emit."""
    schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, bool]] = Counter()

        def emit() -> pa.RecordBatch:
            rows = [{"term": t, "stem": s, "n": n} for (t, s), n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _learnable(text)
                found = {(w, False) for w in words} | {(w[:k], True) for w in words for k in lengths if len(w) > k}
                counts.update(found if wanted is None else found & wanted)
                if len(counts) > most:
                    yield emit()
        yield emit()

    return texts.mapInArrow(run, "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))


def _terms(sample: DataFrame, params: ToxicityParams) -> list[Entry]:
    """Words and stems that toxic texts hold far more often than chance has it; texts of the same words that are labelled alike count as one."""
    kept = sample.where("alike IS NOT NULL").groupBy("alike", "toxic").agg(F.min("i").alias("i"))
    texts = sample.join(F.broadcast(kept.select("i")), "i").dropDuplicates(["i"]).select("text", "toxic")
    sizes = {bool(r["toxic"]): r["count"] for r in kept.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    base = sizes.get(True, 0) / max(sum(sizes.values()), 1)
    sure: dict[tuple[str, bool], tuple[int, int]] = {}
    if 0 < base < 1:
        found = _counted(texts.where("toxic = 1").select("text"), params.stem_lengths).where(F.col("n") >= params.least_texts)
        others = texts.where("toxic <> 1").select("text")
        for rows in batched(cut(found, "tox-terms").toLocalIterator(), params.most_terms):
            bad = {(r["term"], r["stem"]): r["n"] for r in rows}
            good = {(r["term"], r["stem"]): r["n"] for r in _counted(others, params.stem_lengths, frozenset(bad)).collect()}
            for key, b in bad.items():
                n = b + good.get(key, 0)
                if b >= params.purity * n and n * _divergence(b / n, base) >= params.least_gain:
                    sure[key] = b, n
    longer: dict[str, tuple[int, int]] = {}  # by stem, the counts of the longer term with most toxic texts
    for (term, stem), counts in sure.items():
        for k in range(1, len(term) if stem else len(term) + 1):
            longer[term[:k]] = max(longer.get(term[:k], (0, 0)), counts)
    learned: list[Entry] = []
    stems: set[str] = set()
    for (term, stem), (b, n) in sorted(sure.items(), key=lambda kv: not kv[0][1]):  # stems first
        if stem:  # what it says beyond that longer term
            b, n = b - longer.get(term, (0, 0))[0], max(n - longer.get(term, (0, 0))[1], 1)
            if n * _divergence(min(b / n, 1.0), base) < params.least_gain / 4:
                continue
            stems.add(term)
        weight = min(float(np.log((b + 0.5) / (max(n - b, 0) + 0.5)) - np.log(base / (1 - base))), MOST_WEIGHT)
        related = stem or any(term[:k] in stems for k in params.stem_lengths if k < len(term))
        learned.append(Entry(term, 0 if related else allowed_edits(term), stem, weight))
    words = {e.text for e in learned if not e.stem}
    return [*learned, *(Entry(w, allowed_edits(w), weight=SEED_WEIGHT) for w in SEED_TERMS if w not in words)]


def _divergence(p: float, q: float) -> float:
    """Kullback-Leibler divergence of two coins; times the throws, the exponent of a bound on their share's chance. 0 where p is not above q."""
    return 0.0 if p <= q else p * np.log(p / q) + ((1 - p) * np.log((1 - p) / (1 - q)) if p < 1 else 0.0)


def _set_key(words: set[str]) -> bytes:
    """128 bits of the whole set of words; they hold letters only, so a line each parts them."""
    return hashlib.blake2b("\n".join(sorted(words)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", label_id: str = "doc_id") -> ToxicityModel:
    """Learns terms and weights from at most ``most_labelled`` labelled rows. Without any, the seed terms and the prior stand.

    Rows whose id, label or text is null teach nothing; texts of the same words and label count once for terms, each
    row once for weights; texts of any length are read whole; other columns are ignored.
    """
    params = params or ToxicityParams()
    sample = _sample(docs, labels, params, doc_id, text, label, label_id)
    entries = _terms(sample, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(entries, params.window)
        for batch in batches:
            rows = [scanner.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "f array<double>, toxic int").groupBy("f", "toxic").count().collect()
    x = np.array([r["f"] for r in rows]).reshape(-1, _FEATURES)
    y = np.array([r["toxic"] for r in rows], float)
    n = np.array([r["count"] for r in rows], float)
    w = _PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        return float(n @ (np.logaddexp(0, x @ w) - y * (x @ w)) + params.ridge / 2 * ((w - _PRIOR) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + params.ridge * (w - _PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + params.ridge * np.eye(_FEATURES), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-8:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(tuple(entries), tuple(w.tolist()), params.window)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "__score") -> DataFrame:
    """The columns ``keep`` of each row, whatever their names, and ``out``, the probability that its whole text is toxic.

    A null text scores as an empty one, and every empty text alike; null ids are returned as null; repeated rows score
    alike; texts of any length are read whole; an empty table gives an empty result. ``out`` must be none of ``keep``.
    """
    if out.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{out} is also a column to keep")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(column(text).cast("string").alias(free_names(keep, "text")[0]), *[column(c) for c in keep])
    schema = StructType([*source.schema.fields[1:], StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scanner = held(model, model.scanner)
        for batch in batches:
            scores = [model.score(scanner.features(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*keep, out])

    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows' labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that score under 0.5; learned from labels that are not held out.

    Rows without text or id stay, repeated rows stay or go together, an empty table stays empty; labels that are null,
    or of ids that ``docs`` lacks, teach nothing.
    """
    model = fit(docs, labels.where(~held_out()), params)
    out = free_names(docs.columns, "__score")[0]
    return score(docs, model, text, tuple(docs.columns), out).where(F.col(out) < 0.5).drop(out)
