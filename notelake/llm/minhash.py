"""MinHash near-duplicates with sequential Bayesian verification.

Plan
----
1. One pass hashes every whole text into its set of distinct word shingles and keeps a sketch: set size, a
   128-bit key of the set, band hashes and 16-bit signature values.
2. Texts with equal sets collapse to one representative (the smallest id).
3. Band buckets give candidates. A small bucket gives all its pairs; a large one only pairs of each member
   with its hub (the smallest id), so rows grow with the members, not with their square.
4. Signature batches of each candidate are compared one after another. A pair is pruned as soon as the
   posterior probability that its similarity reaches the threshold falls below ``miss``.
5. Survivors are verified on the full shingle sets of the whole texts; verified links give components.
6. A large bucket whose members now lie in several components is not settled: its members outside the main
   component, the one that holds most of them, meet every member of another component in blocks. A pair goes
   through the same sequential test and the same exact check there; of each member and component the most
   similar pair comes first, and the first link between them settles the rest. A pair that shares several
   buckets is met in one. So each pair that shares a bucket ends up connected or compared; nothing is capped.

The chance that a pair at the threshold shares no band is ``(1 - t**rows)**bands``: 5e-6 for the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import mix, shingle_hashes, texts_of, words_by_text
from .components import connected_components
from .workspace import column, cut, free_names, let_go


@dataclass(frozen=True)
class MinHashParams:
    """``numerator / denominator`` is the similarity from which two sets are linked, compared in whole numbers."""

    shingle: int = 5
    numerator: int = 80
    denominator: int = 100
    bands: int = 40
    rows: int = 6
    batch: int = 48
    miss: float = 1e-7
    small_bucket: int = 16
    outlier_chunk: int = 256
    member_chunk: int = 1024
    #: Shingles that a chunk of outliers, and one of members, holds on average at most.
    chunk_shingles: int = 1_000_000
    #: Candidate ids up to this many are broadcast to pick their texts; more are joined by a shuffle.
    broadcast_ids: int = 1_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


SKETCH = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, sig binary"


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7919))
    return rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def minhash(shingles: np.ndarray, k: int) -> np.ndarray:
    """``k`` minima of 32-bit hashes of a set's shingles."""
    a, b = _permutations_cached(k)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        hashed = low[None, at : at + 1024] * a[:, None]
        hashed += b[:, None]
        hashed ^= hashed >> np.uint32(15)
        np.minimum(out, hashed.min(axis=1), out=out)
    return out


_permutations_cached = lru_cache(4)(_permutations)


def sketch(docs: DataFrame, params: MinHashParams, doc_id: str = "doc_id", text: str = "text", sets: bool = False) -> DataFrame:
    """A sketch of each row's whole text, and its sorted shingle hashes if ``sets``; null and blank texts have no set (0 shingles, null keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            ids, sizes, key_a, key_b, bands, sigs, whole = [], [], [], [], [], [], []
            for k, words in enumerate(words_by_text(texts_of(batch.column(1)))):
                ids.append(k)
                shingles = np.unique(shingle_hashes(words, params.shingle))
                sizes.append(len(shingles))
                if sets:
                    whole.append(shingles.tobytes())
                if not len(shingles):
                    for x in (key_a, key_b, bands, sigs):
                        x.append(None)
                    continue
                key_a.append(int(mix(shingles ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64).view(np.int64)))
                key_b.append(int(mix(shingles * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).view(np.int64)))
                sig = minhash(shingles, params.hashes)
                rows = sig.reshape(params.bands, params.rows).astype(np.uint64)
                hashed = np.arange(params.bands, dtype=np.uint64) + np.uint64(1)
                for c in range(params.rows):
                    hashed = mix(hashed * np.uint64(5) + rows[:, c])
                bands.append(hashed.view(np.int64))
                sigs.append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(key_a, pa.int64()), pa.array(key_b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            if sets:
                columns.append(pa.array(whole, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key_a", "key_b", "bands", "sig", "whole"][: len(columns)])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, SKETCH + ", whole binary" * sets)


@lru_cache(8)
def least_matches(params: MinHashParams) -> list[tuple[int, int]]:
    """For each batch's end ``h``: the fewest matches of ``h`` signature values at which the posterior, under a uniform prior, that the similarity reaches the threshold is at least ``miss``.

    With ``m`` matches that posterior is the chance that a binomial of ``h + 1`` trials at the threshold gives at most ``m``.
    """
    t = params.numerator / params.denominator
    out = []
    for h in sorted({*range(params.batch, params.hashes, params.batch), params.hashes}):
        total, m = 0.0, 0
        while True:
            total += comb(h + 1, m) * t**m * (1 - t) ** (h + 1 - m)
            if total >= params.miss:
                break
            m += 1
        out.append((h, m))
    return out


def prune(left: np.ndarray, right: np.ndarray, params: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the signature pairs that no batch prunes, and how many values match in each."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for h, least in least_matches(params):
        matches = matches + (left[alive, done:h] == right[alive, done:h]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], h
        if not len(alive):
            break
    return alive, matches


def _signatures(column: pa.Array, params: MinHashParams) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, params.hashes)


def _survivors(pairs: DataFrame, sigs: DataFrame, params: MinHashParams) -> DataFrame:
    """Pairs (a, b) whose signatures pass the sequential test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep, _ = prune(_signatures(batch.column(2), params), _signatures(batch.column(3), params), params)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, params: MinHashParams) -> DataFrame:
    """Of pairs (a, b): those whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            ids = batch.column(0).to_pylist()
            right = words_by_text(texts_of(batch.column(3)))
            left_texts = batch.column(2)
            for k, words in enumerate(right):
                if ids[k] != last[0]:
                    (own,) = words_by_text(texts_of(left_texts.slice(k, 1)))
                    last = (ids[k], np.unique(shingle_hashes(own, params.shingle)))
                other = np.unique(shingle_hashes(words, params.shingle))
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(params.denominator * both >= params.numerator * (len(last[1]) + len(other) - both))
            chosen = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def _verify(survivors: DataFrame, docs: DataFrame, params: MinHashParams, doc_id: str, text: str) -> DataFrame:
    wanted = cut(survivors.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "mh-wanted")
    texts = cut(_texts(wanted, docs, params, doc_id, text), "mh-texts")
    return cut(_verified(survivors, texts, params), "mh-links")


def _texts(wanted: DataFrame, docs: DataFrame, params: MinHashParams, doc_id: str, text: str) -> DataFrame:
    """doc_id and text of the rows whose ids are ``wanted``."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    few = wanted.limit(params.broadcast_ids + 1).count() <= params.broadcast_ids
    return source.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """bucket, m, main, doc_id, component of buckets whose members lie in several components; ``main`` is the one that holds most of them."""
    placed = cut(members.join(components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")), "mh-placed")
    shares = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    spread = shares.groupBy("bucket").agg(F.sum("n").alias("m"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    return cut(placed.join(cut(spread.drop("kinds"), "mh-spread"), "bucket").select("bucket", "m", "main", "doc_id", "component"), "mh-mixed")


def _unsettled(members: DataFrame, components: DataFrame, docs: DataFrame, params: MinHashParams, doc_id: str, text: str) -> DataFrame:
    """Verified links (a, b) between members of large buckets that lie in different components, one at least wherever a pair of them has one.

    ``members``: bucket, doc_id. Members outside the main component are dealt to chunks by hash; each
    chunk meets every chunk of the bucket's members in a group of its own.
    """
    mixed = _mixed(members, components)
    wanted = cut(mixed.select("doc_id").distinct(), "mh-wanted")
    full = cut(sketch(_texts(wanted, docs, params, doc_id, text), params, sets=True).where("n_shingles > 0").select("doc_id", "n_shingles", "bands", "sig", "whole"), "mh-full")
    sized = mixed.join(full.select("doc_id", "n_shingles"), "doc_id")
    out = F.col("component") != F.col("main")
    totals = sized.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("m_sum"), F.count(F.when(out, 1)).alias("u"), F.sum(F.when(out, F.col("n_shingles"))).alias("u_sum"))
    chunks, parts = (F.ceil(F.greatest(F.col(n) / most, F.col(f"{n}_sum") / params.chunk_shingles)).cast("int") for n, most in (("u", params.outlier_chunk), ("m", params.member_chunk)))
    totals = cut(totals.select("bucket", chunks.alias("chunks"), parts.alias("parts")), "mh-chunks")
    mixed = cut(mixed.join(totals, "bucket").select("bucket", "chunks", "parts", "main", "doc_id", "component"), "mh-dealt")
    left = mixed.where(out).withColumn("o", F.pmod(F.xxhash64("doc_id", F.lit(1)), "chunks").cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = mixed.withColumn("p", F.pmod(F.xxhash64("doc_id", F.lit(2)), "parts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, comp, bucket = group.column("doc_id").to_numpy(), group.column("component").to_numpy(), group.column("bucket")[0].as_py()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, params.hashes)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, params.bands)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("whole").to_pylist()]
        sizes = np.array(list(map(len, sets)))
        outlying = np.asarray(group.column("outlier").to_pylist(), bool)
        others = np.flatnonzero(~outlying)
        links: list[tuple[int, int]] = []
        for i in np.flatnonzero(outlying):
            against = others[comp[others] != comp[i]]
            fit = params.denominator * np.minimum(sizes[against], sizes[i]) >= params.numerator * np.maximum(sizes[against], sizes[i])
            against = against[fit]
            if not len(against):
                continue
            # Of the buckets that two share, the smallest is theirs.
            shared = bands[against] == bands[i]
            least = np.where(shared, bands[against], np.iinfo(np.int64).max).min(axis=1)
            against = against[least == bucket]
            hit, matches = prune(np.broadcast_to(sig[i], (len(against), params.hashes)), sig[against], params)
            joined = set()
            for j in against[hit[np.argsort(-matches, kind="stable")]]:
                if comp[j] not in joined:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if params.denominator * both >= params.numerator * (sizes[i] + sizes[j] - both):
                        joined.add(comp[j])
                        links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    columns = ("bucket", "o", "p", "doc_id", "component")
    both = left.select(*columns, F.lit(True).alias("outlier")).union(right.select(*columns, F.lit(False).alias("outlier")))
    return both.join(full.drop("n_shingles"), "doc_id").groupBy("bucket", "o", "p").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, params: MinHashParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links of similarity at or above the threshold, itself
    included; ``kept`` marks the document whose id that is. Null and blank texts have no set, link with
    nothing and are kept. Rows that share an id are one document: their texts' links are joined, and each
    row is returned with its own set size. A row whose id is null links with nothing; its component is null
    and it is kept. Other columns are ignored. An empty table gives an empty result.
    """
    params = params or MinHashParams()
    sketches = cut(sketch(docs, params, doc_id, text), "mh-sketch")
    keyed = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = cut(keyed.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "mh-groups")
    copied = groups.where("copies > 1")
    # Every row but a larger copy of a set stands for its set.
    spare = cut(keyed.select("doc_id", "key_a", "key_b", "n_shingles").join(copied, ["key_a", "key_b", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "mh-spare")
    reps = keyed.select("doc_id", "bands").join(spare.select("doc_id"), "doc_id", "left_anti")
    banded = cut(reps.select("doc_id", F.explode("bands").alias("bucket")).distinct(), "mh-banded")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.min("doc_id").alias("hub"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")).where("m > 1")
    # Buckets with the same members are one.
    buckets = cut(buckets.groupBy("hub", "m", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "hub", "m"), "mh-buckets")
    members = cut(banded.join(buckets, "bucket").select("bucket", "hub", "m", "doc_id"), "mh-members")
    small = members.where(F.col("m") <= params.small_bucket)
    other = small.select("bucket", F.col("doc_id").alias("b"))
    pairs = small.select("bucket", F.col("doc_id").alias("a")).join(other, "bucket").where("a < b").select("a", "b")
    large = members.where(F.col("m") > params.small_bucket)
    stars = large.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))
    pairs = cut(pairs.union(stars).distinct(), "mh-pairs")
    sigs = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "sig")
    survivors = cut(_survivors(pairs, sigs, params).distinct(), "mh-survivors")
    links = _verify(survivors, docs, params, doc_id, text)
    edges = links.union(spare.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    components = connected_components(edges)
    large = large.select("bucket", "doc_id")
    if not large.isEmpty():
        late = cut(_unsettled(large, components, docs, params, doc_id, text).distinct(), "mh-late")
        if not late.isEmpty():
            components = connected_components(edges.union(late))
    placed = sketches.select("doc_id", "n_shingles").join(components.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, params: MinHashParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that stay when each group of near-duplicates leaves the document of its smallest id.

    Rows without an id or without words stay. Rows that share an id are one document, of which each text stays once;
    a row without an id is a document of its own. An empty table stays empty.
    """
    own, named = column(doc_id).cast("long"), free_names(docs.columns, "gone", "repeated")
    verdicts = cut(near_duplicates(docs, params, doc_id, text).select("doc_id", "kept"), "mh-verdicts")
    gone = verdicts.where("NOT kept").select(F.col("doc_id").alias(named[0])).distinct()
    kept = docs.join(gone, own == gone[named[0]], "left_anti")
    repeated = cut(verdicts.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(named[1])), "mh-repeated")
    if repeated.isEmpty():
        return kept
    match = own == repeated[named[1]]
    return kept.join(repeated, match, "left_anti").union(kept.join(repeated, match, "left_semi").dropDuplicates([doc_id, text]))
