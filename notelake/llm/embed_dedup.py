"""Near-duplicate vectors through an inverted multi-index.

Vectors are normalised in double precision and cut in halves; a codebook for each half, fitted by k-means on a
bounded sample, makes a grid of cells. Every vector lives in the cell of its nearest centroids. The
multi-sequence traversal walks a vector's cells in order of the sum of both halves' squared distances; a vector
visits as many as reach the target recall, measured on sampled vectors with partners set at exactly the
threshold's angle. Cells (times label) are dealt in blocks, every visit is verified by its cosine in double
precision, and a pair is counted once whichever end visits the other.

The grid grows with the number of vectors so that cells stay small; a hot cell is dealt in blocks of bounded size,
and each pair of blocks is one group. No pair is ever emitted: a group returns per-vector counts and a forest of
links, at most one row a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import cut


@dataclass(frozen=True)
class MultiIndexParams:
    threshold: float = 0.98
    #: Share of threshold pairs that the visited cells must hold.
    recall: float = 0.9999
    #: Vectors the codebooks are fitted on and the visits are calibrated on, those of the smallest hash; more where the
    #: grid needs more, up to the most.
    sample: int = 8192
    most_sample: int = 262_144
    rows_per_cell: int = 400
    block: int = 1024

    def centroids(self, rows: int) -> int:
        """Centroids of a half for a grid whose cells keep their size as the rows grow; a sample holds 16 vectors for each."""
        return int(np.clip(math.ceil(math.sqrt(rows / self.rows_per_cell)), 1, self.most_sample // 16))

    def sampled(self, rows: int) -> int:
        return min(self.most_sample, max(self.sample, 16 * self.centroids(rows)))


@dataclass(frozen=True)
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(x[:, :half], self.first), _squared(x[:, half:], self.second)

    def cells(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` cells of each row's traversal, nearest first."""
        d1, d2 = self.distances(x)
        o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        # Of the grid of ranks, only those with (i + 1)(j + 1) <= most can be among the first.
        ranks = [(i, j) for i in range(min(most, s1.shape[1])) for j in range(min(most // (i + 1), s2.shape[1]))]
        i, j = np.array([r[0] for r in ranks]), np.array([r[1] for r in ranks])
        order = np.argsort(s1[:, i] + s2[:, j], axis=1, kind="stable")[:, :most]
        return np.take_along_axis(o1, i[order], 1) * len(self.second) + np.take_along_axis(o2, j[order], 1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _squared(x, centroids).argmin(1)
        for c in range(k):
            own = x[near == c]
            if len(own):
                centroids[c] = own.mean(0)
    return centroids


def fit_index(sample: np.ndarray, rows: int, params: MultiIndexParams, widths: np.ndarray | None = None) -> MultiIndex:
    """Codebooks and the number of visits for ``rows`` vectors of the sample's kind (unit length). ``widths``: components that each has of its own, the rest being filled up with zeros."""
    rng = np.random.default_rng(11)
    k = min(params.centroids(rows), max(1, len(sample) // 8))
    half = sample.shape[1] // 2
    index = MultiIndex(_kmeans(sample[:, :half], k, rng), _kmeans(sample[:, half:], k, rng), 1)
    # Partners at exactly the threshold's angle, in random directions: the hardest links there are.
    chosen = rng.choice(len(sample), min(len(sample), 2048), replace=False)
    probe = sample[chosen]
    aside = rng.standard_normal(probe.shape)
    if widths is not None:
        aside *= np.arange(probe.shape[1]) < widths[chosen, None]
    aside -= (aside * probe).sum(1)[:, None] * probe
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
    partner = params.threshold * probe + math.sqrt(1 - params.threshold**2) * aside
    home = index.cells(partner, 1)[:, 0]
    back = index.cells(probe, 1)[:, 0]
    visits = 1
    while visits < k * k:
        # A pair is found if either end visits the other.
        found = (index.cells(probe, visits) == home[:, None]).any(1) | (index.cells(partner, visits) == back[:, None]).any(1)
        if found.mean() >= params.recall:
            break
        visits = min(k * k, visits + max(1, visits // 4))
    return MultiIndex(index.first, index.second, visits)


def _unit(column: pa.Array) -> list[bytes | None]:
    """Each row's unit vector as bytes; None for those that cannot link: null, empty, zero, or holding a null or a component that is not finite."""
    out: list[bytes | None] = []
    for v in column.to_pylist():
        x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
        most = np.abs(x).max() if len(x) else 0.0
        if np.isfinite(most) and most > 0:  # scaled first, so that no square overflows or vanishes
            x = x / most
            out.append((x / math.sqrt(float(x @ x))).astype("<f8").tobytes())
        else:
            out.append(None)
    return out


def _unpacked(rows: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors from bytes; with ``width``, shorter ones are filled up with zeros."""
    if width is None or all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    return np.frombuffer(b"".join([r.ljust(8 * width, b"\0") for r in rows]), "<f8").reshape(len(rows), width)


def _normalised(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit: every row; the unit vector is null where it can't link. The label also holds the width, as vectors of unlike widths are never compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unit(batch.column(2))
            labels = [None if u is None else f"{len(u) // 8} {x}" for u, x in zip(units, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])

    linkable = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return vectors.withColumn("embedding", F.when(linkable, F.col("embedding"))).mapInArrow(run, "vec_id long, label string, unit binary")


def _placed(points: DataFrame, index: MultiIndex) -> DataFrame:
    """Each vector with its home cell and the cells it visits (its home first)."""
    shared = points.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                cells = own.cells(_unpacked(batch.column(2).to_pylist(), own.first.shape[1] + own.second.shape[1]), own.visits)
                visits = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[:, 0], pa.int32()), visits], names=["pid", "label", "unit", "copies", "home", "visits"])

    return points.mapInArrow(run, "pid long, label string, unit binary, copies long, home int, visits array<int>")


def _meet(threshold: float, cells: int):
    """Verifies the visitors of a block against its residents; returns each vector's links found and a forest of links."""

    def run(group: pa.Table) -> pa.Table:
        lives = np.array(group.column("lives").to_pylist(), bool)
        ids, copies, home = group.column("pid").to_numpy(), group.column("copies").to_numpy(), group.column("home").to_numpy()
        x = _unpacked(group.column("unit").to_pylist())
        r, v = np.flatnonzero(lives), np.flatnonzero(~lives)
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        if len(r) and len(v):
            hit = (x[v] @ x[r].T >= threshold) & (ids[v][:, None] != ids[r][None])
            i, j = np.nonzero(hit)
            # A pair whose other end is visited in turn is counted where the larger id visits.
            met = np.unique(j)
            visits = group.column("visits").take(pa.array(r[met])).to_pylist()
            back = np.concatenate([k * cells + np.array(c, np.int64) for k, c in zip(met.tolist(), visits, strict=True)]) if len(met) else np.zeros(0, np.int64)
            once = ~np.isin(j * np.int64(cells) + home[v[i]], back) | (ids[v[i]] > ids[r[j]])
            i, j = v[i[once]], r[j[once]]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            while len(i):
                least = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, i, least)
                np.minimum.at(label, j, least)
                if (label == before).all():
                    break
        out = links > 0
        return pa.table({"pid": ids[out], "links": links[out], "root": label[out]})

    return run


def _links(points: DataFrame, rows: int, params: MultiIndexParams) -> DataFrame:
    """pid, links, root: what each block of a cell found of each of its vectors."""
    head = points.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "mark").limit(params.sampled(rows)).select("unit").collect()
    width = points.agg(F.max(F.length("unit"))).first()[0] // 8
    units = [bytes(r["unit"]) for r in head]
    index = fit_index(_unpacked(units, width), rows, params, np.array([len(u) // 8 for u in units]))
    cells = len(index.first) * len(index.second)
    placed = cut(_placed(points.select("pid", "label", "unit", "copies"), index), "imi-placed")
    sizes = cut(placed.groupBy("label", "home").agg(F.count("*").alias("n")), "imi-sizes")
    blocks = F.ceil(F.col("n") / params.block).cast("int")
    homes = placed.join(F.broadcast(sizes) if sizes.limit(1_000_001).count() <= 1_000_000 else sizes, ["label", "home"])
    resident = homes.withColumns({"cell": F.col("home"), "block": F.pmod(F.xxhash64("pid"), blocks).cast("int")})
    visiting = placed.withColumn("cell", F.explode("visits"))
    population = sizes.select("label", F.col("home").alias("cell"), "n")
    visiting = visiting.join(population, ["label", "cell"])
    counted = cut(visiting.groupBy("label", "cell").agg(F.count("*").alias("guests")), "imi-guests")
    visiting = visiting.join(counted, ["label", "cell"])
    tables = F.ceil(F.col("guests") / (2 * params.block)).cast("int")
    visiting = visiting.withColumn("table", F.pmod(F.xxhash64("pid", F.lit(7)), tables).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    resident = resident.join(counted, ["label", "cell"]).withColumn("table", F.explode(F.sequence(F.lit(0), tables - 1)))
    columns = ["label", "cell", "block", "table", "pid", "unit", "copies", "home"]
    both = resident.select(*columns, "visits", F.lit(True).alias("lives")).union(visiting.select(*columns, F.array().cast("array<int>").alias("visits"), F.lit(False).alias("lives")))
    return cut(both.groupBy("label", "cell", "block", "table").applyInArrow(_meet(params.threshold, cells), "pid long, links long, root long"), "imi-met")


def near_duplicates(vectors: DataFrame, params: MultiIndexParams | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links (other vectors of the same label at the threshold's cosine or above), component_id (smallest id reachable over links), kept (whether that is its own).

    Vectors that are null, empty, zero, or hold a null or a component that is not finite link with nothing, nor do
    those without a label or an id; vectors of unlike widths don't link. Equal vectors are one point of the index and
    link with each other. Rows that share an id are different vectors, each with links of its own, as are repeated
    rows; a row whose id is null has a null component and is kept. Other columns are ignored; an empty table gives an
    empty result.
    """
    params = params or MultiIndexParams()
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    unit = cut(_normalised(source), "imi-unit")
    marked = unit.withColumn("mark", F.md5("unit"))
    # Equal unit vectors of a label are one point with a weight, numbered once and for all by the table it is written to.
    points = marked.where("unit IS NOT NULL").groupBy("label", "mark").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    points = cut(points.select(F.monotonically_increasing_id().alias("pid"), "vec_id", "label", "unit", "copies", "mark"), "imi-points")
    rows = points.count()
    if not rows:
        return unit.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = _links(points, rows, params)
    links = met.groupBy("pid").agg(F.sum("links").alias("links"))
    components = connected_components(met.where("pid <> root").select(F.col("pid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "pid")
    named = cut(points.select("pid", "label", "mark", "vec_id", "copies").join(components, "pid", "left").join(links, "pid", "left"), "imi-named")
    least = cut(named.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least")), "imi-least")
    known = named.join(least, "component", "left").select("label", "mark", F.coalesce("least", "vec_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.select("vec_id", "label", "mark").join(known, ["label", "mark"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def brute_force_recall(vectors: np.ndarray, index: MultiIndex, threshold: float) -> float:
    """Share of the true links of a small set of unit vectors whose cells the index visits from either end."""
    hit = np.argwhere(np.triu(vectors @ vectors.T >= threshold, 1))
    if not len(hit):
        return 1.0
    cells = index.cells(vectors, index.visits)
    i, j = hit[:, 0], hit[:, 1]
    found = (cells[i] == cells[j, :1]).any(1) | (cells[j] == cells[i, :1]).any(1)
    return float(found.mean())
