"""Quality by hierarchical empirical Bayes: a text's own evidence within its host's and path's.

A logistic model on form features, fitted on a bounded sample of labelled texts, gives each text's evidence. Sums of
it by path, then by host, then overall give the levels' means; method-of-moments strengths say how far a site's
own texts outweigh the level above, so sparse sites shrink to their host and sparse hosts to the whole. A text's
posterior odds are its own odds times its path's over the whole's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import cut


@dataclass(frozen=True)
class QualityParams:
    #: Most labelled texts the model is fitted on; those of the smallest hash are taken.
    most_labelled: int = 20_000
    ridge: float = 1.0
    #: Share of the site's log odds (path against whole) that enters a text's posterior.
    site_weight: float = 1.0
    keep_from: float = 0.5
    #: A posterior never leans on fewer pseudo-texts of the level above than this, nor on more than the other.
    least_strength: float = 5.0
    most_strength: float = 10_000.0


_SYMBOLS = re.compile(r"[#$%&*|{}<>\\^~=_+@/\[\]]")
FEATURES = ("bias", "words", "symbols", "capitals", "exclaims", "repeated_words", "repeated_lines", "top_word", "bars", "digits", "short", "word_length")


def features(text: str) -> list[float]:
    """Form of a text: sizes and shares, each between 0 and about 1."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = set(words)
    # Distinct words of prose grow about as a power of its length; 1 is prose, 0 a single word repeated.
    expected = max(1.0, min(n, 2.2 * n**0.8))
    run = 0
    for a, b in zip(words, words[1:], strict=False):
        run += a == b
    upper = sum(map(str.isupper, words))
    signs = len(_SYMBOLS.findall(text))
    return [
        1.0,
        min(1.0, np.log1p(n) / 10),
        min(1.0, 8 * signs / size),
        upper / max(1, n),
        min(1.0, 20 * text.count("!") / size),
        1 - min(1.0, len(distinct) / expected),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 3 * run / max(1, n)),
        min(1.0, 2 * text.count("|") / max(1, n)),
        min(1.0, 5 * sum(map(text.count, "0123456789")) / size),
        float(n < 5),
        min(1.0, (len(text) / max(1, n)) / 20),
    ]


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights of the text model, from at most ``most_labelled`` labelled ids. Without labelled texts all are 0, so every text's evidence is one half."""
    own = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64("i"), "i", "y").limit(params.most_labelled)
    sample = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("text")).join(F.broadcast(own), "i").select("i", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64())), batch.column(2)], names=["i", "f", "y"])

    # A labelled id counts once, whatever the rows that share it: by the least of their features.
    rows = sample.mapInArrow(run, "i long, f array<double>, y int").groupBy("i", "y").agg(F.min("f").alias("f")).orderBy("i", "y").collect()
    if not rows:
        return np.zeros(len(FEATURES))
    return _fit(np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows], float), params.ridge)


def evidence(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path and p, the text model's probability, kept off 0 and 1 by a thousandth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(3).to_pylist()]).reshape(-1, len(FEATURES))
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), 0.001, 0.999)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["doc_id", "host", "path", "p"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, host string, path string, p double")


def _strength(groups: DataFrame, mean: str, above: str, params: QualityParams) -> float:
    """How many texts of its own a group needs to weigh as much as the level above: variance within over variance between.

    ``groups`` has n, s, q (count, sum and sum of squares of the evidence), the group's ``mean`` and the ``above`` one.
    """
    row = groups.agg(
        F.sum(F.col("q") - F.col("n") * F.col(mean) * F.col(mean)).alias("within"),
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") * (F.col(mean) - F.col(above)) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if not row["groups"] or row["n"] <= row["groups"]:
        return params.most_strength
    within = max(1e-9, row["within"] / (row["n"] - row["groups"]))
    spread = row["n"] - row["squares"] / row["n"]
    between = (row["between"] - (row["groups"] - 1) * within) / spread if spread > 0 else 0.0
    return float(np.clip(within / between if between > 0 else params.most_strength, params.least_strength, params.most_strength))


def posteriors(scored: DataFrame, params: QualityParams) -> DataFrame:
    """host, path, host_mean, path_mean, whole: shrunken means of every site. A hot host is summed before it moves."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = cut(scored.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    hosts = cut(hosts.withColumns({"own": F.col("s") / F.col("n"), "whole": F.lit(float(mean))}), "quality-hosts")
    k = _strength(hosts, "own", "whole", params)
    hosts = hosts.select("host", "whole", ((F.col("s") + k * F.col("whole")) / (F.col("n") + k)).alias("host_mean"))
    paths = cut(paths.join(hosts, "host").withColumn("own", F.col("s") / F.col("n")), "quality-means")
    k = _strength(paths, "own", "host_mean", params)
    return paths.select("host", "path", "whole", "host_mean", ((F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)).alias("path_mean"))


def judge(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, host, path, text_score, site_score (its path's shrunken mean), posterior, keep.

    A null host or path is the empty one; a null text is as an empty one; a null id is returned as null; repeated rows
    count as often as they stand. Other columns are ignored; an empty table gives an empty result.
    """
    params = params or QualityParams()
    weights = fit(docs, labels, params, doc_id, text, label)
    scored = cut(evidence(docs, weights, doc_id, text, host, path), "quality-evidence")
    sites = cut(posteriors(scored, params), "quality-sites")
    few = sites.limit(200_001).count() <= 200_000
    joined = scored.join(F.broadcast(sites) if few else sites, ["host", "path"])

    def odds(p):
        return F.log(p / (1 - p))

    site = odds(F.col("path_mean")) - odds(F.col("whole"))
    posterior = 1 / (1 + F.exp(-(odds(F.col("p")) + params.site_weight * site)))
    return joined.select("doc_id", "host", "path", F.col("p").alias("text_score"), F.col("path_mean").alias("site_score"), posterior.alias("posterior"), (posterior >= params.keep_from).alias("keep"))
