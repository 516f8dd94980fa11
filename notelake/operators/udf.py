"""The pluggable surface: scorers, taggers, model calls and roles by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reconcile import memoised


def model_column(df: DataFrame, prompt: str, call: Callable[[str], str | None], out: str = "reply", attempts: int = 2, least_bytes: int = 1, stub: Callable[[str], str] | None = None) -> DataFrame:
    """A model call per row, retried; a short or failed reply becomes the stub's, or null. Runs by Arrow batches."""

    def ask(text: str) -> str | None:
        for _ in range(attempts):
            try:
                reply = call(text)
            except Exception:  # noqa: BLE001 - a failed call counts as an attempt
                reply = None
            if reply is not None and len(reply.encode()) >= least_bytes:
                return reply
        return stub(text) if stub else None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(ask)

    return df.withColumn(out, run(F.col(prompt)))


def cached_model(df: DataFrame, memo: DataFrame, prompt: str, model: str, call: Callable[[str], str | None]) -> tuple[DataFrame, DataFrame]:
    """Replies from the memo where it has them, and the new rows (key, reply) to be stored for the rest."""
    keyed = df.withColumn("key", F.sha2(F.concat(F.lit(model + "\n"), F.col(prompt)), 256))
    hits, misses = memoised(keyed, memo)
    fresh = model_column(misses, prompt, call)
    stored = fresh.select("key", "reply").where("reply IS NOT NULL")
    return hits.select(*df.columns, "reply").unionByName(keyed.join(stored, "key").select(*df.columns, "reply")), stored


def call_stats(calls: DataFrame) -> DataFrame:
    """live, cache and failed calls."""
    return calls.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("live", "cache", "failed")])


def keyword_tagger(notes: DataFrame, vocabulary: DataFrame, body: str = "body", path: str = "path", broadcast_tags: int = 100_000) -> DataFrame:
    """path, tag: a note gets each vocabulary tag whose last segment is one of its words.

    A vocabulary of up to ``broadcast_tags`` tags is broadcast; a larger one is joined by a shuffle. The notes' words,
    which the optimizer takes for few where the notes' source is well compressed, are never broadcast.
    """
    words = notes.select(path, F.explode(F.array_distinct(F.split(F.lower(body), r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''")
    tags = vocabulary.select("tag", F.element_at(F.split("tag", "/"), -1).alias("word")).distinct()
    few = tags.limit(broadcast_tags + 1).count() <= broadcast_tags
    return (words.join(F.broadcast(tags), "word") if few else words.hint("merge").join(tags, "word")).select(path, "tag")


class Roles:
    """Frames by role, and where what they contribute lands."""

    def __init__(self) -> None:
        self._providers: dict[str, tuple[Callable[[], DataFrame], str]] = {}

    def register(self, role: str, provider: Callable[[], DataFrame], lands: str) -> None:
        self._providers[role] = (provider, lands)

    def pull(self, roles: list[str]) -> dict[str, DataFrame]:
        """By landing place, the union of the connected roles' frames with their role."""
        out: dict[str, DataFrame] = {}
        for role in roles:
            if role in self._providers:
                provider, lands = self._providers[role]
                df = provider().withColumn("role", F.lit(role))
                out[lands] = out[lands].unionByName(df, allowMissingColumns=True) if lands in out else df
        return out


def redact(df: DataFrame, text: str, patterns: dict[str, str], screen: Column | None = None) -> DataFrame:
    """Each category's pattern replaced by its mark; rows that the second screen does not pass are dropped, unscreened ones too."""
    out = df
    for category, pattern in patterns.items():
        out = out.withColumn(text, F.regexp_replace(text, pattern, f"[{category}]"))
    return out.where(F.coalesce(screen, F.lit(False))) if screen is not None else out
