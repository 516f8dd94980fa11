"""The engine's verbs as functions over frames: init, doctor, rebuild, status, run, vocab, tag-lint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.vault import rebuild_manifest
from . import checks, reconcile, tags

STATE = "path string, body_hash string, tagged_hash string, state string, attempts int"


def init(spark) -> DataFrame:
    """An empty state table."""
    return spark.createDataFrame([], STATE)


def doctor(notes: DataFrame, log: DataFrame) -> DataFrame:
    """The assertions that any vault must pass before it is run over."""
    return checks.report([checks.some(notes, "the manifest is not empty"), checks.hashes_match(notes), checks.log_fields(log)])


def rebuild(notes: DataFrame) -> DataFrame:
    """The state as the notes themselves have it: done where the tagged hash is the body's, else pending."""
    state = F.when(F.col("tagged_hash").eqNullSafe(F.col("body_hash")), "done").otherwise("pending")
    return rebuild_manifest(notes).select("path", "body_hash", "tagged_hash", state.alias("state"), F.lit(0).alias("attempts"))


def status(state: DataFrame) -> DataFrame:
    """state, n."""
    return state.groupBy("state").agg(F.count("*").alias("n"))


def run(state: DataFrame, tagger: Callable[[DataFrame], DataFrame], ceiling: int, most: int = 3) -> DataFrame:
    """The state after one pass over at most ``ceiling`` pending notes, in order of path; the rest stays pending.

    ``tagger`` takes the chosen rows and returns the paths it tagged; the others have failed once more and are given up
    after ``most`` attempts.
    """
    pending = state.where("state = 'pending'").select("path")
    chosen, _ = reconcile.with_ceiling(pending, ceiling, [F.col("path")])
    rows = state.join(chosen, "path", "left_semi")
    tagged = tagger(rows).select("path").distinct().withColumn("tagged__", F.lit(True))
    out = state.join(chosen.withColumn("chosen__", F.lit(True)), "path", "left").join(tagged, "path", "left")
    ok = F.coalesce("tagged__", F.lit(False))
    after = F.when(F.col("chosen__"), reconcile.next_state(F.col("attempts"), ok, most)).otherwise(F.col("state"))
    return out.select("path", "body_hash", F.when(F.col("chosen__") & ok, F.col("body_hash")).otherwise(F.col("tagged_hash")).alias("tagged_hash"), after.alias("state"), F.when(F.col("chosen__") & ~ok, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"))


def vocab(notes: DataFrame) -> DataFrame:
    return tags.vocabulary(notes)


def tag_lint(vocabulary: DataFrame, declared: DataFrame, canon: bool) -> DataFrame:
    """The merge plan of all three detectors."""
    pairs = tags.reordered(vocabulary).union(tags.case_or_separator(vocabulary)).union(tags.edit_distance(vocabulary, 2).select("tag1", "tag2")).distinct()
    return tags.merge_plan(pairs, vocabulary, declared if canon else None)
