"""Mutations as new snapshots: flips, verbs, incremental change detection, deferral and retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from . import matching


def flip_completed(planned: DataFrame, completed: DataFrame, lines: bool = True) -> DataFrame:
    """``planned`` (norm, checked, ...) with matched items checked; never unchecked, nothing else changed, the same again when repeated. Without ``lines`` the norm is left out, and made once only."""
    done, own = matching.sides(completed.select("norm"), planned.select("norm") if lines else planned)
    if not lines:
        return flip_lines(own, done).select(*[c for c in planned.columns if c != "norm"])
    # The hash is a column of its own; as a join's key it would be made again at each step of the join.
    known = planned.withColumn("line__", once(F.col("norm")))
    known = known.withColumn("own", F.when(F.col("line__").isNotNull(), matching.digest(F.col("line__"))))
    return _flipped(known, own, done).select(*planned.columns)


def flip_lines(own: DataFrame, done: DataFrame) -> DataFrame:
    """The same over lines that are made already (``matching.lines``)."""
    return _flipped(own, own, done)


def _flipped(known: DataFrame, own: DataFrame, done: DataFrame) -> DataFrame:
    met = matching.matched(matching.keyed(own, done), matching.keyed(done, own)).withColumn("hit__", F.lit(True))
    return known.join(met, "own", "left").withColumn("checked", F.col("checked") | F.coalesce("hit__", F.lit(False)))


def verbs(old: DataFrame, new: DataFrame, key: str, value: str, ended: DataFrame | None = None) -> DataFrame:
    """key, verb: confirm, revise, add, keep for what the new side is silent about (silence is no deletion), or retire for what is known to have ended."""
    o, n = old.select(F.col(key), F.col(value).alias("old")), new.select(F.col(key), F.col(value).alias("new"))
    both = o.withColumn("has_old", F.lit(True)).join(n.withColumn("has_new", F.lit(True)), key, "full_outer")
    verb = F.when(F.col("has_old").isNull(), "add").when(F.col("has_new").isNull(), "keep").when(F.col("old").eqNullSafe(F.col("new")), "confirm").otherwise("revise")
    if ended is not None:
        both = both.join(ended.select(key).distinct().withColumn("over", F.lit(True)), key, "left")
        verb = F.when(F.col("over") & F.col("has_old"), "retire").otherwise(verb)
    return both.select(key, verb.alias("verb"))


def verified(computed: DataFrame, on_disk: DataFrame, key: str) -> DataFrame:
    """The computed rows with ``state``: verified where the store, read again after the commit, holds the same row, else ``not on disk``."""
    held = on_disk.select(*computed.columns).distinct().withColumn("held__", F.lit(True))
    state = F.when(F.col("held__").isNotNull(), "verified").otherwise("not on disk")
    return computed.join(held, computed.columns, "left").withColumn("state", state).drop("held__")


def settle(stated: Column, inferred: Column) -> Column:
    """A stated preference outranks an inferred one."""
    return F.coalesce(stated, inferred)


def changes(old: DataFrame, new: DataFrame, key: str = "path", fields: tuple[str, ...] = ("mtime", "size"), full: bool = False) -> DataFrame:
    """key, change: added, removed, or changed where any field differs either way. ``full`` lists unchanged keys too, to be hashed again."""
    o = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("in_old"))
    n = new.select(key, *fields, F.lit(True).alias("in_new"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"old_{f}"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "changed").otherwise("same")
    out = o.join(n, key, "full_outer").select(key, change.alias("change"))
    return out if full else out.where("change <> 'same'")


def needs_tagging(notes: DataFrame, body_hash: Column, tagged_hash: str = "tagged_hash") -> DataFrame:
    return notes.where(~F.col(tagged_hash).eqNullSafe(body_hash))


def with_ceiling(pending: DataFrame, ceiling: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first ``ceiling`` rows of this run, and the rest, which stays pending. Rows must be distinct."""
    run = pending.orderBy(*order).limit(ceiling)
    return run, pending.join(run, pending.columns, "left_anti")


def next_state(attempts: Column, ok: Column, most: int = 3) -> Column:
    return F.when(ok, "done").when(attempts + 1 >= most, "failed").otherwise("pending")


def memoised(requests: DataFrame, memo: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Hits, with the stored value, and the distinct misses to be computed and stored."""
    return requests.join(memo, key), requests.join(memo, key, "left_anti").dropDuplicates([key])


def high_water(log: DataFrame, ts: str = "ts") -> DataFrame:
    """The window of the next run: from the day after the last success."""
    return log.agg(F.date_add(F.max(F.to_date(ts)), 1).alias("start"))


def as_of_anchor(anchors: DataFrame, day: str, value: str, today: str) -> DataFrame:
    """The latest value before a day."""
    return anchors.where(F.col(day) < F.lit(today).cast("date")).agg(F.max_by(value, day).alias("anchor"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the right's latest value at or before its time, by key: one union and one window, no range join."""
    from pyspark.sql.window import Window

    l = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(key, ts, F.col(value).alias("__value"), F.lit(0).alias("__side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(w)).where("__side = 1").drop("__value", "__side")
