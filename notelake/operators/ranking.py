"""Priority tags, completion probability in hundredths, and the ranked, capped list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Base rates and adjustments, in hundredths.
BASE = {"P1": 70, "P2": 45, "P3": 20}
SOON, ATOMIC, STREAK_STEP, STREAK_CAP, SAME_DAY, SAME_DAY_FROM = 15, 10, 5, 30, 10, 0.7
LOWEST, HIGHEST = 5, 97
STUCK_BELOW, QUICK_ABOVE = 35, 80


def priority_tag(urgent: Column, low: Column, prior: Column | None = None) -> Column:
    """P1 on urgent evidence, P3 on low, else the prior tag if any, else P2."""
    settled = F.coalesce(prior, F.lit("P2")) if prior is not None else F.lit("P2")
    return F.when(urgent, "P1").when(low, "P3").otherwise(settled)


def completion(priority: Column, soon: Column, atomic: Column, streak: Column, rate: Column) -> Column:
    """Hundredths, between 5 and 97. Without history (null streak and rate) those terms are left out."""
    base = F.when(priority == "P1", BASE["P1"]).when(priority == "P3", BASE["P3"]).otherwise(BASE["P2"])
    p = base + F.when(soon, SOON).otherwise(0) + F.when(atomic, ATOMIC).otherwise(-ATOMIC)
    p = p - F.when(streak.isNotNull(), F.least(streak * STREAK_STEP, F.lit(STREAK_CAP))).otherwise(0) + F.when(rate >= SAME_DAY_FROM, SAME_DAY).otherwise(0)
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), p)).cast("int")


def mismatch(priority: Column, p: Column) -> Column:
    return F.when((priority == "P1") & (p < STUCK_BELOW), "stuck").when((priority == "P3") & (p > QUICK_ABOVE), "quick win")


def note_days(tasks: DataFrame, as_of: str, n: int = 7) -> DataFrame:
    """The n latest days with a note before ``as_of``, numbered from the newest. A top-k, so no day leaves its partition but the n best."""
    days = tasks.where(F.col("day") < F.lit(as_of).cast("date")).select("day").distinct().orderBy(F.desc("day")).limit(n)
    return days.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("day"))))


def history(tasks: DataFrame, as_of: str, n: int = 7) -> DataFrame:
    """One row per item and note day of the last n: checked if it was in any of that day's lines."""
    return tasks.join(F.broadcast(note_days(tasks, as_of, n)), "day").groupBy("item", "day", "idx").agg(F.max("checked").alias("checked"))


def history_stats(d: DataFrame) -> DataFrame:
    """item, occurrences, rate (checked days over days), streak (unchecked notes in a row from the newest)."""
    open_days = F.array_sort(F.collect_set(F.when(~F.col("checked"), F.col("idx"))))
    # The k-th smallest open index equals k exactly while the run from the newest note is unbroken.
    run = F.size(F.filter(F.transform(open_days, lambda x, k: x == k + 1), lambda ok: ok))
    return d.groupBy("item").agg(F.countDistinct("day").alias("occurrences"), F.avg(F.col("checked").cast("int")).alias("rate"), run.cast("long").alias("streak"))


def ranked(scored: DataFrame, most: int) -> DataFrame:
    """The best ``most`` rows: priority first, then completion, then item."""
    return scored.orderBy("priority", F.desc("p"), "item").limit(most)


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
