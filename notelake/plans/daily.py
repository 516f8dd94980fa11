"""The daily plan: history, priority, completion, order and cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranking


def scored(tasks: DataFrame, as_of: str) -> DataFrame:
    """Every item seen open in the last seven notes with its priority, completion in hundredths and flag.

    The history is built once and reduced to a row per item before anything is joined to it.
    """
    window = tasks.join(F.broadcast(ranking.note_days(tasks, as_of)), "day")
    facts = window.groupBy("item", "day", "idx").agg(F.max("checked").alias("checked"), F.min("prior_tag").alias("prior_tag"), F.min("project").alias("project"))
    stats = ranking.history_stats(facts)
    now = facts.groupBy("item").agg(F.min("prior_tag").alias("prior_tag"), F.min("project").alias("project"), (F.min("idx") == 1).alias("soon"), F.count_if(~F.col("checked")).alias("n_open"))
    pool = now.where("n_open > 0").join(stats, "item")
    priority = ranking.priority_tag(F.lit(False), F.lit(False), F.col("prior_tag"))
    p = ranking.completion(F.col("priority"), F.col("soon"), F.length("item") <= 6, F.col("streak"), F.col("rate"))
    out = pool.withColumn("priority", priority).withColumn("p", p)
    return out.select("item", "project", "priority", "p", "streak", "occurrences", ranking.mismatch(F.col("priority"), F.col("p")).alias("flag"))


def scored_candidates(candidates: DataFrame, tasks: DataFrame, as_of: str) -> DataFrame:
    """Candidates (item, prior_tag, soon) with priority, completion and flag. One without history in the last seven notes has neither streak nor rate, so those terms are left out."""
    stats = ranking.history_stats(ranking.history(tasks, as_of))
    pool = candidates.join(stats, "item", "left")
    out = pool.withColumn("priority", ranking.priority_tag(F.lit(False), F.lit(False), F.col("prior_tag")))
    out = out.withColumn("p", ranking.completion(F.col("priority"), F.col("soon"), F.length("item") <= 6, F.col("streak"), F.col("rate")))
    return out.select("item", "priority", "p", "streak", "occurrences", ranking.mismatch(F.col("priority"), F.col("p")).alias("flag"))


def top(tasks: DataFrame, as_of: str, most: int = 10) -> DataFrame:
    return ranking.ranked(scored(tasks, as_of), most).select("item", "project", "priority", "p")


def overflow(tasks: DataFrame, as_of: str, most: int = 10) -> DataFrame:
    """What the cap leaves out."""
    pool = scored(tasks, as_of)
    return pool.join(ranking.ranked(pool, most).select("item"), "item", "left_anti").select("item", "project", "priority", "p")


SQL = """
days AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS idx FROM (SELECT DISTINCT day FROM tasks WHERE day < DATE '2001-08-01' ORDER BY day DESC LIMIT 7)),
facts AS (SELECT item, t.day, idx, bool_or(checked) AS checked, min(prior_tag) AS prior_tag, min(project) AS project FROM tasks AS t JOIN days AS d ON t.day = d.day GROUP BY ALL),
opens AS (SELECT item, idx, row_number() OVER (PARTITION BY item ORDER BY idx) AS k FROM facts WHERE NOT checked),
stats AS (SELECT f.item, count(DISTINCT f.day) AS occurrences, avg(f.checked::INT) AS rate, coalesce(max(s.streak), 0)::BIGINT AS streak
  FROM facts AS f LEFT JOIN (SELECT item, count(*) AS streak FROM opens WHERE idx = k GROUP BY item) AS s ON f.item = s.item GROUP BY f.item),
now AS (SELECT item, min(prior_tag) AS priority, min(project) AS project, min(idx) = 1 AS soon, count(*) FILTER (NOT checked) AS n_open FROM facts GROUP BY item),
scored AS (SELECT item, project, priority, streak, occurrences, greatest(5, least(97,
    CASE priority WHEN 'P1' THEN 70 WHEN 'P3' THEN 20 ELSE 45 END + CASE WHEN soon THEN 15 ELSE 0 END + CASE WHEN length(item) <= 6 THEN 10 ELSE -10 END
    - least(streak * 5, 30) + CASE WHEN rate >= 0.7 THEN 10 ELSE 0 END))::INT AS p
  FROM now JOIN stats USING (item) WHERE n_open > 0)
"""
