"""The weekly and daily plan around its ranking: candidates, screens, routing, sections, staging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import within
from ..functions.text import once
from .matching import match_items


def candidate_pool(**sources: DataFrame) -> DataFrame:
    """The union of the sources' candidates with their ``source``; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in sources.items()])


def for_user(owner: Column, user: str, explicit: Column | None = None) -> Column:
    """Whether a candidate is nobody else's: no owner, the user, or assigned to the user in so many words."""
    said = F.coalesce(explicit, F.lit(False)) if explicit is not None else F.lit(False)
    return owner.isNull() | (owner == user) | said


def route(candidates: DataFrame, headers: DataFrame, by: str = "origin") -> tuple[DataFrame, DataFrame]:
    """Candidates under the project or area whose alias their origin is (``headers``: alias, header), and those without one, kept aside to be reported."""
    aliases = headers.select(F.lower("alias").alias("alias__"), "header").groupBy("alias__").agg(F.min("header").alias("header"))
    out = candidates.join(aliases, F.lower(by) == F.col("alias__"), "left").drop("alias__")
    return out.where("header IS NOT NULL"), out.where("header IS NULL").drop("header")


def route_legacy(items: DataFrame, headers: DataFrame, legacy: tuple[str, ...] = ("Admin", "Personal")) -> tuple[DataFrame, DataFrame]:
    """Items of sections that plans no longer have go to the header their text names; those that name none are kept aside. Others stay under their section."""
    old = items.where(F.col("section").isin(*legacy))
    words = old.select("*", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word__"))
    named = words.join(headers.select(F.lower("alias").alias("word__"), "header"), "word__")
    home = named.groupBy(*items.columns).agg(F.min("header").alias("header"))
    rest = items.where(~F.col("section").isin(*legacy) | F.col("section").isNull()).withColumn("header", F.col("section"))
    return rest.unionByName(home), old.join(home.select(*items.columns), items.columns, "left_anti")


def section_order(sections: DataFrame) -> DataFrame:
    """Adds ``place``: projects in declared order (``pos``), then areas by name. ``sections``: name, kind (project or area), pos."""
    order = Window.orderBy(F.col("kind") != "project", F.when(F.col("kind") == "project", F.col("pos")), "name")
    return sections.withColumn("place", F.row_number().over(order))


def ranked_in_section(items: DataFrame, section: str = "section") -> DataFrame:
    """Adds ``place`` within each section: priority, then completion from the highest, then the item's own order."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy("priority", F.desc("p"), "ordinal")))


def curated_open(items: DataFrame) -> DataFrame:
    """Unchecked items outside Suggested subsections."""
    return items.where(~F.col("checked") & (F.lower(F.coalesce("subsection", F.lit(""))) != "suggested"))


def on_calendar(items: DataFrame, events: DataFrame, least: int = 2, text: str = "text", title: str = "title", shortest: int = 4) -> DataFrame:
    """Items that share at least ``least`` distinct words, of ``shortest`` letters or more, with one event. ``items`` has ``id``, ``events`` has ``event``."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= shortest)))
    # Items and events of the same words are one, and no pair of the two is kept: an item's test ends at the first event that passes.
    held = items.withColumn("words__", once(words(F.col(text))))
    sets = held.select("words__").where(F.size("words__") >= least).distinct()
    asked = events.select(once(words(F.col(title))).alias("asked__")).where(F.size("asked__") >= least).distinct()
    asked = asked.select("asked__", F.explode("asked__").alias("word__"))
    shares = (F.col("word__") == F.col("one__")) & (F.size(F.array_intersect("words__", "asked__")) >= least)
    met = sets.select("words__", F.explode("words__").alias("one__")).join(asked, shares, "left_semi").select("words__").distinct()
    return held.join(met, "words__", "left_semi").select(*items.columns)


def stage(sections: DataFrame, additions: DataFrame) -> DataFrame:
    """``sections`` (section, text) with each section's new items below ``#### Suggested``, best first; a section that has that heading keeps it. Lines already there are not added again, and nothing else changes.

    ``additions``: section, text, priority, p.
    """
    line = F.concat(F.lit("- [ ] "), F.col("text"), F.lit(" `["), F.col("priority"), F.lit("]`"))
    fresh = additions.select("section", line.alias("line"), "priority", "p").groupBy("section", "line").agg(F.min("priority").alias("priority"), F.max("p").alias("p"))
    held = sections.select("section", F.explode(F.split("text", "\n")).alias("line")).distinct()
    fresh = fresh.join(held, ["section", "line"], "left_anti")
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("p"), "line"))), lambda x: x["line"]), "\n")
    new = fresh.groupBy("section").agg(block.alias("block__"))
    has = F.col("text").rlike(r"(?m)^#### Suggested[ \t]*$")
    body = F.regexp_replace("text", r"\n+\z", "")
    staged = F.when(has, F.concat(body, F.lit("\n"), F.col("block__"), F.lit("\n"))).otherwise(F.concat(body, F.lit("\n\n#### Suggested\n"), F.col("block__"), F.lit("\n")))
    return sections.join(new, "section", "left").withColumn("text", F.when(F.col("block__").isNull(), F.col("text")).otherwise(staged)).drop("block__")


def add_to_note(existing: DataFrame, candidates: DataFrame, norm: str = "norm") -> DataFrame:
    """The lines of a note with the candidates that match none of them; lines that stand are not rewritten."""
    fresh = match_items(candidates, existing.select(norm), "left_anti", norm, norm)
    return existing.unionByName(fresh.dropDuplicates([norm]), allowMissingColumns=True)


def flip_lines(lines: DataFrame, completed: DataFrame, norm: Callable[[Column], Column]) -> DataFrame:
    """Note lines (line, ...) with the open boxes of completed items checked; not a character else changes. ``completed``: norm."""
    open_box = r"^(\s*- \[) (\] .*)$"
    is_open = F.col("line").rlike(open_box)
    named = lines.withColumn("norm__", F.when(is_open, norm(F.regexp_replace("line", r"^\s*- \[ \] ", ""))))
    done = match_items(named.where("norm__ IS NOT NULL").select(F.col("norm__").alias("norm")).distinct(), completed, "left_semi").withColumn("done__", F.lit(True))
    out = named.join(done, named["norm__"] == done["norm"], "left").drop("norm")
    return out.withColumn("line", F.when(F.col("done__"), F.regexp_replace("line", open_box, "$1x$2")).otherwise(F.col("line"))).drop("norm__", "done__")


def in_horizon(meetings: DataFrame, lo: Column, hi: Column, scope: str | None = None, title: str = "title") -> DataFrame:
    """Meetings whose day lies in the horizon and whose title holds the scope, case aside."""
    out = meetings.where(within(F.col("day"), lo, hi))
    return out.where(F.lower(title).contains(scope.lower())) if scope else out


def latest(meetings: DataFrame, key: str = "scope", day: str = "day", columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """Each scope's most recent meeting."""
    return meetings.groupBy(key).agg(F.max(day).alias(day), *[F.max_by(c, F.struct(day, c)).alias(c) for c in columns])


def cross_check(declared: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """key, status: both, only declared, or only found."""
    a = declared.select(key).distinct().withColumn("declared", F.lit(True))
    b = found.select(key).distinct().withColumn("found", F.lit(True))
    status = F.when(F.col("found").isNull(), "only declared").when(F.col("declared").isNull(), "only found").otherwise("both")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def uncorroborated(done: DataFrame, activity: DataFrame, keys: list[str]) -> DataFrame:
    """What a plan calls done without any activity of the same keys."""
    return done.join(activity.select(*keys).distinct(), keys, "left_anti")


def activity_gap(stated: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """key, listed, active: what is stated, observed or both."""
    a = stated.select(key).distinct().withColumn("listed", F.lit(True))
    b = observed.select(key).distinct().withColumn("active", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("active", F.lit(False)).alias("active"))


def plan_sections(last: Column) -> tuple[Column, Column]:
    """The starts of the previous and the second last week."""
    return F.date_sub(last, 7), F.date_sub(last, 14)


def previous_plans(plans: DataFrame, week: str = "week") -> DataFrame:
    """Adds ``previous`` and ``two_back``: the weeks of the plans before each, whatever lies between."""
    order = Window.orderBy(week)
    weeks = plans.select(week).distinct()
    return plans.join(F.broadcast(weeks.select(week, F.lag(week, 1).over(order).alias("previous"), F.lag(week, 2).over(order).alias("two_back"))), week)


def first_seen(df: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """The first row of each key, case-folded keys counting as one, in order of first place."""
    return df.withColumn("key__", key).withColumn("k__", F.row_number().over(Window.partitionBy("key__").orderBy(pos))).where("k__ = 1").drop("key__", "k__")


def planned_documents(counts: dict[str, Column], per: dict[str, Column], fixed: Column) -> Column:
    """How many documents a plan comes to: each count times its rate, and the fixed ones."""
    return reduce(lambda a, b: a + b, [counts[k] * per[k] for k in counts]) + fixed


def groups_with_children(records: DataFrame, path: str = "path") -> DataFrame:
    """grp, child, and the records' columns: each record under the first segment of its path, groups that have no record of their own included."""
    own = records.withColumns({"grp": F.split_part(path, F.lit("/"), F.lit(1)), "child": F.nullif(F.regexp_replace(path, r"^[^/]*/?", ""), F.lit(""))})
    heads = own.groupBy("grp").agg(F.min("pos").alias("first"))
    return own.join(heads, "grp")
