"""Mail and chat for the daily plan, and its news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How automated senders' addresses begin, and the categories of bulk mail.
AUTOMATED = ("no-reply", "noreply", "do-not-reply", "notifications", "alerts", "updates", "mailer", "bounce")
BULK_CATEGORIES = ("promotions", "updates", "forums")


def addressed(mail: DataFrame, user: str, since: Column, to: str = "to", ts: str = "ts", most: int | None = None) -> DataFrame:
    """Messages to the user by name after the anchor; with ``most``, none to a longer list of recipients."""
    out = mail.where(F.array_contains(to, user) & (F.col(ts) > since))
    return out.where(F.size(to) <= most) if most else out


def automated(sender: Column, category: Column | None = None, bulk: Column | None = None) -> Column:
    """Vendor and automated mail: by address, category or bulk signals. What is unknown counts as a person's."""
    out = F.coalesce(F.lower(sender).rlike("^(" + "|".join(AUTOMATED) + ")@"), F.lit(False))
    if category is not None:
        out = out | F.coalesce(F.lower(category).isin(*BULK_CATEGORIES), F.lit(False))
    return out | F.coalesce(bulk, F.lit(False)) if bulk is not None else out


def threads(messages: DataFrame, user: str, thread: str = "thread", ts: str = "ts", sender: str = "sender") -> DataFrame:
    """thread, last_at, last_sender, n_messages of the threads whose last message is not the user's."""
    out = messages.groupBy(thread).agg(F.max(ts).alias("last_at"), F.max_by(sender, ts).alias("last_sender"), F.count("*").alias("n_messages"))
    return out.where(~F.col("last_sender").eqNullSafe(F.lit(user)))


def newest_first(*lists: DataFrame, ts: str = "at", tie: str = "id") -> DataFrame:
    """Several lists as one, from the newest; equal times by source and id."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.orderBy(F.desc(ts), "source", tie)


def news(items: DataFrame, floor: Column, now: Column, relevant: Column, score: Column, shown: DataFrame | None = None, most: int = 7) -> DataFrame:
    """The brief: retrieved items of the window that are relevant and have title, date, link and description; one per story, its best; none shown before; the best ``most`` by score, in that order.

    ``items``: story, title, url, published, description. ``score`` is pluggable; neither source nor age orders the brief.
    """
    whole = F.col("title").isNotNull() & F.col("url").isNotNull() & F.col("published").isNotNull() & (F.coalesce("description", F.lit("")) != "")
    kept = items.withColumn("score", score).where(whole & (F.col("published") > floor) & (F.col("published") <= now) & F.coalesce(relevant, F.lit(False)))
    if shown is not None:
        kept = kept.join(shown.select("story").distinct(), "story", "left_anti")
    best = Window.partitionBy("story").orderBy(F.desc("score"), "url")
    return kept.withColumn("k__", F.row_number().over(best)).where("k__ = 1").drop("k__").orderBy(F.desc("score"), "story").limit(most)


def redirected(items: DataFrame, originals: DataFrame) -> DataFrame:
    """Aggregator links replaced by the originals they point at, where those are known. ``originals``: url, original."""
    return items.join(originals, "url", "left").withColumn("url", F.coalesce("original", "url")).drop("original")
