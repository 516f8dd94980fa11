"""The link graph: extraction, resolution and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws

_NOT_NOTES = ("CLAUDE.md", "USER.md", "Welcome")


def wikilinks(notes: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """path, target, is_embed: one row per link; alias and anchor dropped."""
    links = F.regexp_extract_all(body, F.lit(r"(!?\[\[[^\]]*\]\])"), F.lit(1))
    edges = notes.select(F.col(path).alias("path"), F.explode(links).alias("raw"))
    target = trim_ws(F.regexp_extract("raw", r"\[\[([^\]|#]*)", 1))
    return edges.select("path", target.alias("target"), F.col("raw").startswith("!").alias("is_embed")).where("target <> ''")


def hrefs(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(F.col(page_id).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("target"))


def unresolved(edges: DataFrame, titles: DataFrame, exempt: tuple[str, ...] = _NOT_NOTES) -> DataFrame:
    """Edges whose target is no title."""
    return edges.where(~F.col("target").isin(*exempt)).join(titles.select(F.col("title").alias("target")).distinct(), "target", "left_anti")


def backlinks(edges: DataFrame) -> DataFrame:
    """target, n_links, n_sources."""
    return edges.groupBy("target").agg(F.count("*").alias("n_links"), F.countDistinct("src").alias("n_sources"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes nothing links to."""
    return nodes.join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_anti")


def deadends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that link to nothing."""
    return nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
