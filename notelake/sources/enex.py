"""Exported note archives (ENEX) to markdown notes and attachments."""

from __future__ import annotations

import html
import mimetypes
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import enex_date, normalize_tag, sanitize_filename, trim_ws

_RESOURCE = T.StructType([T.StructField("data", T.StringType()), T.StructField("mime", T.StringType()), T.StructField("resource-attributes", T.StructType([T.StructField("file-name", T.StringType())]))])
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "content", "created", "updated")] + [T.StructField("tag", T.ArrayType(T.StringType())), T.StructField("resource", T.ArrayType(_RESOURCE))])

#: File endings by media type: the standard library's own table.
_TYPES = mimetypes.MimeTypes(filenames=())
ENDINGS = {kind: _TYPES.guess_extension(kind) for table in _TYPES.types_map_inv[::-1] for kind in table}


def ending_of(mime: Column) -> Column:
    """The file ending of a media type, empty for unknown ones."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), mime), F.lit(""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """note_no, and the archive's fields as they stand; an empty selection is an error. ``note_no`` follows file name, then place."""
    raw = spark.read.format("xml").option("rowTag", "note").option("pathGlobFilter", "*.enex").schema(SCHEMA).load(path)
    raw = raw.select("*", F.col("_metadata.file_name").alias("file"))
    if raw.isEmpty():
        raise FileNotFoundError(f"no notes in {path}")
    # Notes are numbered by partition: only the counts of each meet in one place, never the notes.
    part, place = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    raw = raw.select("*", part, place)
    sizes = raw.groupBy("file", "part").agg(F.count("*").alias("n"), F.min("place").alias("lowest"))
    before = F.sum("n").over(Window.orderBy("file", "lowest").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("file", "part", "lowest", F.coalesce(before, F.lit(0)).alias("before"))
    out = raw.join(F.broadcast(firsts), ["file", "part"])
    return out.withColumn("note_no", (F.col("place") - F.col("lowest") + F.col("before") + 1).cast("int")).drop("part", "place", "lowest", "before")


def named(notes: DataFrame, order: str = "note_no", title: str = "title") -> DataFrame:
    """Adds name: the title's file name, made unique over the whole run as ``name (2)``, in order; a suffixed name that a literal title already has takes the next free number."""
    base = sanitize_filename(F.coalesce(F.nullif(trim_ws(F.col(title)), F.lit("")), F.lit("Untitled Note")))
    keyed = notes.withColumn("__base", base)
    keyed = keyed.withColumn("__k", F.row_number().over(Window.partitionBy("__base").orderBy(order)))
    # Numbers that literal titles "base (n)" take are skipped by the copies of "base".
    form = r"^(.*) \((\d{1,9})\)$"
    taken = keyed.where(F.col("__base").rlike(form)).select(F.regexp_extract("__base", form, 1).alias("__base"), F.regexp_extract("__base", form, 2).cast("long").alias("n")).where("n >= 2").groupBy("__base").agg(F.sort_array(F.collect_set("n")).alias("__taken"))
    out = keyed.join(taken, "__base", "left")
    number = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("__k").cast("long"), lambda k, n: F.when(n <= k, k + 1).otherwise(k))
    return out.withColumn("name", F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit(" ("), number.cast("string"), F.lit(")")))).drop("__base", "__k", "__taken")


def attachments(notes: DataFrame) -> DataFrame:
    """note_no, idx, md5, mime, data, file: decoded resources, undecodable ones dropped; a name used before in the run gets six digits of its hash."""
    r = notes.select("note_no", "name", F.posexplode("resource").alias("idx", "r"))
    data = F.try_to_binary(F.regexp_replace("r.data", r"\s+", ""), F.lit("base64"))
    r = r.select("note_no", "name", "idx", data.alias("data"), F.coalesce("r.mime", F.lit("application/octet-stream")).alias("mime"), F.col("r.resource-attributes.file-name").alias("given")).where("data IS NOT NULL")
    r = r.withColumn("md5", F.md5("data"))
    ending = ending_of(F.col("mime"))
    made = F.concat("name", F.lit("-attachment-"), F.col("idx").cast("string"), ending)
    r = r.withColumn("file", F.when(F.coalesce("given", F.lit("")) != "", sanitize_filename(F.col("given"))).otherwise(made))
    again = F.row_number().over(Window.partitionBy("file").orderBy("note_no", "idx")) > 1
    unique = F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit("-"), F.substring("md5", 1, 6), F.regexp_extract("file", r"(\.[^.]*)$", 1))
    return r.withColumn("file", F.when(again, unique).otherwise(F.col("file"))).select("note_no", "idx", "md5", "mime", "data", "file")


class _Markdown(HTMLParser):
    """A documented subset: headings, paragraphs, breaks, emphasis, links, images, lists, quotes, code, rules, checkboxes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str] = []
        self.lists: list[list] = []
        self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in ("p", "div", "table"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("  \n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "en-todo":
            self.out.append("[x] " if a.get("checked") == "true" else "[ ] ")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "tr":
            self.out.append("\n| ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag[0] == "h" and tag[1:].isdigit() or tag in ("p", "div", "blockquote"):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(content: str | None) -> str:
    """One note's content: wrapper and declarations stripped, media as ``⟦media:hash⟧``, note links as wikilinks."""
    if not content:
        return ""
    text = re.sub(r"(?s)<\?xml.*?\?>|<!DOCTYPE[^>]*>|</?en-note[^>]*>", "", content)
    media = lambda m: f"<p>⟦media:{h[1].lower()}⟧</p>" if (h := re.search(r'hash="([0-9a-fA-F]+)"', m[0])) else ""
    text = re.sub(r"(?s)<en-media\b[^>]*?(?:/>|>\s*</en-media>)", media, text)
    p = _Markdown()
    p.feed(text)
    p.close()
    out = "".join(p.out)
    safe = lambda t: re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|#^\[\]]', "-", t)).strip()
    out = re.sub(r"\[([^\]]*)\]\(evernote://[^)]*\)", lambda m: f"[[{safe(html.unescape(m[1]))}]]", out)
    return re.sub(r"\n{3,}", "\n\n", out).strip() + "\n"


@F.pandas_udf(T.StringType())
def markdown_udf(content: pd.Series) -> pd.Series:
    return content.map(to_markdown)


def convert(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes (note_no, name, title, created, updated, tags, body) and their attachments. Media are resolved by a left join on (note, hash)."""
    own = named(notes)
    files = attachments(own)
    text = own.select("note_no", markdown_udf("content").alias("md"))
    parts = text.select("note_no", F.posexplode(F.split("md", "⟦")).alias("k", "part"))
    parts = parts.withColumn("md5", F.nullif(F.regexp_extract("part", r"^media:([0-9a-f]+)⟧", 1), F.lit("")))
    one = files.groupBy("note_no", "md5").agg(F.min_by("file", "idx").alias("file"), F.min_by("mime", "idx").alias("mime"))
    joined = parts.join(one, ["note_no", "md5"], "left")
    shown = F.when(F.col("file").isNull(), F.concat(F.lit("*[missing attachment: "), "md5", F.lit("]*"))).when(F.col("mime").startswith("image/") | (F.col("mime") == "application/pdf"), F.concat(F.lit("![["), "file", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "file", F.lit("]]")))
    piece = F.when(F.col("md5").isNotNull(), F.concat(shown, F.regexp_replace("part", "^media:[0-9a-f]+⟧", ""))).when(F.col("k") > 0, F.concat(F.lit("⟦"), "part")).otherwise(F.col("part"))
    body = joined.withColumn("piece", piece).groupBy("note_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("body"))
    tags = F.filter(F.transform(F.coalesce("tag", F.array().cast("array<string>")), normalize_tag), lambda t: t != "")
    out = own.join(body, "note_no", "left").select("note_no", "name", "title", enex_date(F.col("created")).alias("created"), enex_date(F.col("updated")).alias("updated"), tags.alias("tags"), F.coalesce("body", F.lit("")).alias("body"))
    return out, files
