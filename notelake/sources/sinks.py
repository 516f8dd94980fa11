"""Writers: notes, attachments, logs, sections, tables and manifests.

Text is put together in column expressions; only files of one row each are written outside Spark's own writers, by
the partitions that hold them, to a folder all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import log_sanitize, required_flag, yaml_escape
from .vault import registry_rows


def note_text(body: Column, tags: Column, tagged: Column, tagged_hash: Column, kind: Column, extras: Column | None = None) -> Column:
    """Frontmatter (extra lines first, then tags, tagged, tagged_hash, type) and body. Null values leave their line out."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n  - "), F.array_join(tags, "\n  - ")))
    return F.concat(F.concat_ws("\n", F.lit("---"), *([extras] if extras is not None else []), listed, line("tagged", tagged), line("tagged_hash", tagged_hash), line("type", kind), F.lit("---"), F.lit("")), body)


def imported_text(title: Column, created: Column, updated: Column, tags: Column, source: Column, body: Column) -> Column:
    """An imported note: title, created, updated, tags, source, then body."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n  - "), F.array_join(tags, "\n  - ")))
    return F.concat(F.concat_ws("\n", F.lit("---"), line("title", yaml_escape(title)), line("created", created), line("updated", updated), listed, line("source", source), F.lit("---"), F.lit("")), body)


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content", deny: tuple[str, ...] = (), backup: bool = True) -> None:
    """One file per row below ``root``, a folder that all executors see as a local one. A path that leaves the root or fits a denied pattern fails the job; what stood there is kept as ``.bak``.

    A root in a store that only Spark's file systems reach raises ValueError; such stores take tables, not files of one row.
    """
    scheme, _, rest = root.rpartition("://")
    if scheme not in ("", "file"):
        raise ValueError(f"{root} is no folder that executors see as a local one")
    own = rest if scheme else root.removeprefix("file:")

    def put(rows: Iterator[Row]) -> None:
        top = Path(own).resolve()
        for row in rows:
            target = (top / row[path]).resolve()
            if top not in target.parents or any(fnmatch(row[path], d) for d in deny):
                raise PermissionError(row[path])
            target.parent.mkdir(parents=True, exist_ok=True)
            data = row[content] if isinstance(row[content], bytes | bytearray) else row[content].encode()
            if backup and target.exists() and target.stat().st_size and target.read_bytes() != data:
                target.replace(target.with_name(target.name + ".bak"))
            target.write_bytes(data)

    df.select(path, content).foreachPartition(put)


def append_log(rows: DataFrame, folder: str) -> None:
    """Appends ts, action, path, summary rows to month folders, each line sanitised."""
    line = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), *[log_sanitize(F.col(c)) for c in ("action", "path", "summary")])
    rows.select(line.alias("value"), F.date_format("ts", "yyyy-MM").alias("month")).write.mode("append").partitionBy("month").text(folder)


def splice(text: Column, heading: str, content: Column) -> Column:
    """The section under an exact heading line replaced up to the next heading of its level or above; appended where there is none."""
    level = len(heading) - len(heading.lstrip("#"))
    quoted = "\\Q" + heading + "\\E"
    form = rf"(?ms)^{quoted}[ \t]*$.*?(?=^#{{1,{level}}}\s|\z)"
    new = F.concat(F.lit(heading + "\n\n"), content, F.lit("\n\n"))
    hit = text.rlike(form)
    before = F.regexp_extract(text, rf"(?ms)\A(.*?)^{quoted}[ \t]*$", 1)
    after = F.regexp_extract(text, rf"(?ms)^{quoted}[ \t]*$.*?((?:^#{{1,{level}}}\s.*)?)\z", 1)
    return F.when(hit, F.concat(before, new, after)).otherwise(F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit("\n\n"), new))


def strip_section(text: Column, heading: str) -> Column:
    level = len(heading) - len(heading.lstrip("#"))
    return F.regexp_replace(text, rf"(?ms)^\Q{heading}\E[ \t]*$.*?(?=^#{{1,{level}}}\s|\z)", "")


def registry_table(roles: DataFrame) -> DataFrame:
    """One row, ``content``: the registry as a markdown table, rows in order of role."""
    rows = roles.select("role", registry_rows(roles).alias("line")).agg(F.array_sort(F.collect_list(F.struct("role", "line"))).alias("rows"))
    return rows.select(F.concat(F.lit("| Role | Source | Notes |\n|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"))


def vocabulary_file(declared: DataFrame, machinery: DataFrame) -> DataFrame:
    """One row, ``content``: both vocabularies as a bullet list, each tag once, sorted."""
    tags = declared.select("tag").union(machinery.select("tag")).distinct().agg(F.sort_array(F.collect_list("tag")).alias("t"))
    return tags.select(F.concat(F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")).alias("content"))


def enumeration(parents: DataFrame, children: DataFrame) -> DataFrame:
    """One row, ``content``: each parent with its description and, indented, its children, in declared order (pos)."""
    line = lambda pad: F.concat(F.lit(pad + "- "), F.col("name"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), F.col("description"))).otherwise(""))
    kids = children.select("parent", F.struct("name", line("  ").alias("line")).alias("c")).groupBy("parent").agg(F.array_sort(F.collect_list("c")).alias("kids"))
    block = F.array_join(F.concat(F.array("line"), F.coalesce(F.transform("kids", lambda k: k["line"]), F.array().cast("array<string>"))), "\n")
    rows = parents.withColumn("line", line("")).join(kids, F.col("name") == F.col("parent"), "left").select(F.struct("pos", block.alias("block")).alias("b"))
    return rows.agg(F.array_sort(F.collect_list("b")).alias("all")).select(F.concat(F.array_join(F.transform("all", lambda b: b["block"]), "\n"), F.lit("\n")).alias("content"))


def manifest(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, ``content``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("content"))


def bridge_table(needs: DataFrame, contributes: Callable[[Column, Column], Column]) -> DataFrame:
    """One row, ``content``: which skill reads which role, as a markdown table. Every skill reads the vault first; ``needs``: skill, roles (in order, the vault among them or not)."""
    others = F.filter(F.coalesce("roles", F.array().cast("array<string>")), lambda r: (r != "vault") & (r != ""))
    rows = needs.select("skill", F.posexplode(F.concat(F.array(F.lit("vault")), others)).alias("pos", "role"))
    line = F.concat(F.lit("| `"), "skill", F.lit("` | `"), "role", F.lit("` | "), contributes(F.col("skill"), F.col("role")), F.lit(" | "), required_flag(F.col("role")), F.lit(" |"))
    all_ = rows.select(F.struct("skill", "pos", "role", line.alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return all_.select(F.concat(F.lit("| skill | role | contributes | required |\n| --- | --- | --- | --- |\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"))


def registry_document(registry: DataFrame, bridge: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row, ``content``: the whole sources document, put together from its two tables and the feeds (kind, target, pos)."""
    listed = feeds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "target").alias("line")))), lambda x: x["line"]), "\n").alias("feeds"))
    both = registry.withColumnRenamed("content", "roles").join(bridge.withColumnRenamed("content", "bridge"), F.lit(True)).join(listed, F.lit(True))
    return both.select(F.concat(F.lit("# Connected sources\n\n"), "roles", F.lit("\n## Who reads what\n\n"), "bridge", F.lit("\n# External Sources\n\n"), "feeds", F.lit("\n")).alias("content"))


def seed_notes(projects: DataFrame, children: DataFrame, areas: DataFrame) -> DataFrame:
    """path, content: a starting note for each project, subproject (``children``: parent, name, description) and area."""
    said = lambda: F.when(F.coalesce("description", F.lit("")) != "", F.concat("description", F.lit("\n\n"))).otherwise("")
    none = F.lit(None).cast("string")
    stamped = lambda body, kind: note_text(body, F.array().cast("array<string>"), none, none, F.lit(kind))
    name, parent = F.col("name"), F.col("parent")
    project = F.concat(F.lit("# "), name, F.lit("\n\n"), said(), F.lit("## Scope\n\nWhat belongs here, and what does not.\n\n## Current state\n\nNothing yet.\n\n## Open questions\n\n- \n"))
    child = F.concat(F.lit("# "), name, F.lit("\n\n"), said(), F.lit("Part of [["), parent, F.lit(" Overview]].\n\n## Current state\n\nNothing yet.\n"))
    area = F.concat(F.lit("# "), name, F.lit("\n\n"), said(), F.lit("## Standard\n\nWhat being kept up means.\n\n## Cadence\n\n- \n"))
    return (
        projects.select(F.concat(F.lit("Projects/"), name, F.lit("/"), name, F.lit(" Overview.md")).alias("path"), stamped(project, "project").alias("content"))
        .union(children.select(F.concat(F.lit("Projects/"), parent, F.lit("/"), name, F.lit("/"), name, F.lit(" Overview.md")), stamped(child, "project")))
        .union(areas.select(F.concat(F.lit("Areas/"), name, F.lit("/"), name, F.lit(".md")), stamped(area, "area")))
    )


def attachment_files(files: DataFrame, folder: str = "attachments") -> DataFrame:
    """path, content of attachments (file, data), to be written below a folder, the same content under the same name once.

    Six digits of a hash tell many thousand names apart, not all. Of other contents under one name, the one of the
    least hash lies at the name itself, each other in a folder named by its whole hash, so that none overwrites another.
    """
    own = files.select("file", F.md5("data").alias("md5"), "data").dropDuplicates(["file", "md5"])
    first = F.col("md5") == F.min("md5").over(Window.partitionBy("file"))
    return own.select(F.concat(F.lit(folder + "/"), F.when(first, "").otherwise(F.concat("md5", F.lit("/"))), "file").alias("path"), F.col("data").alias("content"))
