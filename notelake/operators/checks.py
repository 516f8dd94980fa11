"""Data-quality assertions: each is one row of check, status and detail over a frame's violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body_hash


def none_of(df: DataFrame, check: str, violation: Column, warn: bool = False) -> DataFrame:
    """Passes if no row violates."""
    n = F.count_if(F.coalesce(violation, F.lit(True)))
    return df.agg(F.lit(check).alias("check"), F.when(n == 0, "pass").otherwise("warn" if warn else "fail").alias("status"), n.alias("n_violations"))


def some(df: DataFrame, check: str) -> DataFrame:
    n = F.count("*")
    return df.agg(F.lit(check).alias("check"), F.when(n > 0, "pass").otherwise("fail").alias("status"), F.when(n > 0, 0).otherwise(1).cast("long").alias("n_violations"))


def all_present(df: DataFrame, column: str, required: list[str], check: str) -> DataFrame:
    spark = df.sparkSession
    missing = spark.createDataFrame([(r,) for r in required], "need string").join(df.select(F.col(column).alias("need")).distinct(), "need", "left_anti")
    return missing.agg(F.lit(check).alias("check"), F.when(F.count("*") == 0, "pass").otherwise("fail").alias("status"), F.count("*").alias("n_violations"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def log_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    return none_of(lines, "log lines have four fields", F.size(F.split(column, "[|]")) != 4)


def hashes_match(notes: DataFrame) -> DataFrame:
    return none_of(notes.where("tagged_hash IS NOT NULL"), "tagged hash equals body hash", F.col("tagged_hash") != body_hash(F.col("body")))


def vault_report(spark: SparkSession, notes: DataFrame, log: DataFrame, registry: DataFrame, known_roles: list[str], dangling: DataFrame, host_literals: list[str]) -> DataFrame:
    """The assertions on a scanned vault that need no file system."""
    known = spark.createDataFrame([(r,) for r in known_roles], "role string")
    leak = reduce(lambda a, b: a | b, [F.col("text").contains(h) for h in host_literals], F.lit(False))
    return report(
        [
            some(notes, "the manifest is not empty"),
            none_of(notes, "frontmatter is well formed", F.col("text").startswith("---\n") & ~F.col("has_frontmatter")),
            hashes_match(notes),
            log_fields(log),
            some(registry, "the registry has rows"),
            none_of(registry.join(known.withColumn("is_known", F.lit(True)), "role", "left"), "roles are known", F.col("is_known").isNull()),
            none_of(notes, "no host path leaks", leak),
            none_of(dangling.withColumn("v", F.lit(True)), "links resolve", F.col("v"), warn=True),
        ]
    )


def tag_counts(notes: DataFrame) -> DataFrame:
    """n_tagged, n_untagged, n_drifted: notes with a tagged hash, without, and with one that is not their body's."""
    has = F.col("tagged_hash").isNotNull()
    return notes.agg(F.count_if(has).alias("n_tagged"), F.count_if(~has).alias("n_untagged"), F.count_if(has & (F.col("tagged_hash") != F.col("body_hash"))).alias("n_drifted"))


# What a vault of this form must have.
FOLDERS = ("Projects", "Areas", "Resources/Meetings", "Resources/Agendas", "Archive", "Clippings", "Skills", "Routines", "Templates", ".claude", ".obsidian", ".system/wiki", ".system/connectors", ".system/log")
ROOT_DOCUMENTS = ("CLAUDE.md", "USER.md", "SOURCES.md", "PRIORITIES.md", "MEMORY.md")
KNOWN_ROLES = ("vault", "meetings", "calendar", "chat", "email", "issues", "code", "second-vault", "memory", "web")
CONTRACT_LITERALS = ("tagged_hash", ".system", "vault=", "log-", "settings", "Projects", "Areas", "Resources", "Archive")
CONTRACT_CONCEPTS = {
    "sources-registry": r"(?i)SOURCES\.md", "permission-enforcement": r"(?i)settings.*\.json|permission", "log-YYYY-MM.csv": r"(?i)log-[Y0-9]{4}-[M0-9]{2}\.csv|log-YYYY-MM",
    "log-field-order": r"(?i)timestamp\|action\|path\|summary", "obsidian-cli-search-rule": r"(?i)vault=|vault-name|Obsidian CLI",
}
MEMORY_ORDER = ("Current context", "Working preferences", "Projects", "Areas", "Achievements", "Changelog")
TEMPLATE_SECTIONS = ("Projects", "Sources")
MEETING_KEYS = ("title", "date", "attendees", "source")


def _frame(df: DataFrame, check: str, bad: DataFrame, warn: bool = False) -> DataFrame:
    """The check's row from the violating rows themselves."""
    return bad.agg(F.lit(check).alias("check"), F.when(F.count("*") == 0, "pass").otherwise("warn" if warn else "fail").alias("status"), F.count("*").alias("n_violations"))


def folders_present(paths: DataFrame, year: int, required: tuple[str, ...] = FOLDERS) -> DataFrame:
    """``paths``: path of every folder there is."""
    return all_present(paths, "path", [*required, f"Resources/Plans/{year}/Daily", f"Resources/Plans/{year}/Weekly"], "folders present")


def root_documents(docs: DataFrame, least_bytes: int = 300, required: tuple[str, ...] = ROOT_DOCUMENTS) -> DataFrame:
    """``docs`` (name, text) hold each required document, of at least so many bytes: 300 once built, 800 for a live sandbox, 400 for an offline one."""
    long_enough = docs.where(F.octet_length("text") >= least_bytes)
    return all_present(long_enough, "name", list(required), "root documents")


def contract(docs: DataFrame, name: str = "CLAUDE.md", literals: tuple[str, ...] = CONTRACT_LITERALS, concepts: dict[str, str] | None = None) -> DataFrame:
    """A violation for each literal or concept that the document never mentions."""
    tests = [~F.col("text").contains(x) for x in literals] + [~F.col("text").rlike(p) for p in (CONTRACT_CONCEPTS if concepts is None else concepts).values()]
    missing = sum((t.cast("long") for t in tests), F.lit(0))
    n = F.coalesce(F.sum(missing), F.lit(len(tests)))
    return docs.where(F.col("name") == name).agg(F.lit(f"{name} states its contract").alias("check"), F.when(n == 0, "pass").otherwise("fail").alias("status"), n.cast("long").alias("n_violations"))


def enumerated(docs: DataFrame, name: str = "CLAUDE.md") -> DataFrame:
    """The document lists projects as code-quoted bullets."""
    return none_of(docs.where(F.col("name") == name), f"{name} enumerates projects", ~F.col("text").rlike(r"(?m)^\s*-\s*`"))


def one_section_each(docs: DataFrame, name: str = "CLAUDE.md", headings: tuple[str, ...] = ("Projects", "Areas")) -> DataFrame:
    """Exactly one heading of each name, of any level."""
    found = lambda h: F.size(F.regexp_extract_all("text", F.lit(rf"(?m)^#+ {h} *$"), F.lit(0)))
    wrong = sum(((found(h) != 1).cast("long") for h in headings), F.lit(0))
    n = F.coalesce(F.sum(wrong), F.lit(len(headings))).cast("long")
    return docs.where(F.col("name") == name).agg(F.lit(f"{name} has each section once").alias("check"), F.when(n == 0, "pass").otherwise("fail").alias("status"), n.alias("n_violations"))


def no_frontmatter(docs: DataFrame, name: str = "CLAUDE.md") -> DataFrame:
    return none_of(docs.where(F.col("name") == name), f"{name} has no frontmatter", F.col("text").rlike(r"\A---(\n|\z)"))


def arrows(bridge: DataFrame) -> DataFrame:
    """Every contributes cell says what is pulled and where it lands."""
    return none_of(bridge, "contributes have arrows", ~F.col("contributes").contains("→"))


def cited_roles(bridge: DataFrame, registry: DataFrame) -> DataFrame:
    """Every role that a skill cites has a row in the registry."""
    return _frame(bridge, "cited roles are declared", bridge.select("role").distinct().join(registry.select("role").distinct(), "role", "left_anti"))


def installed(bridge: DataFrame, skills: DataFrame) -> DataFrame:
    """Every skill of the table is installed."""
    return _frame(bridge, "cited skills are installed", bridge.select("skill").distinct().join(skills.select("skill").distinct(), "skill", "left_anti"))


def memory_order(docs: DataFrame, name: str = "MEMORY.md", order: tuple[str, ...] = MEMORY_ORDER) -> DataFrame:
    """The H2 sections stand in order, others between them allowed."""
    heads = F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^## (.*)$"), F.lit(1)), "|")
    return none_of(docs.where(F.col("name") == name), f"{name} has its sections in order", ~heads.rlike(".*".join(order)))


def memory_updated(docs: DataFrame, name: str = "MEMORY.md") -> DataFrame:
    return none_of(docs.where(F.col("name") == name), f"{name} says when it was updated", ~F.col("text").rlike(r"(?m)^updated:"))


def tagging_ran(notes: DataFrame) -> DataFrame:
    """Some note on disk carries a hash; only a warning, as the first pass may be left out."""
    n = F.count_if(F.col("tagged_hash").isNotNull())
    return notes.agg(F.lit("tagging ran").alias("check"), F.when(n > 0, "pass").otherwise("warn").alias("status"), F.when(n > 0, 0).otherwise(1).cast("long").alias("n_violations"))


def deny_rule(settings: DataFrame, vault: str, folder: str = "Resources/Meetings") -> DataFrame:
    """The settings (text) deny writes below this vault's own folder, not another's."""
    return none_of(settings, "the deny rule points here", ~F.col("text").contains(f"{vault}/{folder}"))


def routines(docs: DataFrame) -> DataFrame:
    """Routine documents (stem, text): a Schedule section, a cron line, and a task id, if any, that is the file's own stem. Read-me files are none."""
    task = F.regexp_extract("text", r"(?m)^.*Task ID:.*`([^`\n]*)`", 1)
    wrong = ~F.col("text").rlike(r"(?m)^## Schedule") | (F.col("text").contains("Task ID:") & (task != F.col("stem"))) | ~F.col("text").rlike(r"Cron: `[-0-9*/, ]+`")
    return none_of(docs.where(F.lower("stem") != "readme"), "routines agree with themselves", wrong)


def secret_mode(files: DataFrame, name: str = ".system/.env") -> DataFrame:
    """The file (path, mode in octal digits) is readable by its owner only; a warning otherwise."""
    return none_of(files.where(F.col("path") == name), f"{name} has mode 600", F.col("mode") != "600", warn=True)


def weekly_plans(docs: DataFrame) -> DataFrame:
    """Weekly plans (name, text): a violation for each of a drifted name, no goals section, no checkbox and no priority."""
    name = r"^Weekly Planning [0-9]{1,2}-[0-9]{1,2}-[0-9]{4} to [0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\.md$"
    wrong = [~F.col("name").rlike(name), ~F.col("text").rlike(r"(?m)^# Weekly Goals"), ~F.col("text").rlike(r"(?m)^- \[[ x]\]"), ~F.col("text").rlike(r"\[P[123]\]")]
    return _summed(docs, "weekly plans have their form", wrong)


def daily_notes(docs: DataFrame) -> DataFrame:
    wrong = [~F.col("name").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\.md$"), *[~F.col("text").contains(x) for x in ("# Admin", "# Goals", "# Notes")]]
    return _summed(docs, "daily notes have their form", wrong)


def meeting_notes(docs: DataFrame, keys: tuple[str, ...] = MEETING_KEYS) -> DataFrame:
    wrong = [~F.col("name").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} "), *[~F.col("text").rlike(rf"(?m)^{k}:") for k in keys]]
    return _summed(docs, "meeting notes have their form", wrong)


def _summed(docs: DataFrame, check: str, wrong: list[Column]) -> DataFrame:
    """A violation for each rule that a document breaks; none at all is one too."""
    n = F.coalesce(F.sum(sum((w.cast("long") for w in wrong), F.lit(0))), F.lit(1)).cast("long")
    return docs.agg(F.lit(check).alias("check"), F.when(n == 0, "pass").otherwise("fail").alias("status"), n.alias("n_violations"))


def registry_somewhere(docs: DataFrame, places: tuple[str, ...] = ("SOURCES.md", ".system/sources.md")) -> DataFrame:
    """The role table stands in one of the places; ``docs``: path, text."""
    has = docs.where(F.col("path").isin(*places) & F.col("text").rlike(r"(?im)^\| role \| source \| notes \|"))
    return some(has, "the role table is in one of its places")


def marker(paths: DataFrame, name: str = ".sandbox-manifest.json") -> DataFrame:
    return all_present(paths, "path", [name], "the sandbox is marked")


def names_vault(docs: DataFrame, vault: str, name: str = "CLAUDE.md") -> DataFrame:
    """The document names the vault's folder, or says that its name is the folder's."""
    return none_of(docs.where(F.col("name") == name), f"{name} names the vault", ~(F.col("text").contains(vault) | F.col("text").rlike("(?i)basename|folder name")))


def template_valid(sections: DataFrame, projects: DataFrame, roles: DataFrame, cited: DataFrame, known: tuple[str, ...] = KNOWN_ROLES, intrinsic: tuple[str, ...] = ("vault", "web", "memory"), required: tuple[str, ...] = TEMPLATE_SECTIONS) -> DataFrame:
    """A template's rows of checks: required H1 sections (``sections``: h1), a project, no unknown role, no role cited that is not declared."""
    spark = sections.sparkSession
    known_ = spark.createDataFrame([(r,) for r in known], "role string")
    free = spark.createDataFrame([(r,) for r in intrinsic], "role string")
    return report(
        [
            all_present(sections, "h1", list(required), "required sections"),
            some(projects, "a project"),
            _frame(roles, "template roles are known", roles.select("role").distinct().join(known_, "role", "left_anti")),
            _frame(cited, "template roles are declared", cited.select("role").distinct().join(roles.select("role").union(free).distinct(), "role", "left_anti")),
        ]
    )
