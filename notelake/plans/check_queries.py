"""Registered queries of the assertions and the engine's verbs, over frames with planted violations, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import checks, engine
from ..session import table as T
from ..sources import vault
from . import note_queries, views
from .registry import query


def _rows(*rows: tuple[str, str, int]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{st}', {n}::BIGINT)" for c, st, n in rows) + ') AS v("check", status, n_violations)'


_GOOD = """# Contract
Notes carry tagged_hash; machinery is in .system, search by vault=<vault-name>, the log is log-YYYY-MM.csv with timestamp|action|path|summary.
settings.local.json enforces permissions; SOURCES.md names the sources; the vault's name is the folder name.
## Projects
- `Alpha`
## Areas
Resources and Archive.
""" + "Words. " * 60
_BAD = "---\ntagged: x\n---\n# Projects\n# Projects\nnothing of it"
_MEMORY = "---\nupdated: 2024-01-01\n---\n## Current context\n## Working preferences\n## Extra\n## Projects\n## Areas\n## Achievements\n## Changelog\n" + "Words. " * 60
_MEMORY_BAD = "## Projects\n## Current context\n## Working preferences\n## Areas\n## Achievements\n## Changelog\n" + "Words. " * 60


def _documents(s, good: bool):
    rows = [("CLAUDE.md", _GOOD if good else _BAD), ("MEMORY.md", _MEMORY if good else _MEMORY_BAD), ("USER.md", "x" * (300 if good else 299)), ("SOURCES.md", "y" * 300), *([("PRIORITIES.md", "z" * 400)] if good else [])]
    return s.createDataFrame(rows, "name string, text string")


def _root_checks(docs):
    return checks.report([checks.root_documents(docs), checks.contract(docs), checks.enumerated(docs), checks.one_section_each(docs), checks.no_frontmatter(docs), checks.memory_order(docs), checks.memory_updated(docs), checks.names_vault(docs, "my-vault")])


_ROOT = ("root documents", "CLAUDE.md states its contract", "CLAUDE.md enumerates projects", "CLAUDE.md has each section once", "CLAUDE.md has no frontmatter", "MEMORY.md has its sections in order", "MEMORY.md says when it was updated", "CLAUDE.md names the vault")


@query(_rows(*[(c, "pass", 0) for c in _ROOT]))
def checks_root_good(s, d):
    return _root_checks(_documents(s, True))


# The bad contract lacks 8 of 9 literals (Projects is there) and all 5 concepts; its short length fails one document, USER.md is a byte short and one is absent.
@query(_rows(*[(c, "fail", n) for c, n in zip(_ROOT, (3, 13, 1, 2, 1, 1, 1, 1), strict=True)]))
def checks_root_bad(s, d):
    return _root_checks(_documents(s, False))


@query("WITH f AS (SELECT DISTINCT 'Resources/Plans/' || year(o_orderdate) AS p FROM orders) SELECT 'folders present' AS \"check\", 'fail' AS status, 14::BIGINT + 2 - (SELECT count(*) FROM (SELECT 1 FROM f WHERE p = 'Resources/Plans/1999')) * 2 - 3 AS n_violations")
def checks_folders(s, d):
    """Three of the fourteen folders are there, and both of a year that has orders."""
    years = T(s, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    plans = years.select(F.explode(F.array(*[F.concat(F.lit("Resources/Plans/"), "y", F.lit(f"/{x}")) for x in ("Daily", "Weekly")])).alias("path"))
    own = s.createDataFrame([("Projects",), ("Areas",), (".system/log",), ("Other",)], "path string")
    return checks.folders_present(plans.union(own), 1999)


@query(
    'SELECT \'registry roles are known\' AS "check", \'fail\' AS status, count(*) AS n_violations FROM nation UNION ALL SELECT \'contributes have arrows\', \'fail\', count(*) FROM nation '
    "UNION ALL SELECT 'cited roles are declared', 'fail', 2 UNION ALL SELECT 'cited skills are installed', 'fail', 1 UNION ALL SELECT 'the role table is in one of its places', 'pass', 0"
)
def checks_registry(s, d):
    """Every nation's registry has an unknown role, a row without an arrow, and cites two roles that no row declares."""
    docs = note_queries.registries(s, d)
    registry, bridge = vault.registry(docs), vault.who_reads_what(docs)
    known = s.createDataFrame([(r,) for r in checks.KNOWN_ROLES], "role string").withColumn("is_known", F.lit(True))
    unknown = checks.none_of(registry.join(known, "role", "left"), "registry roles are known", F.col("is_known").isNull())
    skills = s.createDataFrame([("daily-plan",)], "skill string")
    place = docs.select(F.lit(".system/sources.md").alias("path"), F.col("body").alias("text"))
    return checks.report([unknown, checks.arrows(bridge), checks.cited_roles(bridge, registry), checks.installed(bridge, skills), checks.registry_somewhere(place)])


@query(
    "SELECT 'frontmatter is well formed' AS \"check\", 'fail' AS status, count(*) FILTER (c_custkey % 15 = 0) AS n_violations FROM customer UNION ALL SELECT 'tagged hash equals body hash', 'fail', count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 2 = 1) FROM customer "
    "UNION ALL SELECT 'tagging ran', 'pass', 0 UNION ALL SELECT 'links resolve', 'warn', count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey + 1 > (SELECT max(c_custkey) FROM customer)) + 2 * count(*) FILTER (c_custkey % 4 <> 0) FROM customer UNION ALL SELECT 'no host path leaks', 'pass', 0"
)
def checks_notes(s, d):
    p = note_queries.parsed(s, d)
    from ..operators import graph

    titles = p.select(F.regexp_replace("name", r"\.md$", "").alias("title"))
    dangling = graph.unresolved(graph.wikilinks(p), titles).withColumn("v", F.lit(True))
    return checks.report(
        [
            checks.none_of(p, "frontmatter is well formed", F.col("text").startswith("---\n") & ~F.col("has_frontmatter")),
            checks.hashes_match(p),
            checks.tagging_ran(p),
            checks.none_of(dangling, "links resolve", F.col("v"), warn=True),
            checks.none_of(p, "no host path leaks", F.col("text").contains("/home/builder") | F.col("text").contains("/srv/vaults")),
        ]
    )


@query(
    "SELECT 'weekly plans have their form' AS \"check\", 'fail' AS status, count(*) FILTER (n_nationkey % 5 = 0) + count(*) FILTER (n_nationkey % 7 = 0) + count(*) FILTER (n_nationkey % 2 = 1) AS n_violations FROM nation UNION ALL SELECT 'daily notes have their form', 'fail', count(*) FILTER (n_nationkey % 3 = 0) + count(*) FILTER (n_nationkey % 4 = 0) * 2 FROM nation "
    "UNION ALL SELECT 'meeting notes have their form', 'fail', count(*) FILTER (n_nationkey % 6 = 0) + count(*) FILTER (n_nationkey % 2 = 0) FROM nation UNION ALL SELECT 'routines agree with themselves', 'fail', count(*) FILTER (n_nationkey % 4 IN (1, 2, 3)) FROM nation"
)
def checks_plans(s, d):
    k = F.col("n_nationkey")
    n = T(s, d, "nation")
    day = F.date_add(F.lit("2024-01-07").cast("date"), 7 * k.cast("int"))
    weekly_name = F.concat(dates.weekly_plan_name(day), F.when(k % 5 == 0, ".txt").otherwise(".md"))
    weekly = n.select(weekly_name.alias("name"), F.concat(F.when(k % 7 == 0, "Goals\n").otherwise("# Weekly Goals\n"), F.lit("- [ ] a "), F.when(k % 2 == 1, "P1").otherwise("`[P1]`")).alias("text"))
    daily = n.select(F.concat(day.cast("string"), F.when(k % 3 == 0, " x.md").otherwise(".md")).alias("name"), F.when(k % 4 == 0, "# Admin\n").otherwise("# Admin\n# Goals\n# Notes\n").alias("text"))
    meeting = n.select(F.concat(day.cast("string"), F.when(k % 6 == 0, ".md").otherwise(" Title.md")).alias("name"), F.concat(F.lit("---\ntitle: x\ndate: y\nattendees:\n"), F.when(k % 2 == 0, "").otherwise("source: z\n"), F.lit("---\n")).alias("text"))
    own = F.concat(F.lit("## Schedule\nTask ID: `"), F.when(k % 4 == 1, "other").otherwise(F.col("n_name")), F.lit("`\nCron: `0 6 * * *`\n"))
    docs = n.select(F.col("n_name").alias("stem"), F.when(k % 4 == 2, "no schedule").when(k % 4 == 3, "## Schedule\nCron: daily\n").otherwise(own).alias("text"))
    docs = docs.union(s.createDataFrame([("README", "words"), ("readme", "words")], "stem string, text string"))
    return checks.report([checks.weekly_plans(weekly), checks.daily_notes(daily), checks.meeting_notes(meeting), checks.routines(docs)])


@query(_rows(("the deny rule points here", "fail", 1), ("the deny rule points here", "pass", 0), (".system/.env has mode 600", "warn", 1), ("the sandbox is marked", "pass", 0), ("the manifest is not empty", "pass", 0)))
def checks_settings(s, d):
    setting = lambda v: s.createDataFrame([(f'{{"deny": ["Write({v}/Resources/Meetings/**)"]}}',)], "text string")
    files = s.createDataFrame([(".system/.env", "644"), (".sandbox-manifest.json", "644")], "path string, mode string")
    return checks.report([checks.deny_rule(setting("/srv/other"), "/srv/mine"), checks.deny_rule(setting("/srv/mine"), "/srv/mine"), checks.secret_mode(files), checks.marker(files), checks.some(T(s, d, "documents"), "the manifest is not empty")])


@query(_rows(("required sections", "pass", 0), ("a project", "pass", 0), ("template roles are known", "fail", 1), ("template roles are declared", "fail", 1)))
def checks_template(s, d):
    docs = note_queries.templates(s, d)
    sections = vault.template_sections(docs)
    roles = vault.template_roles(sections.where("h1 = 'Sources' AND level = 1").select("path", F.col("text").alias("body")))
    projects = vault.records(sections.where("h1 = 'Projects' AND level = 1").select("path", F.col("text").alias("body")))
    cited = s.createDataFrame([("email",), ("web",), ("calendar",)], "role string")
    return checks.template_valid(sections, projects, roles, cited)


# The engine's verbs.

@query("SELECT CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN 'done' ELSE 'pending' END AS state, count(*) AS n FROM customer GROUP BY 1")
def engine_status(s, d):
    return engine.status(engine.rebuild(note_queries.parsed(s, d)))


@query(
    "WITH p AS (SELECT c_custkey AS k, 'Projects/' || c_mktsegment || '/' || replace(c_name, '#', '') || '.md' AS path, c_custkey % 5 <> 0 AND c_custkey % 2 = 0 AS done FROM customer), c AS (SELECT path, true AS chosen FROM p WHERE NOT done ORDER BY path LIMIT 50) "
    "SELECT path, CASE WHEN done OR (chosen AND k % 3 <> 0) THEN 'done' ELSE 'pending' END AS state, CASE WHEN chosen AND k % 3 = 0 THEN 1 ELSE 0 END AS attempts FROM p LEFT JOIN c USING (path)"
)
def engine_run(s, d):
    """One pass over fifty pending notes; the tagger fails on every third customer's."""
    tagger = lambda rows: rows.where(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("int") % 3 != 0)
    return engine.run(engine.rebuild(note_queries.parsed(s, d)), tagger, 50).select("path", "state", "attempts")


@query("SELECT count(*) AS n FROM customer WHERE false")
def engine_init(s, d):
    return engine.init(s).agg(F.count("*").alias("n"))


@query("SELECT 'the manifest is not empty' AS \"check\", 'pass' AS status, 0::BIGINT AS n_violations UNION ALL SELECT 'tagged hash equals body hash', 'fail', count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 2 = 1) FROM customer UNION ALL SELECT 'log lines have four fields', 'fail', count(*) FILTER (event_id % 100 = 0) FROM events")
def engine_doctor(s, d):
    lines = views.log(s, d).select(F.concat_ws("|", "action", "path", F.lit("x"), F.when(F.col("event_id") % 100 != 0, F.lit("y"))).alias("value"))
    return engine.doctor(note_queries.parsed(s, d), lines)


@query("SELECT tag, count(*) AS n FROM (SELECT 'seg/' || lower(c_mktsegment) AS tag FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'extra' FROM customer WHERE c_custkey % 5 <> 0) GROUP BY tag")
def engine_vocab(s, d):
    return engine.vocab(note_queries.parsed(s, d))


@query("SELECT * FROM (VALUES ('a/b', 'b/a'), ('data-set', 'Data_Set'), ('kitchens', 'kitchen')) AS v(from_tag, to_tag)")
def engine_tag_lint(s, d):
    vocab = s.createDataFrame([("a/b", 3), ("b/a", 5), ("Data_Set", 9), ("data-set", 1), ("kitchen", 4), ("kitchens", 2), ("unlike", 7)], "tag string, n long")
    return engine.tag_lint(vocab, vocab.limit(0), False)
