"""Registered queries over notes written as text: what parsers and writers make of it, against what it was made from.

The notes are put together from table columns; the SQL twins say from the same columns what must come out, and read no text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, dates, text
from ..operators import checks, graph, planning, reconcile, search, tags, udf
from ..session import spread
from ..session import table as T
from ..sources import enex, sinks, vault
from . import views
from .registry import query

_BODY = """# Goals

Intro {N}

- [ ] Call {N} today `[P1]`
- [x] Pay {K} `[P2]` (due today)
  - detail line

### Sub

1. First {K}
2. Second

#### Suggested

- [ ] Later {K}

# Notes

{L}
"""
_LINKS = "See [[Customer{M}|alias]] and ![[img-{K}#top]] and [[ghost-{G}]]."
_FRONT = """---
title: "{N}"
tags:
  - seg/{S}
  - extra
tagged: 2024-01-01
tagged_hash: {H}
type: project
empty:
score: {Q}
---
"""


def fill(template: str, **values: Column) -> Column:
    """A template's text with columns in its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[(values[p].cast("string") if k % 2 else F.lit(p)) for k, p in enumerate(parts) if p])


def notes(s: SparkSession, d: str) -> DataFrame:
    """k, path, name, text: a note per customer. One in five has no frontmatter, one in fifteen an unclosed one; one in four no links; every second hash is stale."""
    k = F.col("c_custkey")
    links = F.when(k % 4 == 0, "No links.").otherwise(fill(_LINKS, M=F.lpad((k + 1).cast("string"), 9, "0"), K=k, G=k % 7))
    called = F.replace("c_name", F.lit("#"), F.lit(""))
    body = fill(_BODY, N=called, K=k, L=links)
    front = fill(_FRONT, N=called, S=F.lower("c_mktsegment"), H=F.when(k % 2 == 0, F.substring(F.sha2(body, 256), 1, 16)).otherwise("stale"), Q=k % 100)
    whole = F.when(k % 15 == 0, F.concat(F.lit("---\ntitle: x\n"), body)).when(k % 5 == 0, body).otherwise(F.concat(front, body))
    name = F.concat(called, F.lit(".md"))
    rows = spread(T(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return rows.select(k.alias("k"), F.concat(F.lit("Projects/"), "c_mktsegment", F.lit("/"), name).alias("path"), name.alias("name"), whole.alias("text"))


def parsed(s: SparkSession, d: str) -> DataFrame:
    return vault.parse_notes(notes(s, d))


_N = "n AS (SELECT c_custkey AS k, replace(c_name, '#', '') AS c_name, c_mktsegment AS seg, 'Projects/' || c_mktsegment || '/' || replace(c_name, '#', '') || '.md' AS path, c_custkey % 5 <> 0 AS front FROM customer)"


@query(f"WITH {_N} SELECT k, front AS has_frontmatter, CASE WHEN front THEN 'seg/' || lower(seg) || '|extra' ELSE '' END AS tags, CASE WHEN front THEN 'project' END AS type, CASE WHEN front THEN c_name END AS title, CASE WHEN front THEN k % 2 = 0 END AS fresh, NOT front AND k % 15 = 0 AS starts_with_rule FROM n")
def note_parse(s, d):
    title = F.try_element_at(F.try_element_at("frontmatter", F.lit("title")), F.lit(1))
    return parsed(s, d).select("k", "has_frontmatter", F.array_join("tags", "|").alias("tags"), "type", title.alias("title"), (F.col("tagged_hash") == F.col("body_hash")).alias("fresh"), F.col("body").startswith("---").alias("starts_with_rule"))


@query(f"WITH {_N} SELECT k, 4 AS pos, 'Goals' AS section, NULL AS subsection, false AS checked, 'Call ' || c_name || ' today `[P1]`' AS text, 'P1' AS priority, false AS due_today FROM n UNION ALL SELECT k, 5, 'Goals', NULL, true, 'Pay ' || k || ' `[P2]` (due today)', 'P2', true FROM n UNION ALL SELECT k, 15, 'Goals', 'Suggested', false, 'Later ' || k, NULL, false FROM n")
def note_items(s, d):
    return vault.items(parsed(s, d).withColumn("body", F.regexp_replace("body", r"\A---\ntitle: x\n", "")), "k")


@query(f"WITH {_N} SELECT k, 'Call ' || c_name || ' today `[P1]`' AS text FROM n")
def note_items_curated(s, d):
    """Unchecked items without those staged as suggestions."""
    return planning.curated_open(vault.items(parsed(s, d), "k")).select("k", "text")


@query(
    f"WITH {_N} SELECT k, 1::BIGINT AS ordinal, 1 AS level, 'Goals' AS title, 'Goals' AS h1, NULL AS h3 FROM n UNION ALL SELECT k, 2, 3, 'Sub', 'Goals', 'Sub' FROM n UNION ALL SELECT k, 3, 4, 'Suggested', 'Goals', 'Sub' FROM n UNION ALL SELECT k, 4, 1, 'Notes', 'Notes', NULL FROM n UNION ALL SELECT k, 0, 0, NULL, NULL, NULL FROM n WHERE k % 15 = 0"
)
def note_sections(s, d):
    return vault.sections(parsed(s, d), "k").select("k", "ordinal", "level", "title", "h1", "h3")


@query(f"WITH {_N} SELECT k, chr(10) || '1. First ' || k || chr(10) || '2. Second' || chr(10) AS text FROM n")
def note_section_text(s, d):
    return vault.sections(parsed(s, d), "k").where("title = 'Sub'").select("k", "text")


@query(f"WITH {_N} SELECT k, 1 AS ordinal, 'First ' || k AS item FROM n UNION ALL SELECT k, 2, 'Second' FROM n")
def note_numbered(s, d):
    return vault.numbered(parsed(s, d), "k")


_EDGES = f"{_N}, e AS (SELECT path, 'Customer' || lpad((k + 1)::VARCHAR, 9, '0') AS target, false AS is_embed FROM n WHERE k % 4 <> 0 UNION ALL SELECT path, 'img-' || k, true FROM n WHERE k % 4 <> 0 UNION ALL SELECT path, 'ghost-' || (k % 7), false FROM n WHERE k % 4 <> 0)"


@query(f"WITH {_EDGES} SELECT path, target, is_embed FROM e")
def wikilinks(s, d):
    return graph.wikilinks(parsed(s, d))


@query(f"WITH {_EDGES} SELECT path, target FROM e WHERE target NOT IN (SELECT c_name FROM n) AND target <> 'ghost-3'")
def wikilinks_unresolved(s, d):
    p = parsed(s, d)
    titles = p.select(F.regexp_replace("name", r"\.md$", "").alias("title"))
    return graph.unresolved(graph.wikilinks(p), titles, ("ghost-3",)).select("path", "target")


@query(f"WITH {_N} SELECT path AS node FROM n WHERE k % 4 = 0")
def wikilinks_deadends(s, d):
    p = parsed(s, d)
    return graph.deadends(p.select(F.col("path").alias("node")), graph.wikilinks(p).withColumnRenamed("path", "src"))


@query(f"WITH {_N} SELECT path FROM n WHERE NOT front OR k % 2 = 1")
def notes_needing_tags(s, d):
    return reconcile.needs_tagging(parsed(s, d), F.col("body_hash")).select("path")


@query(f"WITH {_N} SELECT count(*) FILTER (front) AS n_tagged, count(*) FILTER (NOT front) AS n_untagged, count(*) FILTER (front AND k % 2 = 1) AS n_drifted FROM n")
def notes_tag_counts(s, d):
    return checks.tag_counts(parsed(s, d))


@query(f"WITH {_N} SELECT seg AS folder, count(*) AS n_notes, count(*) FILTER (front) AS n_tagged FROM n GROUP BY seg")
def notes_manifest(s, d):
    """The manifest built anew from what the notes themselves say."""
    rebuilt = vault.rebuild_manifest(parsed(s, d))
    return rebuilt.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("folder")).agg(F.count("*").alias("n_notes"), F.count("tagged_hash").alias("n_tagged"))


@query(f"WITH {_N} SELECT count(*) AS n_notes, '7' AS schema_version FROM n")
def manifest_state(s, d):
    meta = s.createDataFrame([("schema_version", "7"), ("built", "x")], "key string, value string")
    return vault.manifest_state(vault.rebuild_manifest(parsed(s, d)), meta)


def _search(name: str, q: str, where: str, **more) -> None:
    query(f"WITH {_N} SELECT path FROM n WHERE {where}", name)(lambda s, d: search.search(parsed(s, d), q, **more).select("path"))


_search("search_file", 'file:"00012"', "contains(c_name, '00012')")
_search("search_content", 'content:"pay 12"', "starts_with(k::VARCHAR, '12')")
_search("search_block", '(block:(call "pay 12") OR block:(intro pay))', "starts_with(k::VARCHAR, '12')")
_search("search_section", 'section:("first 12" second) -section:(first later)', "starts_with(k::VARCHAR, '12')")
_search("search_task", 'task:"later 13" task:"pay 13"', "starts_with(k::VARCHAR, '13')")
_search("search_task_todo", 'task-todo:"later 1" -task-todo:pay', "starts_with(k::VARCHAR, '1')")
_search("search_task_done", 'task-done:"pay 1" -task-done:"pay 12"', "starts_with(k::VARCHAR, '1') AND NOT starts_with(k::VARCHAR, '12')")
_search("search_property_exists", "[tagged_hash]", "front")
_search("search_property_null", "[empty:null] -[title:null]", "front")
_search("search_property_below", "[score:<30] [score:>9]", "front AND k % 100 BETWEEN 10 AND 29")
_search("search_ignore_case", 'ignore-case:"INTRO customer00000001"', "starts_with(c_name, 'Customer00000001')")
_search("search_excluding", "intro", "seg NOT IN ('BUILDING', 'FURNITURE')", exclude=("Projects/BUILDING", "Projects/FURNITURE"))


@query(f"WITH {_N} SELECT CASE WHEN seg = 'BUILDING' THEN 'Projects/BUILDING' ELSE 'Projects/FURN' END AS prefix, count(*) AS n_excluded FROM n WHERE seg IN ('BUILDING', 'FURNITURE') GROUP BY 1")
def search_excluded_report(s, d):
    return search.excluded(parsed(s, d), "intro", ("Projects/BUILDING", "Projects/FURN"))


@query(f"WITH {_N} SELECT path FROM n WHERE seg = 'BUILDING' AND k % 2 = 0")
def search_by_code(s, d):
    return search.by_code(parsed(s, d), "path LIKE 'Projects/BUILDING/%' AND k % 2 = 0").select("path")


@query(f"WITH {_N} SELECT path, 'topic/intro' AS tag FROM n UNION ALL SELECT path, 'call' FROM n UNION ALL SELECT path, 'kind/alias' FROM n WHERE k % 4 <> 0")
def tagger_keywords(s, d):
    vocab = s.createDataFrame([("topic/intro",), ("call",), ("kind/alias",), ("kind/unheard",)], "tag string")
    return udf.keyword_tagger(parsed(s, d).withColumn("body", F.regexp_replace("body", "today", "")), vocab)


@query(f"WITH {_N} SELECT k, CASE WHEN k % 3 = 0 THEN 'stub of ' || c_name ELSE upper(c_name) END AS reply FROM n")
def model_calls(s, d):
    """A model as a scalar function: every third call fails and gets the stub's text."""
    rows = T(s, d, "customer").select(F.col("c_custkey").alias("k"), F.replace("c_name", F.lit("#"), F.lit("")).alias("prompt"))
    return udf.model_column(rows, "prompt", lambda t: None if int(t[8:]) % 3 == 0 else t.upper(), stub=lambda t: "stub of " + t).select("k", "reply")


def _cached(s, d):
    rows = T(s, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("p"), F.col("c_custkey") % 40).alias("prompt"))
    memo = rows.where("k % 40 < 20").select(F.sha2(F.concat(F.lit("m\n"), "prompt"), 256).alias("key"), F.concat(F.lit("old "), "prompt").alias("reply")).distinct()
    return udf.cached_model(rows, memo, "prompt", "m", lambda t: "new " + t)


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 40 < 20 THEN 'old p' ELSE 'new p' END || (c_custkey % 40) AS reply FROM customer")
def model_memo(s, d):
    return _cached(s, d)[0].select("k", "reply")


@query("SELECT DISTINCT sha256('m' || chr(10) || 'p' || (c_custkey % 40)) AS key, 'new p' || (c_custkey % 40) AS reply FROM customer WHERE c_custkey % 40 >= 20")
def model_memo_misses(s, d):
    """What the memo lacked, each once, to be stored."""
    return _cached(s, d)[1]


@query("SELECT role, lands, count(*) AS n FROM (SELECT 'chat' AS role, 'Communication' AS lands FROM conversations UNION ALL SELECT 'email', 'Communication' FROM events WHERE event_type = 'signup' UNION ALL SELECT 'issues', 'Pool' FROM orders) GROUP BY ALL")
def roles_by_arrow(s, d):
    """Connected roles' frames land where their arrows point; a role that nobody connected is left out."""
    r = udf.Roles()
    r.register("chat", lambda: T(s, d, "conversations").select(F.col("conv_id").alias("id")), "Communication")
    r.register("email", lambda: T(s, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id")), "Communication")
    r.register("issues", lambda: T(s, d, "orders").select(F.col("o_orderkey").alias("id")), "Pool")
    landed = r.pull(["chat", "email", "issues", "code"])
    out = [df.groupBy("role").agg(F.count("*").alias("n")).withColumn("lands", F.lit(place)) for place, df in landed.items()]
    return out[0].unionByName(out[1])


@query("SELECT doc_id, CASE WHEN contains(text, '@') THEN 'seen' ELSE 'clean' END AS state FROM documents WHERE doc_id % 3 <> 0")
def redact_screened(s, d):
    """Rows that the second screen has not passed, unscreened ones included, are dropped."""
    docs = T(s, d, "documents").withColumn("ok", F.when(F.col("doc_id") % 3 == 1, True).when(F.col("doc_id") % 3 == 2, True))
    out = udf.redact(docs.select("doc_id", "ok", F.when(F.contains("text", F.lit("@")), "a@b.org").otherwise("clean").alias("text")), "text", {"mail": r"[^ ]+@[^ ]+"}, F.col("ok"))
    return out.select("doc_id", F.when(F.col("text") == "[mail]", "seen").otherwise(F.col("text")).alias("state"))


# Templates and registries.

_REGISTRY = """Words before.

| role | source | notes |
| --- | --- | --- |
| chat-{K} | tool{R} | a \\| b |
| `email` | none |  |

| skill | role | contributes | required |
| --- | --- | --- | --- |
| `daily-plan` | `chat` | messages {K} → `# Place {R}` | optional |
| `log-manager` | `vault` | lines | always |
"""


def registries(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "nation").select(F.col("n_name").alias("path"), fill(_REGISTRY, K=F.col("n_nationkey"), R=F.col("n_regionkey")).alias("body"))


@query("SELECT 'chat-' || n_nationkey AS role, 'tool' || n_regionkey AS source, 'a | b' AS notes FROM nation UNION SELECT 'email', 'none', ''")
def registry_scan(s, d):
    return vault.registry(registries(s, d))


@query("SELECT skill, role, contributes, required FROM (SELECT 'daily-plan' AS skill, 'chat' AS role, 'messages ' || n_nationkey || ' → `# Place ' || n_regionkey || '`' AS contributes, 'optional' AS required FROM nation UNION ALL SELECT 'log-manager', 'vault', 'lines', 'always' FROM nation)")
def who_reads_what(s, d):
    return vault.who_reads_what(registries(s, d))


@query("SELECT 'messages ' || n_nationkey AS pull, '`# Place ' || n_regionkey || '`' AS land, 'optional' AS required FROM nation UNION ALL SELECT 'lines', NULL, 'always' FROM nation")
def contributes_split(s, d):
    pull, land = text.contributes(F.col("contributes"))
    return vault.who_reads_what(registries(s, d)).select(pull.alias("pull"), land.alias("land"), text.required_flag(F.col("role")).alias("required"))


_TEMPLATE = """# Projects
<!-- none of
- Hidden | x | y
-->
- `P{K}` | work | about {K}
  - Sub{K} | part | inner
  - Key: value {K}
  - key: other
-  | nothing | here
- Alone

# Sources
- E-mail (gmail, outlook): tool{R} | first | second
- Slack
- This vault:
- Custom Thing: x

# External Sources
- https://feed.example/{K}
- none
- Web Search:
  - topic {K}
  - none

### Deep
deep {K}

## Two
two

# Empty
"""


def templates(s: SparkSession, d: str) -> DataFrame:
    own = fill(_TEMPLATE, K=F.col("n_nationkey"), R=F.col("n_regionkey"))
    return T(s, d, "nation").select(F.col("n_nationkey").alias("path"), own.alias("text"), text.strip_comments(own).alias("body"))


def _section(s, d, h1: str) -> DataFrame:
    return vault.template_sections(templates(s, d)).where((F.col("h1") == h1) & (F.col("level") == 1)).select("path", F.col("text").alias("body"))


@query("SELECT n_nationkey AS path, t.* FROM nation, (VALUES (1::BIGINT, 'Projects', 'Projects', NULL), (2, 'Sources', 'Sources', NULL), (3, 'External Sources', 'External Sources', NULL), (4, 'Deep', 'External Sources', 'Deep'), (5, 'Two', 'External Sources', NULL), (6, 'Empty', 'Empty', NULL)) AS t(ordinal, title, h1, h3)")
def template_sections(s, d):
    return vault.template_sections(templates(s, d)).select("path", "ordinal", "title", "h1", "h3")


@query("SELECT n_nationkey AS path, t.* FROM nation, (VALUES ('Projects', true), ('Empty', false), ('Absent', false)) AS t(section, filled)")
def template_section_filled(s, d):
    wanted = s.createDataFrame([("Projects",), ("Empty",), ("Absent",)], "section string")
    return vault.section_filled(vault.template_sections(templates(s, d)), wanted)


@query("SELECT n_nationkey AS path, 'P' || n_nationkey AS name, 'work' AS kind, 'about ' || n_nationkey AS description FROM nation UNION ALL SELECT n_nationkey, 'Alone', '', '' FROM nation")
def template_records(s, d):
    return vault.records(_section(s, d, "Projects")).select("path", "name", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("description", F.lit("")).alias("description"))


@query("SELECT n_nationkey AS path, 'P' || n_nationkey AS parent, 'Sub' || n_nationkey AS name, 'part' AS kind, 'inner' AS description FROM nation")
def template_children(s, d):
    return vault.children(_section(s, d, "Projects")).where("name NOT LIKE 'key:%'")


@query("SELECT n_nationkey AS path, 'P' || n_nationkey AS project FROM nation UNION ALL SELECT n_nationkey, 'P' || n_nationkey || '/Sub' || n_nationkey FROM nation UNION ALL SELECT n_nationkey, 'Alone' FROM nation")
def template_project_paths(s, d):
    return vault.project_paths(_section(s, d, "Projects")).where("project NOT LIKE '%key:%'")


@query("SELECT DISTINCT split_part(split_part(path, '/', 2), '/', 1) AS area FROM (SELECT 'Areas/' || c_mktsegment || '/' || c_name || '.md' AS path FROM customer)")
def area_list(s, d):
    return vault.area_list(T(s, d, "customer").select(F.concat(F.lit("Areas/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".md")).alias("path")))


@query("SELECT n_nationkey AS path, 'value ' || n_nationkey AS value FROM nation")
def template_attribute(s, d):
    pairs = F.transform(F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^\s+- [A-Za-z]+:")), lambda x: F.regexp_replace(x, r"^\s+- ", ""))
    return _section(s, d, "Projects").select("path", arrays.attribute(pairs, "KEY").alias("value"))


@query("SELECT n_nationkey AS path, 'email' AS role, 'tool' || n_regionkey AS source, 'first | second' AS notes FROM nation UNION ALL SELECT n_nationkey, 'vault', 'none', '' FROM nation UNION ALL SELECT n_nationkey, 'custom thing', 'x', '' FROM nation")
def template_roles(s, d):
    return vault.template_roles(_section(s, d, "Sources"))


@query("SELECT n_nationkey AS path, 'fetch' AS kind, 'https://feed.example/' || n_nationkey AS target FROM nation UNION ALL SELECT n_nationkey, 'query', 'topic ' || n_nationkey FROM nation")
def external_feeds(s, d):
    return vault.feeds(_section(s, d, "External Sources"))


@query("SELECT n_nationkey AS path, 'Words ' || n_nationkey || '.' || chr(10) || chr(10) || 'More.' AS prose FROM nation")
def prose_only(s, d):
    own = fill("\n\nWords {K}.\n- item\n  * nested\n3. third\n\n\n\nMore.\n\n", K=F.col("n_nationkey"))
    return T(s, d, "nation").select(F.col("n_nationkey").alias("path"), vault.prose(own).alias("prose"))


# Names that people use, and what they stand for.

_NAMES = [(n, r) for r, names in text.ROLE_ALIASES.items() for n in names] + [("E-mail", "email"), ("Slack", "chat"), ("PM", "issues"), ("Git", "code"), ("news", "web"), ("This vault", "vault"), ("Project management (linear, notion, monday.com)", "issues"), (" Second Knowledge Base (team) ", "second-vault"), ("Other", "other")]


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


@query(f"SELECT * FROM (VALUES {_values(_NAMES)}) AS v(name, role)")
def role_aliases(s, d):
    return s.createDataFrame([(n,) for n, _ in _NAMES], "name string").select("name", text.role_alias(F.col("name")).alias("role"))


_SKILLS = [("weekly-plan", "weekly-planning", "weekly-plan"), ("weekly-planning", "weekly-planning", "weekly-planning"), ("daily-planning", "daily-plan", "daily-planning"), ("meeting-preparation", "meeting-prep", "meeting-preparation"), ("weekly-plan-update", "weekly-plan-update", "weekly-plan-daily-update"), ("weekly-memory", "weekly-memory", "memory"), ("memory", "memory", "memory"), ("own", "own", "own")]


@query(f"SELECT * FROM (VALUES {_values(_SKILLS)}) AS v(name, skill, routine)")
def skill_aliases(s, d):
    return s.createDataFrame([(n,) for n, *_ in _SKILLS], "name string").select("name", text.skill_alias(F.col("name")).alias("skill"), text.routine_alias(F.col("name")).alias("routine"))


_VARIANTS = [(c, v) for c, vs in {"weekly-planning": ["weekly-planning", "weekly-plan"], "daily-plan": ["daily-plan", "daily-planning"], "meeting-prep": ["meeting-prep", "meeting-preparation"], "weekly-plan-daily-update": ["weekly-plan-daily-update", "weekly-plan-update"], "memory": ["memory", "weekly-memory"], "own": ["own"]}.items() for v in vs]


@query(f"SELECT * FROM (VALUES {_values(_VARIANTS)}) AS v(name, variant)")
def alias_variants(s, d):
    return s.createDataFrame([(c, text.alias_variants(c)) for c in dict.fromkeys(c for c, _ in _VARIANTS)], "name string, variants array<string>").select("name", F.explode("variants").alias("variant"))


_CRON = [
    ("daily", "0 6 * * *", "daily at 6:00 AM"), ("0 7 * * 1", "0 7 * * 1", "Mondays at 7:00 AM"), ("*/15 8-18 * * 1-5", "*/15 8-18 * * 1-5", "weekdays at 8:00 AM"), ("mon-fri at 9am", "0 9 * * 1-5", "weekdays at 9:00 AM"),
    ("weekdays at 4:30pm", "30 16 * * 1-5", "weekdays at 4:30 PM"), ("Sunday at 5pm", "0 17 * * 0", "Sundays at 5:00 PM"), ("every monday 12 am", "0 0 * * 1", "Mondays at 12:00 AM"), ("Fridays at 12pm", "0 12 * * 5", "Fridays at 12:00 PM"),
    ("saturday 7:05 am", "5 7 * * 6", "Saturdays at 7:05 AM"), ("monthly at 9am", "0 9 * * *", "daily at 9:00 AM"), ("weekly", "0 6 * * 0", "Sundays at 6:00 AM"), ("every day at 11:59pm", "59 23 * * *", "daily at 11:59 PM"),
    ("tuesday at 8am", "0 8 * * *", "daily at 8:00 AM"), ("whenever", "0 6 * * *", "daily at 6:00 AM"), ("Weekdays", "0 6 * * 1-5", "weekdays at 6:00 AM"), ("at 10 pm on sun", "0 22 * * 0", "Sundays at 10:00 PM"),
]


@query(f"SELECT * FROM (VALUES {_values(_CRON)}) AS v(frequency, cron, said)")
def cron(s, d):
    own = dates.cron_of(F.col("frequency"), strict_reference=True)
    return s.createDataFrame([(f,) for f, *_ in _CRON], "frequency string").select("frequency", own.alias("cron"), dates.cron_human(own).alias("said"))


@query("SELECT s_suppkey, (s_suppkey % 12 + 1) || ':' || lpad((s_suppkey % 60)::VARCHAR, 2, '0') || CASE WHEN s_suppkey % 2 = 0 THEN 'am' ELSE 'pm' END AS clock, (s_suppkey % 60) || ' ' || CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 12 + 1) % 12 ELSE (s_suppkey % 12 + 1) % 12 + 12 END || ' * * ' || CASE s_suppkey % 3 WHEN 0 THEN '1-5' WHEN 1 THEN '*' ELSE '5' END AS cron, CASE s_suppkey % 3 WHEN 0 THEN 'weekdays' WHEN 1 THEN 'daily' ELSE 'Fridays' END || ' at ' || (s_suppkey % 12 + 1) || ':' || lpad((s_suppkey % 60)::VARCHAR, 2, '0') || CASE WHEN s_suppkey % 2 = 0 THEN ' AM' ELSE ' PM' END AS schedule FROM supplier")
def cron_human(s, d):
    k = F.col("s_suppkey")
    clock = F.concat((k % 12 + 1).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 2 == 0, "am").otherwise("pm"))
    said = dates.cron_of(F.concat(F.when(k % 3 == 0, "every weekday").when(k % 3 == 1, "daily").otherwise("on Friday"), F.lit(" "), clock))
    return T(s, d, "supplier").select("s_suppkey", clock.alias("clock"), said.alias("cron"), dates.cron_human(said).alias("schedule"))


# Functions on strings and dates.

@query("SELECT p_partkey, p_name AS second, p_brand AS third, '\"' || replace(p_name || '\"', '\"', '\\\"') || '\"' AS yaml, 'a\\|b' AS piped, p_name AS titled FROM part")
def text_fields(s, d):
    rec = F.concat(F.lit("x |  "), "p_name", F.lit(" |\t"), "p_brand", F.lit(" "))
    return T(s, d, "part").select(
        "p_partkey", text.field(rec, 2).alias("second"), text.field(rec, 3).alias("third"), text.yaml_escape(F.concat("p_name", F.lit('"'))).alias("yaml"), text.escape_pipe(F.lit("a|b")).alias("piped"),
        text.clean_title(F.concat(F.lit("12. \""), "p_name", F.lit("\" "))).alias("titled"),
    )


@query("SELECT p_partkey, replace(p_name, ' ', '-') || '-' || p_partkey AS title, p_name || chr(10) || 'b' AS fenced, p_name || 'cd' AS bare FROM part")
def text_strips(s, d):
    return T(s, d, "part").select(
        "p_partkey",
        text.safe_title(F.concat(F.lit(" -"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("#"), F.col("p_partkey").cast("string"), F.lit(" .-"))).alias("title"),
        text.strip_fence(F.concat(F.lit("\n```md\n"), "p_name", F.lit("\nb\n```\n"))).alias("fenced"),
        text.strip_comments(F.concat("p_name", F.lit("<!-- x\ny -->c<!-- z -->d<!-- open"))).alias("bare"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', b' END AS tags, CASE WHEN p_partkey % 3 = 2 THEN 'only body' ELSE p_name || chr(10) || 'end' END || chr(10) AS body FROM part")
def reply_split(s, d):
    k = F.col("p_partkey") % 3
    reply = F.when(k == 0, F.concat(F.lit("TAGS: "), "p_name", F.lit(", b\n---BODY---\n"), "p_name", F.lit("\nend\n\n"))).when(k == 1, F.concat(F.lit("TAGS: x\n"), "p_name", F.lit("\nend"))).otherwise("only body")
    tagged, body = text.split_tagged_reply(reply)
    return T(s, d, "part").select("p_partkey", tagged.alias("tags"), body.alias("body"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'macos' WHEN 1 THEN 'windows' WHEN 2 THEN NULL ELSE 'linux' END AS platform, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE NULL END AS picked FROM part")
def folded_and_first_set(s, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, " Mac OS ").when(k % 4 == 1, "WINDOWS").when(k % 4 == 2, "amiga").otherwise("GNU/Linux")
    names = {"macos": ("mac", "mac os", "macos", "osx"), "windows": ("windows", "win"), "linux": ("linux", "gnu/linux")}
    first = text.first_set(F.when(k % 3 == 0, F.col("p_name")).otherwise(" "), F.when(k % 3 == 1, F.col("p_brand")).otherwise("windows vs macos"), unset="windows vs macos")
    return T(s, d, "part").select("p_partkey", text.fold_case(raw, names).alias("platform"), first.alias("picked"))


_MODES = [("CANON", "canon"), ("canonical", "canon"), (" Strict ", "canon"), ("frequency", "frequency"), ("Freq", "frequency"), ("auto", "auto"), ("", "auto"), (None, "auto"), ("odd", None)]


@query(f"SELECT * FROM (VALUES {_values(_MODES)}) AS v(raw, mode)")
def tag_modes(s, d):
    return s.createDataFrame([(r,) for r, _ in _MODES], "raw string").select("raw", tags.mode_of(F.col("raw")).alias("mode"))


@query("SELECT p_partkey, 'k' || p_partkey AS term, p_name || ' = x' AS expansion FROM part")
def shorthand_split(s, d):
    term, expansion = text.shorthand(F.concat(F.lit(" k"), F.col("p_partkey").cast("string"), F.lit("  = "), "p_name", F.lit(" = x")))
    return T(s, d, "part").select("p_partkey", term.alias("term"), expansion.alias("expansion"))


@query("SELECT p_partkey, substr(sha256(p_name), 1, 16) AS id16, substr(sha256(p_name), 1, 32) AS id32 FROM part")
def string_ids(s, d):
    return T(s, d, "part").select("p_partkey", F.substring(F.sha2("p_name", 256), 1, 16).alias("id16"), F.substring(F.sha2("p_name", 256), 1, 32).alias("id32"))


@query("WITH o AS (SELECT DISTINCT o_orderdate::DATE AS day, o_orderdate::DATE - dayofweek(o_orderdate)::INT AS ws FROM orders) SELECT day, ws AS start, CASE WHEN dayofweek(day) = 3 THEN NULL ELSE ws END AS parsed, day AS noted FROM o")
def plan_names(s, d):
    o = T(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    name = dates.weekly_plan_name(F.col("day"))
    drifted = F.when(F.dayofweek("day") == 4, F.replace(name, F.lit(" to "), F.lit(" - "))).otherwise(F.concat(name, F.lit(".md")))
    return o.select("day", dates.weekly_plan_start(name).alias("start"), dates.weekly_plan_start(drifted).alias("parsed"), dates.daily_note_day(F.concat(F.col("day").cast("string"), F.lit(" Title.md"))).alias("noted"))


@query("WITH o AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, array_to_string((list_reverse(list_sort(list_filter([day - i::INT FOR i IN range(0, 12)], lambda x: dayofweek(x) NOT IN (0, 6)))))[1:5], ',') AS days, (day - dayofweek(day)::INT) - 14 AS third FROM o")
def business_days(s, d):
    o = T(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    third = F.to_date(F.element_at(dates.weeks_back(F.col("day"), 3), 3), "M-d-yyyy")
    return o.select("day", F.array_join(dates.business_days_back(F.col("day"), 5).cast("array<string>"), ",").alias("days"), third.alias("third"))


@query("WITH o AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) SELECT day, day + 3 AS literal, day AS eod, day + (7 - (dayofweek(day) + 2) % 7)::INT AS friday, epoch(day::TIMESTAMP)::BIGINT AS unix FROM o")
def due_days(s, d):
    o, day = T(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), F.col("day")
    literal = F.concat(F.lit("Pay by "), F.date_add(day, 3).cast("string"), F.lit(" or by monday"))
    return o.select("day", dates.due_day(literal, day).alias("literal"), dates.due_day(F.lit("Ship it EOD"), day).alias("eod"), dates.due_day(F.lit("Send by Friday"), day).alias("friday"), F.unix_timestamp(day.cast("timestamp")).alias("unix"))


# Writers.

@query(f"WITH {_N} SELECT k, '---' || chr(10) || 'created: 2024' || chr(10) || CASE WHEN k % 3 = 0 THEN '' ELSE 'tags:' || chr(10) || '  - a' || chr(10) || '  - ' || lower(seg) || chr(10) END || CASE WHEN k % 2 = 0 THEN 'tagged: 2024-01-02' || chr(10) || 'tagged_hash: h' || k || chr(10) ELSE '' END || 'type: area' || chr(10) || '---' || chr(10) || 'Body ' || k AS text FROM n")
def note_stamp(s, d):
    k = F.col("c_custkey")
    own = F.when(k % 3 != 0, F.array(F.lit("a"), F.lower("c_mktsegment"))).otherwise(F.array().cast("array<string>"))
    even = lambda c: F.when(k % 2 == 0, c)
    return T(s, d, "customer").select(k.alias("k"), sinks.note_text(F.concat(F.lit("Body "), k.cast("string")), own, even(F.lit("2024-01-02")), even(F.concat(F.lit("h"), k.cast("string"))), F.lit("area"), F.lit("created: 2024")).alias("text"))


@query(f"WITH {_N} SELECT k, c_name AS title, 'a|' || lower(seg) AS tags, k % 2 = 0 AS fresh, 'Body ' || k AS body FROM n")
def note_stamp_read_back(s, d):
    """An imported note's text, parsed again."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("Body "), k.cast("string"))
    extras = F.concat(F.lit("tagged_hash: "), F.when(k % 2 == 0, text.body_hash(body)).otherwise("old"))
    imported = sinks.imported_text(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("2024-01-01 00:00:00"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lower("c_mktsegment")), F.lit("import"), body)
    rows = T(s, d, "customer").select(k.alias("k"), F.regexp_replace(imported, r"\A---\n", F.concat(F.lit("---\n"), extras, F.lit("\n"))).alias("text"))
    one = lambda n: F.try_element_at(F.try_element_at("frontmatter", F.lit(n)), F.lit(1))
    return vault.parse_notes(rows).select("k", one("title").alias("title"), F.array_join("tags", "|").alias("tags"), (F.col("tagged_hash") == F.col("body_hash")).alias("fresh"), "body")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'top' || chr(10) || '# A' || chr(10) || chr(10) || 'new ' || n_name || chr(10) || chr(10) || '# B' || chr(10) || 'b' ELSE 'top' || chr(10) || chr(10) || '# A' || chr(10) || chr(10) || 'new ' || n_name || chr(10) || chr(10) END AS spliced, CASE WHEN n_nationkey % 2 = 0 THEN 'top' || chr(10) || '# B' || chr(10) || 'b' ELSE 'top' || chr(10) END AS stripped FROM nation")
def section_splice(s, d):
    doc = F.when(F.col("n_nationkey") % 2 == 0, "top\n# A\nold\n## A1\ndeep\n# B\nb").otherwise("top\n")
    return T(s, d, "nation").select(F.col("n_nationkey").alias("k"), sinks.splice(doc, "# A", F.concat(F.lit("new "), "n_name")).alias("spliced"), sinks.strip_section(doc, "# A").alias("stripped"))


@query("SELECT '| Role | Source | Notes |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || r_name || ' | tool' || r_regionkey || ' | a\\|b |', chr(10) ORDER BY r_name) || chr(10) AS content FROM region")
def registry_table(s, d):
    return sinks.registry_table(T(s, d, "region").select(F.col("r_name").alias("role"), F.concat(F.lit("tool"), "r_regionkey").alias("source"), F.lit("a|b").alias("notes")))


_BRIDGE = "b AS (SELECT n_name AS skill, 'vault' AS role, 0 AS o FROM nation UNION ALL SELECT n_name, 'role' || n_regionkey, 1 FROM nation WHERE n_nationkey % 2 = 0), t AS (SELECT '| skill | role | contributes | required |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| `' || skill || '` | `' || role || '` | recent → `# Place` | ' || CASE WHEN role = 'vault' THEN 'always' ELSE 'optional' END || ' |', chr(10) ORDER BY skill, o, role) || chr(10) AS content FROM b)"


def _bridge(s, d):
    n = T(s, d, "nation")
    needs = n.select(F.col("n_name").alias("skill"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("vault"), F.concat(F.lit("role"), "n_regionkey"))).otherwise(F.array().cast("array<string>")).alias("roles"))
    return sinks.bridge_table(needs, lambda skill, role: F.lit("recent → `# Place`"))


@query(f"WITH {_BRIDGE} SELECT content FROM t")
def bridge_table(s, d):
    return _bridge(s, d)


@query(f"WITH {_BRIDGE} SELECT '# Connected sources' || chr(10) || chr(10) || '| Role | Source | Notes |' || chr(10) || '|---|---|---|' || chr(10) || '| chat | x |  |' || chr(10) || chr(10) || '## Who reads what' || chr(10) || chr(10) || content || chr(10) || '# External Sources' || chr(10) || chr(10) || '- https://a.example' || chr(10) AS content FROM t")
def registry_document(s, d):
    roles = s.createDataFrame([("chat", "x", "")], "role string, source string, notes string")
    feeds = s.createDataFrame([("fetch", "https://a.example", 1)], "kind string, target string, pos int")
    return sinks.registry_document(sinks.registry_table(roles), _bridge(s, d), feeds)


@query("SELECT string_agg('- ' || tag, chr(10) ORDER BY tag) || chr(10) AS content FROM (SELECT DISTINCT p_brand AS tag FROM part UNION SELECT r_name FROM region)")
def vocabulary_file(s, d):
    return sinks.vocabulary_file(T(s, d, "part").select(F.col("p_brand").alias("tag")), T(s, d, "region").select(F.col("r_name").alias("tag")))


@query("WITH c AS (SELECT n_regionkey, string_agg('  - ' || n_name, chr(10) ORDER BY n_name) AS kids FROM nation GROUP BY 1) SELECT string_agg('- ' || r_name || ' - about ' || r_regionkey || chr(10) || kids, chr(10) ORDER BY r_regionkey) || chr(10) AS content FROM region JOIN c ON n_regionkey = r_regionkey")
def enumeration(s, d):
    r = T(s, d, "region")
    parents = r.select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name"), F.concat(F.lit("about "), "r_regionkey").alias("description"))
    kids = T(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("name"), F.lit("").alias("description"))
    return sinks.enumeration(parents, kids)


@query("SELECT 'Projects/' || r_name || '/' || r_name || ' Overview.md' AS path, 'project' AS type, 3::BIGINT AS n_headings FROM region UNION ALL SELECT 'Projects/' || r_name || '/' || n_name || '/' || n_name || ' Overview.md', 'project', 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'Areas/' || c_mktsegment || '/' || c_mktsegment || '.md', 'area', 2 FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def seed_notes(s, d):
    r = T(s, d, "region")
    projects = r.select(F.col("r_name").alias("name"), F.lit("about").alias("description"))
    kids = T(s, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description"))
    areas = T(s, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("").alias("description")).distinct()
    seeds = sinks.seed_notes(projects, kids, areas)
    return vault.parse_notes(seeds.withColumnRenamed("content", "text")).select("path", "type", F.size(F.filter(F.split("body", "\n"), lambda x: x.startswith("## "))).cast("long").alias("n_headings"))


@query("SELECT '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS content FROM nation")
def manifest_rows(s, d):
    return sinks.manifest(T(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))


# Plan notes of fixed shape.

@query("SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN '# Admin' || chr(10) || '- a ' || n_name || chr(10) || chr(10) || '# Goals' || chr(10) || 'g' || chr(10) || chr(10) || '# Notes' || chr(10) || 'n' || chr(10) WHEN 1 THEN '# Admin' || chr(10) || chr(10) || '# Goals' || chr(10) || chr(10) || '# Notes' || chr(10) || n_name || chr(10) ELSE '# Admin' || chr(10) || 'x' || chr(10) || chr(10) || 'y' || chr(10) || 'again' || chr(10) || chr(10) || '# Goals' || chr(10) || chr(10) || '# Notes' || chr(10) END AS note FROM nation")
def daily_normalised(s, d):
    k = F.col("n_nationkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("stray title\n# Notes:\nn\n## Goals\ng\nAdmin\n- a "), "n_name")).when(k == 1, F.concat(F.lit("# Notes\n"), "n_name", F.lit("\n\n\n"))).otherwise("# Admin\nx\n\n\n\ny\n# Admin\nagain\n")
    return T(s, d, "nation").select(F.col("n_nationkey").alias("k"), text.normalize_daily(raw).alias("note"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '# Weekly Goals' || chr(10) || 'x' || chr(10) || 'Admin:' || chr(10) || '# Personal' || chr(10) ELSE '# ' || n_name || chr(10) || 'x' || chr(10) || '# Weekly Goals' || chr(10) || chr(10) || '# Admin' || chr(10) || chr(10) || '# Personal' || chr(10) END AS note FROM nation")
def weekly_normalised(s, d):
    raw = F.when(F.col("n_nationkey") % 2 == 0, "# Weekly Goals\nx\nAdmin:\n# Personal\n\n").otherwise(F.concat(F.lit("# "), "n_name", F.lit("\nx")))
    return T(s, d, "nation").select(F.col("n_nationkey").alias("k"), text.normalize_weekly(raw).alias("note"))


# Notes of archives.

@query("SELECT p_partkey, '**b** ' || p_name || chr(10) || chr(10) || '- one' || chr(10) || '- two [x](http://y)' || chr(10) || chr(10) || '[[' || replace(p_name, ' ', '-') || ']]' || chr(10) AS body FROM part")
def archive_markdown(s, d):
    src = F.concat(F.lit("<?xml version=\"1.0\"?><!DOCTYPE en-note SYSTEM \"x\"><en-note><p><b>b</b>\n "), "p_name", F.lit("</p><en-media type=\"x\"/><ul><li>one</li><li>two <a href=\"http://y\">x</a></li></ul><div><a href=\"evernote:///view/1\">"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("</a></div></en-note>"))
    return T(s, d, "part").select("p_partkey", enex.markdown_udf(src).alias("body"))


_KINDS = [("image/png", ".png"), ("image/jpeg", ".jpg"), ("application/pdf", ".pdf"), ("text/csv", ".csv"), ("application/json", ".json"), ("video/mp4", ".mp4"), ("text/plain", ".txt"), ("application/zip", ".zip"), ("x/unheard", "")]


@query(f"SELECT * FROM (VALUES {_values(_KINDS)}) AS v(mime, ending)")
def attachment_endings(s, d):
    return s.createDataFrame([(m,) for m, _ in _KINDS], "mime string").select("mime", enex.ending_of(F.col("mime")).alias("ending"))


@query("SELECT views.* FROM (SELECT n_nationkey AS k, 'created|2024' AS keys FROM nation) AS views")
def note_frontmatter_edges(s, d):
    """Carriage returns, an empty block, repeated keys and scalar lists."""
    raw = F.lit("---\r\ncreated: 'x'\r\ncreated: y\r\nyear: 2024\r\n---\r\nbody")
    p = vault.parse_notes(T(s, d, "nation").select(F.col("n_nationkey").alias("k"), raw.alias("text")))
    return p.select("k", F.concat_ws("|", F.when(F.element_at("frontmatter", "created")[0] == "x", "created"), F.element_at("frontmatter", "year")[0]).alias("keys"))
