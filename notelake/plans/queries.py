"""The registered vault queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, dates, text
from ..operators import checks, classify, graph, matching, planning, ranking, reconcile, roles, search, tags
from ..session import table
from ..sources import enex
from ..streaming import events as streams
from . import check_queries, daily, file_queries, note_queries, planning_queries, views
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "check_queries", "file_queries", "note_queries", "planning_queries"]

T = table


_DAILY = f"WITH {views.TASKS}, {daily.SQL.strip()}"


@query(_DAILY + " SELECT item, project, priority, p FROM scored ORDER BY priority, p DESC, item LIMIT 10")
def daily_plan_top10(s, d):
    return daily.top(views.tasks(s, d), views.AS_OF)


@query(_DAILY + " SELECT item, project, priority, p FROM scored ORDER BY priority, p DESC, item OFFSET 10")
def overflow_report(s, d):
    return daily.overflow(views.tasks(s, d), views.AS_OF)


@query(_DAILY + " SELECT item, priority, p FROM scored")
def rnk_p_completion(s, d):
    return daily.scored(views.tasks(s, d), views.AS_OF).select("item", "priority", "p")


@query(_DAILY + " SELECT item, CASE WHEN priority = 'P1' AND p < 35 THEN 'stuck' WHEN priority = 'P3' AND p > 80 THEN 'quick win' END AS flag FROM scored")
def rnk_mismatch_flags(s, d):
    return daily.scored(views.tasks(s, d), views.AS_OF).select("item", "flag")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'P1' WHEN o_totalprice < 50000 THEN 'P3' WHEN o_orderpriority = '5-LOW' THEN 'P3' ELSE 'P2' END AS priority FROM orders")
def rnk_priority_tag(s, d):
    prior = F.when(F.col("o_orderpriority") == "5-LOW", "P3")
    return T(s, d, "orders").select("o_orderkey", ranking.priority_tag(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") < 50000, prior).alias("priority"))


@query(_DAILY + " SELECT day, idx FROM days")
def hist_last7(s, d):
    return ranking.note_days(views.tasks(s, d), views.AS_OF).select("day", "idx")


@query(_DAILY + " SELECT item, occurrences, round(rate, 6) AS rate FROM stats")
def hist_occurrence_rate(s, d):
    return ranking.history_stats(ranking.history(views.tasks(s, d), views.AS_OF)).select("item", "occurrences", F.round("rate", 6).alias("rate"))


@query(_DAILY + " SELECT item, streak FROM stats")
def hist_streak(s, d):
    return ranking.history_stats(ranking.history(views.tasks(s, d), views.AS_OF)).select("item", "streak")


@query(f"WITH {views.CANDIDATES} SELECT doc_id, n_criteria, n_criteria >= 2 OR shorthand AS kept FROM candidates")
def cls_two_of_four(s, d):
    return classify.gate(views.candidates(s, d), F.col("shorthand")).select("doc_id", "n_criteria", "kept")


@query(f"WITH {views.CANDIDATES} SELECT source, count(*) AS n_candidates, count(*) FILTER (n_criteria >= 2 OR shorthand) AS n_kept FROM candidates GROUP BY source")
def cls_screened_by_source(s, d):
    return classify.screened(classify.gate(views.candidates(s, d), F.col("shorthand")))


@query(f"WITH {views.LINES}, w AS (SELECT norm, min(doc_id) AS doc_id, count(*) AS n FROM norms GROUP BY norm) SELECT a.doc_id AS daily_id, b.doc_id AS weekly_id, b.n AS n_weekly FROM daily AS a JOIN w AS b ON substr(a.norm, 1, 30) = substr(b.norm, 1, 30) AND {views.MATCH}")
def match_prefix30(s, d):
    weekly = views.lines(s, d).drop("lang", "source")
    lines = views.daily(weekly).withColumnRenamed("doc_id", "daily_id")
    # Equal lines are one, by their hash.
    same = [F.first(c).alias(c) for c in ("size__", "opening__", "begin__")]
    one = weekly.where("own IS NOT NULL").groupBy("own").agg(F.min("doc_id").alias("weekly_id"), F.count("*").alias("n_weekly"), *same)
    return matching.join_keyed(matching.keyed(lines, weekly), matching.keyed(one, lines))


@query(f"WITH {views.LINES} SELECT doc_id, norm FROM daily AS a WHERE NOT EXISTS (SELECT 1 FROM norms AS b WHERE b.lang <> 'en' AND substr(a.norm, 1, 30) = substr(b.norm, 1, 30) AND {views.MATCH})")
def dedupe_existing(s, d):
    lines = views.lines(s, d, "lang <> 'en' OR doc_id % 3 = 0")
    return matching.match_lines(views.daily(lines), lines.where("lang <> 'en'"), "left_anti").select("doc_id", F.col("begin__").alias("norm"))


@query(f"WITH {views.LINES} SELECT doc_id FROM daily AS a WHERE NOT EXISTS (SELECT 1 FROM norms AS b WHERE b.lang = 'en' AND substr(a.norm, 1, 30) = substr(b.norm, 1, 30) AND {views.MATCH})")
def completed_unplanned(s, d):
    lines = views.lines(s, d, "lang = 'en' OR doc_id % 3 = 0")
    return matching.match_lines(views.daily(lines), lines.where("lang = 'en'"), "left_anti").select("doc_id")


_WEEKS = f"WITH {views.TASKS}, u AS (SELECT DISTINCT item, day - dayofweek(day)::INT AS week FROM tasks WHERE NOT checked)"


@query(_WEEKS + " SELECT a.item, a.week FROM u AS a JOIN u AS b ON a.item = b.item AND a.week = b.week + 7 JOIN u AS c ON a.item = c.item AND a.week = c.week + 14")
def carry_forward_third_week(s, d):
    open_ = views.tasks(s, d).where("NOT checked").select("item", dates.week_start(F.col("day")).alias("week"))
    return matching.carried_weeks(open_)


@query(f"WITH {views.LINES} SELECT doc_id, EXISTS (SELECT 1 FROM daily AS b WHERE substr(a.norm, 1, 30) = substr(b.norm, 1, 30) AND {views.MATCH}) AS checked FROM norms AS a")
def reconcile_flip(s, d):
    planned = views.lines(s, d)
    return reconcile.flip_lines(planned.withColumn("checked", F.lit(False)), views.daily(planned)).select("doc_id", "checked")


_SNAP = "WITH o AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0)"


@query(_SNAP + " SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'add' WHEN n.c_custkey IS NULL THEN 'keep' WHEN o.v = n.v THEN 'confirm' ELSE 'revise' END AS verb FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def memory_reconcile_verbs(s, d):
    c = T(s, d, "customer")
    old = c.where("c_custkey % 10 <> 0").select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = c.where("c_custkey % 11 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("v"))
    return reconcile.verbs(old, new, "c_custkey", "v")


@query(f"WITH {views.NOTES} SELECT path, 'Resources/' || source AS domain, name FROM notes")
def note_scan(s, d):
    return views.notes(s, d).select("path", text.domain_of(F.col("path")).alias("domain"), "name")


@query("SELECT doc_id, substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 16) AS body_hash FROM documents")
def note_hash(s, d):
    return T(s, d, "documents").select("doc_id", text.body_hash(F.col("text")).alias("body_hash"))


@query(r"SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS n_words, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents")
def note_counts(s, d):
    return T(s, d, "documents").select("doc_id", *[c.alias(n) for n, c in text.text_counts(F.col("text")).items()])


@query(f"WITH {views.NOTES} SELECT path FROM notes WHERE ('0x' || substr(sha256(path), 1, 4))::BIGINT % 4 = 0")
def hash_sample(s, d):
    return views.notes(s, d).where(text.sample_one_in(F.col("path"), 4)).select("path")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug(s, d):
    return T(s, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\/:*?"<>|#^\[\]]', '-', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN regexp_replace(substr(t, 1, 150), '^\s+|\s+$', '', 'g') = '' THEN 'untitled' ELSE regexp_replace(substr(t, 1, 150), '^\s+|\s+$', '', 'g') END AS name FROM c""")
def sanitize_filename(s, d):
    return T(s, d, "documents").select("doc_id", text.sanitize_filename(F.col("text")).alias("name"))


@query(r"SELECT p_partkey, lower(regexp_replace(regexp_replace(' ' || upper(p_name), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g')) AS tag FROM part")
def normalize_tag(s, d):
    return T(s, d, "part").select("p_partkey", text.normalize_tag(F.concat(F.lit(" "), F.upper("p_name"))).alias("tag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'bad ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS created FROM orders")
def enex_date(s, d):
    raw = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("bad "), "o_orderkey")).otherwise(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'"))
    return T(s, d, "orders").select("o_orderkey", text.enex_date(raw).alias("created"))


@query("SELECT event_id, replace(regexp_replace(event_type || chr(10) || '|' || props, '[\\r\\n]+', ' ', 'g'), '|', '/') AS line FROM events".replace("\\\\", "\\"))
def log_sanitize(s, d):
    return T(s, d, "events").select("event_id", text.log_sanitize(F.concat("event_type", F.lit("\n|"), "props")).alias("line"))


@query("SELECT DISTINCT o_orderdate::DATE AS day, strftime(o_orderdate::DATE - dayofweek(o_orderdate)::INT, '%-m-%-d-%Y') AS label FROM orders")
def week_start_label(s, d):
    return T(s, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", dates.plan_label(dates.week_start(F.col("day"))).alias("label"))


@query("WITH p AS (SELECT o_orderdate::DATE - dayofweek(o_orderdate)::INT AS week, count(*) AS n_planned FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT o.o_orderkey, p.n_planned FROM orders AS o LEFT JOIN p ON o.o_orderdate::DATE BETWEEN p.week AND p.week + 6")
def plan_week_join(s, d):
    o = T(s, d, "orders").withColumn("week", dates.week_start(F.to_date("o_orderdate")))
    plans = o.where("o_orderstatus = 'O'").groupBy("week").agg(F.count("*").alias("n_planned"))
    return o.join(plans, "week", "left").select("o_orderkey", "n_planned")


@query("SELECT dayofweek(o_orderdate)::INT AS dow, dayofweek(o_orderdate) IN (0, 6) AS weekend, count(*) AS n FROM orders GROUP BY ALL")
def weekend_days(s, d):
    day = F.to_date("o_orderdate")
    return T(s, d, "orders").groupBy(dates.day_of_week(day).alias("dow"), dates.is_weekend(day).alias("weekend")).agg(F.count("*").alias("n"))


def _search(name: str, q: str, where: str) -> None:
    query(f"WITH {views.NOTES} SELECT path FROM notes WHERE {where}", name)(lambda s, d: search.search(views.notes(s, d), q).select("path"))


_search("search_and", "the and", "contains(lower(body), 'the') AND contains(lower(body), 'and')")
_search("search_or_not", "(token OR apache) -idiot", "(contains(lower(body), 'token') OR contains(lower(body), 'apache')) AND NOT contains(lower(body), 'idiot')")
_search("search_phrase_case", 'match-case:"The and"', "contains(body, 'The and')")
_search("search_line", "line:(license version)", "len(list_filter(string_split(body, chr(10)), lambda l: contains(lower(l), 'license') AND contains(lower(l), 'version'))) > 0")
_search("search_regex", r"/\d{16}/", r"regexp_matches(body, '\d{16}')")
_search("search_tag_path", "tag:en path:src1", "lang = 'en' AND contains(lower(path), 'src1')")
_search("search_property", "[lang:de] [n_chars:<500]", "lang = 'de' AND n_chars < 500")


@query(f"WITH {views.NOTES}, l AS (SELECT path, unnest(string_split(body, chr(10))) AS line FROM notes) SELECT path, line FROM l WHERE contains(lower(line), 'licensed under')")
def search_context(s, d):
    return search.context(views.notes(s, d), '"licensed under"').select("path", "line")


_HITS = f"WITH {views.NOTES}, h AS (SELECT path, (contains(lower(body), 'the'))::BIGINT + (contains(lower(body), 'apache'))::BIGINT + (contains(lower(body), '555'))::BIGINT + (lang = 'en')::BIGINT AS hits FROM notes)"


@query(_HITS + " SELECT path, hits FROM h WHERE hits > 0 ORDER BY hits DESC, path LIMIT 5")
def expansion_hits(s, d):
    return search.expansions(views.notes(s, d), ["the", "apache", "555", "tag:en"], 5)


@query(f"WITH {views.LOG} SELECT action, count(*) AS n FROM log GROUP BY action")
def log_by_action(s, d):
    return views.log(s, d).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {views.LOG} SELECT path, max(ts) AS last_touched FROM log GROUP BY path")
def log_last_touched(s, d):
    return views.log(s, d).groupBy("path").agg(F.max("ts").alias("last_touched"))


@query(f"WITH {views.LOG} SELECT event_id, action FROM log ORDER BY ts DESC, event_id DESC LIMIT 20")
def log_tail(s, d):
    return views.log(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "action")


@query(f"WITH {views.LOG} SELECT event_id FROM log WHERE starts_with(path, 'Projects/3') AND action = 'error' AND ts::DATE = DATE '2024-01-10'")
def log_filters(s, d):
    return views.log(s, d).where(F.col("path").startswith("Projects/3") & (F.col("action") == "error") & (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-11")).select("event_id")


@query(f"WITH {views.LOG} SELECT event_id FROM log WHERE ts::DATE BETWEEN greatest(DATE '2024-01-15' - 2, DATE '2024-01-14') AND DATE '2024-01-15'")
def log_lookback_floor(s, d):
    today = F.lit("2024-01-15").cast("date")
    return views.log(s, d).where(F.to_date("ts").between(dates.lookback_floor(today), today)).select("event_id")


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS n_messages FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'user'")
def threads_unanswered(s, d):
    t = T(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n_messages"), F.max_by("role", "turn").alias("role"))
    return t.where("role = 'user'").drop("role")


@query("SELECT 'chat' AS source, conv_id AS id, turn AS at FROM conversations WHERE role = 'user' UNION ALL SELECT 'email', event_id, user_id FROM events WHERE event_type = 'signup'")
def inbox_merge(s, d):
    chat = T(s, d, "conversations").where("role = 'user'").select(F.lit("chat").alias("source"), F.col("conv_id").alias("id"), F.col("turn").alias("at"))
    mail = T(s, d, "events").where("event_type = 'signup'").select(F.lit("email").alias("source"), F.col("event_id").alias("id"), F.col("user_id").alias("at"))
    return chat.unionByName(mail)


_ROLES = "WITH needs AS (SELECT n_name AS skill, 'role-' || (n_nationkey % 7) AS role FROM nation), registry AS (SELECT 'role-' || r_regionkey AS role, CASE WHEN r_regionkey = 2 THEN 'none' ELSE r_name END AS source FROM region), tools AS (SELECT r_name AS tool FROM region WHERE r_regionkey <> 3)"


def _roles(s, d):
    needs = T(s, d, "nation").select(F.col("n_name").alias("skill"), F.concat(F.lit("role-"), F.col("n_nationkey") % 7).alias("role"))
    r = T(s, d, "region")
    return needs, r.select(F.concat(F.lit("role-"), "r_regionkey").alias("role"), F.when(F.col("r_regionkey") == 2, "none").otherwise(F.col("r_name")).alias("source")), r.where("r_regionkey <> 3").select(F.col("r_name").alias("tool"))


@query(_ROLES + " SELECT skill, n.role, CASE WHEN r.role IS NULL THEN 'missing' WHEN r.source = 'none' THEN 'none' WHEN t.tool IS NULL THEN 'stale' ELSE 'ok' END AS outcome FROM needs AS n LEFT JOIN registry AS r ON n.role = r.role LEFT JOIN tools AS t ON r.source = t.tool")
def role_resolution(s, d):
    return roles.resolve(*_roles(s, d)).select("skill", "role", "outcome")


@query(_ROLES + " SELECT DISTINCT role FROM needs WHERE role NOT IN (SELECT role FROM registry)")
def roles_unknown(s, d):
    needs, registry, _ = _roles(s, d)
    return roles.unknown(needs, registry)


@query(_ROLES + " SELECT DISTINCT role FROM needs WHERE role NOT IN (SELECT role FROM registry) AND role <> 'role-6'")
def roles_undeclared(s, d):
    needs, registry, _ = _roles(s, d)
    return roles.undeclared(needs, registry, ("role-6",))


_HREFS = "WITH e AS (SELECT page_id AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)"


@query(_HREFS + " SELECT src, target FROM e")
def links_extract(s, d):
    return graph.hrefs(T(s, d, "pages"))


@query(_HREFS + " SELECT src, target FROM e WHERE target NOT IN (SELECT target FROM e GROUP BY target HAVING count(*) > 8)")
def links_unresolved(s, d):
    e = graph.hrefs(T(s, d, "pages"))
    return graph.unresolved(e, e.groupBy("target").count().where("count > 8").select(F.col("target").alias("title")))


@query(_HREFS + " SELECT target, count(*) AS n_links, count(DISTINCT src) AS n_sources FROM e GROUP BY target")
def links_backlinks(s, d):
    return graph.backlinks(graph.hrefs(T(s, d, "pages")))


@query(_HREFS + " SELECT url AS node FROM pages WHERE url NOT IN (SELECT target FROM e)")
def links_orphans(s, d):
    p = T(s, d, "pages")
    return graph.orphans(p.select(F.col("url").alias("node")), graph.hrefs(p))


@query(f"WITH {views.NOTES} SELECT tag, count(*) AS n FROM (SELECT lang AS tag FROM notes UNION ALL SELECT source FROM notes UNION ALL SELECT lang || '/' || source FROM notes) GROUP BY tag")
def vocab_counts(s, d):
    return tags.vocabulary(views.notes(s, d))


@query(f"WITH {views.WORDS} SELECT tag FROM words WHERE n = 1")
def vocab_single_use(s, d):
    return views.words(s, d).where("n = 1").select("tag")


_DECLARED = f"WITH {views.WORDS}, declared AS (SELECT tag FROM words WHERE ascii(tag) % 2 = 0 UNION ALL SELECT 'unused-' || r_name FROM region)"


def _declared(s, d):
    return views.words(s, d).where("ascii(tag) % 2 = 0").select("tag").union(T(s, d, "region").select(F.concat(F.lit("unused-"), "r_name")))


@query(_DECLARED + " SELECT count(*) AS n_established, count(d.tag) AS n_listed, CASE WHEN count(*) > 0 AND count(d.tag) * 100 >= count(*) * 60 THEN 'canon' ELSE 'frequency' END AS mode FROM words AS w LEFT JOIN declared AS d ON w.tag = d.tag WHERE n >= 5")
def vocab_coverage(s, d):
    return tags.coverage(views.words(s, d), _declared(s, d))


@query(_DECLARED + " SELECT coalesce(w.tag, d.tag) AS tag, CASE WHEN d.tag IS NULL THEN 'unlisted' WHEN w.tag IS NULL THEN 'unused' ELSE 'both' END AS status FROM words AS w FULL JOIN declared AS d ON w.tag = d.tag")
def vocab_unlisted_unused(s, d):
    return tags.against_declared(views.words(s, d), _declared(s, d))


_PAIRS = f"WITH {views.PART_TAGS}, v AS (SELECT tag, count(*) AS n, array_to_string(list_sort(list_distinct(string_split(tag, '/'))), '/') AS key FROM part_tags GROUP BY tag), pairs AS (SELECT a.tag AS tag1, b.tag AS tag2, a.n AS n1, b.n AS n2 FROM v AS a JOIN v AS b ON a.key = b.key AND a.tag < b.tag)"


def _part_vocab(s, d):
    return views.part_tags(s, d).groupBy("tag").agg(F.count("*").alias("n"))


@query(_PAIRS + " SELECT tag1, tag2 FROM pairs")
def lint_reordered(s, d):
    return tags.reordered(_part_vocab(s, d))


@query("WITH v AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN replace(lower(p_name), ' ', '_') ELSE replace(upper(p_name), ' ', '-') END AS tag FROM part) SELECT a.tag AS tag1, b.tag AS tag2 FROM v AS a JOIN v AS b ON lower(regexp_replace(a.tag, '[-_ ]', '', 'g')) = lower(regexp_replace(b.tag, '[-_ ]', '', 'g')) AND a.tag < b.tag")
def lint_case_sep(s, d):
    tag = F.when(F.col("p_partkey") % 2 == 0, F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).otherwise(F.replace(F.upper("p_name"), F.lit(" "), F.lit("-")))
    return tags.case_or_separator(T(s, d, "part").select(tag.alias("tag")))


@query(f"WITH {views.WORDS} SELECT a.tag AS tag1, b.tag AS tag2, levenshtein(a.tag, b.tag)::INT AS distance FROM words AS a JOIN words AS b ON a.tag < b.tag AND levenshtein(a.tag, b.tag) <= 2 WHERE length(a.tag) >= 6 AND length(b.tag) >= 6")
def lint_edit2(s, d):
    return tags.edit_distance(views.words(s, d), 2, 6)


@query(_PAIRS + " SELECT CASE WHEN n1 >= n2 THEN tag2 ELSE tag1 END AS from_tag, CASE WHEN n1 >= n2 THEN tag1 ELSE tag2 END AS to_tag FROM pairs")
def lint_merge_plan(s, d):
    vocab = _part_vocab(s, d)
    return tags.merge_plan(tags.reordered(vocab), vocab)


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'en|' || source || '|fr/' || source ELSE lang || '|' || source || '|' || lang || '/' || source END AS tags FROM documents")
def tag_merge(s, d):
    return tags.merge(views.notes(s, d), "fr", "en").select("doc_id", F.array_join("tags", "|").alias("tags"))


@query("SELECT arg_max(n, day) AS anchor FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) WHERE day < DATE '2000-01-01'")
def asof_anchor(s, d):
    perday = T(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return reconcile.as_of_anchor(perday, "day", "n", "2000-01-01")


@query("WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT e.event_id, v.value FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts")
def asof_join(s, d):
    e = T(s, d, "events")
    seen = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return reconcile.as_of_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), seen, "user_id", "ts", "value").select("event_id", "value")


@query("SELECT max(ts::DATE) + 1 AS start FROM events WHERE event_type <> 'error'")
def window_highwater(s, d):
    return reconcile.high_water(T(s, d, "events").where("event_type <> 'error'"))


@query("WITH o AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 10 <> 0) SELECT n.doc_id AS path, CASE WHEN o.doc_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM documents AS n LEFT JOIN o ON n.doc_id = o.doc_id WHERE o.doc_id IS NULL OR o.size <> n.n_chars")
def snapshot_diff(s, d):
    new = T(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    old = new.where("path % 10 <> 0").withColumn("size", F.col("size") + F.when(F.col("path") % 7 == 0, 1).otherwise(0))
    return reconcile.changes(old, new, "path", ("size",))


@query("SELECT doc_id FROM documents ORDER BY n_chars, doc_id OFFSET 100")
def deferred_ceiling(s, d):
    pending = T(s, d, "documents").select("doc_id", "n_chars")
    return reconcile.with_ceiling(pending, 100, [F.col("n_chars"), F.col("doc_id")])[1].select("doc_id")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'done' WHEN user_id % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS state FROM events")
def retry_cap(s, d):
    return T(s, d, "events").select("event_id", reconcile.next_state(F.col("user_id") % 4, F.col("value") > 50).alias("state"))


@query("SELECT p_partkey, p_name || CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN '' ELSE ' (' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) || ')' END AS name FROM part")
def name_dedupe(s, d):
    return enex.named(T(s, d, "part"), "p_partkey", "p_name").select("p_partkey", "name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN '*[missing attachment: ' || md5(l_partkey::VARCHAR) || ']*' WHEN p_type LIKE '%STEEL%' THEN '![[' || p_name || ']]' ELSE '[[' || p_name || ']]' END AS link FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) ON l_partkey = p_partkey")
def attachment_resolve(s, d):
    j = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(T(s, d, "part").where("p_partkey % 7 <> 0").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left")
    link = F.when(F.col("p_partkey").isNull(), F.concat(F.lit("*[missing attachment: "), F.md5(F.col("l_partkey").cast("string")), F.lit("]*"))).when(F.col("p_type").contains("STEEL"), F.concat(F.lit("![["), "p_name", F.lit("]]"))).otherwise(F.concat(F.lit("[["), "p_name", F.lit("]]")))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", link.alias("link"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(s, d):
    return T(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_text(s, d):
    bare = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    return T(s, d, "pages").select("page_id", F.trim(text.collapse_ws(bare)).alias("text"))


@query()
def html_markdown(s, d):
    return T(s, d, "pages").select("page_id", enex.markdown_udf("html").alias("markdown"))


@query("SELECT 'log lines have four fields' AS \"check\", CASE WHEN count(*) FILTER (event_id % 100 = 0) = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) FILTER (event_id % 100 = 0) AS n_violations FROM events UNION ALL SELECT 'the manifest is not empty', 'pass', 0 UNION ALL SELECT 'languages present', 'pass', 0 UNION ALL SELECT 'duplicate texts', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END, count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def checks_report(s, d):
    docs = T(s, d, "documents")
    lines = views.log(s, d).select(F.concat_ws("|", "action", "path", F.lit("x"), F.when(F.col("event_id") % 100 != 0, F.lit("y"))).alias("value"))
    twice = docs.groupBy("text").count()
    return checks.report([checks.log_fields(lines), checks.some(docs, "the manifest is not empty"), checks.all_present(docs, "lang", ["en", "de", "fr", "es"], "languages present"), checks.none_of(twice, "duplicate texts", F.col("count") > 1, warn=True)])


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') AS text FROM documents WHERE contains(text, '@')")
def redact_email(s, d):
    return T(s, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", text.redact_emails(F.col("text")).alias("text"))


@query("SELECT week, event_type, n FROM (SELECT ts::DATE - dayofweek(ts)::INT AS week, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE week + 7 <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)")
def stream_week_counts(s, d):
    return streams.drain(streams.week_counts(streams.read_events(s, d)))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(s, d):
    # The lateness covers the whole stream, so each key is shown once by the stream itself.
    return streams.drain(streams.first_of_each(streams.read_events(s, d), ["user_id", "event_type"], "36500 days")).select("user_id", "event_type")


@query("SELECT o_orderkey, greatest(least(DATE '2001-08-01', o_orderdate::DATE + 1), DATE '2001-08-01' - 29) AS floor FROM orders")
def memory_window(s, d):
    today = F.lit("2001-08-01").cast("date")
    return T(s, d, "orders").select("o_orderkey", F.greatest(F.least(today, dates.memory_floor(F.to_date("o_orderdate"), today)), F.date_sub(today, 29)).alias("floor"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 07:30:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20 07:30:00'")
def news_window(s, d):
    now, last = F.lit("2024-01-20 07:30:00").cast("timestamp"), F.lit("2024-01-18 07:30:00").cast("timestamp")
    return T(s, d, "events").where((F.col("ts") > dates.news_floor(now, last)) & (F.col("ts") <= now)).select("event_id")


@query("SELECT path, event_id, rank FROM (SELECT 'Projects/' || (user_id % 10) AS path, event_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def top_per_role(s, d):
    return ranking.top_per_group(views.log(s, d), "path", [F.desc("ts"), F.col("event_id")], 5).select("path", "event_id", "rank")


@query("SELECT o_custkey, count(*) AS n_notes, count(*) FILTER (o_orderstatus = 'F') AS n_tagged FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') = 0")
def tagging_gap(s, d):
    return T(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_notes"), F.count_if(F.col("o_orderstatus") == "F").alias("n_tagged")).where("n_tagged = 0")


@query("WITH a AS (SELECT DISTINCT n_nationkey AS k FROM nation), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS listed, b.k IS NOT NULL AS active FROM a FULL JOIN b ON a.k = b.k")
def activity_gap(s, d):
    return planning.activity_gap(T(s, d, "nation").select(F.col("n_nationkey").alias("k")), T(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT source, path, n FROM (SELECT source, lang AS path, count(*) AS n FROM documents GROUP BY ALL) UNION ALL SELECT source, source || '/' || lang, count(*) FROM documents GROUP BY ALL")
def hierarchy_flatten(s, d):
    docs = T(s, d, "documents").select("source", F.explode(F.array("lang", F.element_at(arrays.with_parents(F.col("source"), F.array("lang")), 2))).alias("path"))
    return docs.groupBy("source", "path").agg(F.count("*").alias("n"))


@query("SELECT week, event_type, n FROM (SELECT ts::DATE - dayofweek(ts)::INT AS week, event_type, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE - dayofweek(ts)::INT) AS k FROM events GROUP BY ts::DATE - dayofweek(ts)::INT, event_type) WHERE k <= 3")
def oldest_three(s, d):
    weekly = T(s, d, "events").groupBy(dates.week_start(F.to_date("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("week")
    return weekly.withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")
