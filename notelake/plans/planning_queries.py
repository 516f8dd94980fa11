"""Registered queries of weekly and daily planning, the inbox and the news, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, text
from ..operators import classify, inbox, matching, planning, ranking, reconcile, tags, udf
from ..session import table as T
from . import daily, views
from .registry import query

_TODAY = f"DATE '{views.AS_OF}'"


def _today():
    return F.lit(views.AS_OF).cast("date")


# Candidates and history.

_DAILY = f"WITH {views.TASKS}, {daily.SQL.strip()}, c AS (SELECT item, min(prior_tag) AS priority, bool_or(day >= {_TODAY} - 3) AS soon FROM tasks GROUP BY item UNION ALL SELECT 'new-' || r_regionkey, 'P1', r_regionkey % 2 = 0 FROM region)"


@query(
    _DAILY
    + """ SELECT c.item, c.priority, greatest(5, least(97, CASE c.priority WHEN 'P1' THEN 70 WHEN 'P3' THEN 20 ELSE 45 END + CASE WHEN c.soon THEN 15 ELSE 0 END
    + CASE WHEN length(c.item) <= 6 THEN 10 ELSE -10 END - CASE WHEN s.streak IS NULL THEN 0 ELSE least(s.streak * 5, 30) END + CASE WHEN s.rate >= 0.7 THEN 10 ELSE 0 END))::INT AS p,
    s.streak, s.occurrences FROM c LEFT JOIN stats AS s ON c.item = s.item"""
)
def candidates_scored(s, d):
    t = views.tasks(s, d)
    own = t.groupBy("item").agg(F.min("prior_tag").alias("prior_tag"), F.max(F.col("day") >= F.date_sub(_today(), 3)).alias("soon"))
    new = T(s, d, "region").select(F.concat(F.lit("new-"), "r_regionkey").alias("item"), F.lit("P1").alias("prior_tag"), (F.col("r_regionkey") % 2 == 0).alias("soon"))
    return daily.scored_candidates(own.unionByName(new), t, views.AS_OF).select("item", "priority", "p", "streak", "occurrences")


@query("SELECT 'meetings' AS source, o_orderkey AS id, NULL::VARCHAR AS note FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'daily', o_orderkey, NULL FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'projects', p_partkey, p_name FROM part UNION ALL SELECT 'calendar', event_id, NULL FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'carried', c_custkey, c_name FROM customer")
def candidate_pool(s, d):
    o = T(s, d, "orders")
    return planning.candidate_pool(
        meetings=o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")),
        daily=o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")),
        projects=T(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("note")),
        calendar=T(s, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id")),
        carried=T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("note")),
    ).select("source", "id", "note")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0 OR o_custkey % 4 = 1 OR o_orderpriority = '1-URGENT'")
def screen_owner(s, d):
    owner = F.when(F.col("o_custkey") % 4 == 1, "me").when(F.col("o_custkey") % 4 == 2, "ann").when(F.col("o_custkey") % 4 == 3, "bo")
    return T(s, d, "orders").where(planning.for_user(owner, "me", F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey % 4 IN (1, 2) AND (o_orderstatus <> 'F' OR o_custkey % 3 <> 0) AS kept FROM orders")
def cls_meeting_owner(s, d):
    """A meeting's candidate needs an owner besides two criteria: here all have two, some no owner."""
    rows = T(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4 != 0).alias("specific"), (F.col("o_custkey") % 4 != 3).alias("atomic"), F.lit(False).alias("clear"), F.lit(None).cast("boolean").alias("timed"), F.when(F.col("o_custkey") % 3 != 0, "me").alias("owner"), (F.col("o_orderstatus") == "F").alias("meeting"))
    return classify.gate(rows, None, F.col("owner"), F.col("meeting")).select("o_orderkey", "kept")


@query("SELECT doc_id, quality = 1 AND toxic = 0 AND doc_id % 3 <> 0 AS durable, quality = 1 AND toxic = 0 AS goal FROM labels")
def durable_and_goal_gates(s, d):
    q, t = F.nullif("quality", F.lit(0)) == 1, F.col("toxic") == 0
    return T(s, d, "labels").select("doc_id", classify.all_of(q, t, F.col("doc_id") % 3 != 0).alias("durable"), classify.all_of(q, t).alias("goal"))


# Candidates whose fate is known, each with what the rules say of it.
GOLDEN = (
    ("Draft the pricing memo for the board by Friday", True), ("Send Kim the signed contract today", True), ("Book flights to Denver for the June offsite", True), ("Review the onboarding checklist before Monday", True), ("Update the roadmap slide with the Q3 dates", True),
    ("migration", False), ("it", False), ("stuff and things; also that", False), ("ws12", False), ("and then more", False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(k).lower()})" for t, k in GOLDEN) + ") AS v(text, kept)")
def cls_golden(s, d):
    rows = s.createDataFrame([(t,) for t, _ in GOLDEN], "text string")
    return classify.gate(classify.score(rows)).select("text", "kept")


_CUT = {"Review the doc —": True, "Ask Kim about the": False, "Send the list,": True, "Call the bank -": True, "Finish": False}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {str(k).lower()}, '{t} and more')" for t, k in _CUT.items()) + ") AS v(text, truncated, source_line) WHERE truncated")
def cls_refetch(s, d):
    """Truncated candidates joined back to the lines they were cut from."""
    lines = s.createDataFrame([(k, t, f"{t} and more") for k, t in enumerate(_CUT)], "id long, text string, source_line string")
    found = lines.select("id", "text", classify.truncated(F.col("text")).alias("truncated")).where("truncated")
    return found.join(lines.select("id", "source_line"), "id").select("text", "truncated", "source_line")


# Routing and order of sections.

_HEADERS = "h AS (SELECT lower(n_name) AS alias, 'Area ' || n_regionkey AS header FROM nation WHERE n_regionkey < 3)"


def _headers(s, d):
    return T(s, d, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("alias"), F.concat(F.lit("Area "), "n_regionkey").alias("header"))


def _routed(s, d):
    c = T(s, d, "supplier").join(T(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("origin"))
    return planning.route(c, _headers(s, d))


@query(f"WITH {_HEADERS} SELECT s_suppkey, header FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN h ON alias = lower(n_name)")
def route_candidates(s, d):
    return _routed(s, d)[0].select("s_suppkey", "header")


@query(f"WITH {_HEADERS} SELECT s_suppkey, n_name AS origin FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) NOT IN (SELECT alias FROM h)")
def route_unroutable(s, d):
    return _routed(s, d)[1].select("s_suppkey", "origin")


_LEGACY = "l AS (SELECT p_partkey, p_name AS text, CASE p_size % 4 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Personal' ELSE p_brand END AS section FROM part), a(alias, header) AS (VALUES ('ring', 'Jewels'), ('bolt', 'Hardware'), ('red', 'Colours'))"


def _legacy(s, d):
    section = F.when(F.col("p_size") % 4 == 0, "Admin").when(F.col("p_size") % 4 == 1, "Personal").otherwise(F.col("p_brand"))
    items = T(s, d, "part").select("p_partkey", F.col("p_name").alias("text"), section.alias("section"))
    return planning.route_legacy(items, s.createDataFrame([("ring", "Jewels"), ("bolt", "Hardware"), ("red", "Colours")], "alias string, header string"))


@query(f"WITH {_LEGACY} SELECT p_partkey, section AS header FROM l WHERE section NOT IN ('Admin', 'Personal') UNION ALL SELECT p_partkey, min(header) FROM l JOIN a ON list_contains(string_split(lower(text), ' '), alias) WHERE section IN ('Admin', 'Personal') GROUP BY p_partkey")
def route_legacy(s, d):
    return _legacy(s, d)[0].select("p_partkey", "header")


@query(f"WITH {_LEGACY} SELECT p_partkey FROM l WHERE section IN ('Admin', 'Personal') AND NOT EXISTS (SELECT 1 FROM a WHERE list_contains(string_split(lower(text), ' '), alias))")
def route_legacy_left(s, d):
    return _legacy(s, d)[1].select("p_partkey")


@query("SELECT n_name AS name, row_number() OVER (ORDER BY n_regionkey >= 2, CASE WHEN n_regionkey < 2 THEN 100 - n_nationkey END, n_name)::INT AS place FROM nation")
def section_order(s, d):
    rows = T(s, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") < 2, "project").otherwise("area").alias("kind"), (100 - F.col("n_nationkey")).alias("pos"))
    return planning.section_order(rows).select("name", "place")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderpriority, (o_totalprice::BIGINT % 97) DESC, o_orderkey)::INT AS place FROM orders")
def rank_in_section(s, d):
    rows = T(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("section"), F.col("o_orderpriority").alias("priority"), (F.rint("o_totalprice").cast("long") % 97).alias("p"), F.col("o_orderkey").alias("ordinal"))
    return planning.ranked_in_section(rows).select("o_orderkey", "place")


@query("SELECT DISTINCT p.p_partkey FROM part AS p, (SELECT p_name, p_type FROM part WHERE p_size = 1) AS e WHERE len(list_intersect(list_filter(list_distinct(string_split(lower(p.p_name || ' ' || p.p_type), ' ')), lambda w: length(w) >= 4), list_distinct(string_split(lower(e.p_name || ' ' || e.p_type), ' ')))) >= 3")
def calendar_match(s, d):
    p = T(s, d, "part").withColumn("words", F.concat_ws(" ", "p_name", "p_type"))
    events = p.where("p_size = 1").select(F.col("p_partkey").alias("event"), F.col("words").alias("title")).dropDuplicates(["title"])
    return planning.on_calendar(p.select(F.col("p_partkey").alias("id"), F.col("words").alias("text")), events, 3).select(F.col("id").alias("p_partkey"))


# Windows over days.

@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN {_TODAY} - 1 AND {_TODAY}")
def meetings_past_two_days(s, d):
    return T(s, d, "orders").where(dates.in_past_two_days(F.to_date("o_orderdate"), _today())).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= {_TODAY} - dayofweek({_TODAY})::INT - 7 AND o_orderdate::DATE < {_TODAY} - dayofweek({_TODAY})::INT")
def meetings_prior_week(s, d):
    return T(s, d, "orders").where(dates.in_prior_week(F.to_date("o_orderdate"), _today())).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-03-01' AND DATE '1998-04-15' AND contains(lower(o_orderpriority), 'high')")
def meetings_in_horizon(s, d):
    m = T(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("title"))
    return planning.in_horizon(m, F.lit("1998-03-01").cast("date"), F.lit("1998-04-15").cast("date"), "High").select("o_orderkey")


@query("SELECT o_custkey, max(o_orderdate::DATE) AS day, arg_max(o_orderkey, (o_orderdate::DATE, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def meeting_latest(s, d):
    m = T(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return planning.latest(m, "o_custkey", "day", ("o_orderkey",))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'")
def notes_modified_between(s, d):
    """A half-open range of modification times."""
    return T(s, d, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp"))).select("event_id")


@query("WITH w AS (SELECT DISTINCT o_orderdate::DATE - dayofweek(o_orderdate)::INT AS week FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000) SELECT week, lag(week, 1) OVER (ORDER BY week) AS previous, lag(week, 2) OVER (ORDER BY week) AS two_back FROM w")
def previous_plans(s, d):
    o = T(s, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 450000")
    return planning.previous_plans(o.select(dates.week_start(F.to_date("o_orderdate")).alias("week")).distinct()).select("week", "previous", "two_back")


@query("SELECT p_partkey, lpad((p_partkey % 7 + 9)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN ':00' ELSE ':30' END AS slot FROM part")
def time_slots(s, d):
    return T(s, d, "part").select("p_partkey", dates.time_slot(F.col("p_partkey")).alias("slot"))


# Reconciliations.

@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only declared' WHEN a.k IS NULL THEN 'only found' ELSE 'both' END AS status FROM a FULL JOIN b ON a.k = b.k")
def projects_cross_check(s, d):
    a = T(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return planning.cross_check(a, T(s, d, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def done_uncorroborated(s, d):
    done = T(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return planning.uncorroborated(done, T(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT n_name AS skill, 'missing' AS side FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000) UNION ALL SELECT 'old-' || r_name, 'removed' FROM region")
def skills_installed(s, d):
    """Skills asked for but not installed, and installed but not asked for."""
    n = T(s, d, "nation")
    wanted = n.select(F.col("n_name").alias("name"))
    held = n.join(T(s, d, "supplier").where("s_acctbal > 8000"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("n_name").alias("name"))
    held = held.union(T(s, d, "region").select(F.concat(F.lit("old-"), "r_name")))
    both = planning.cross_check(wanted, held).where("status <> 'both'")
    return both.select(F.col("name").alias("skill"), F.when(F.col("status") == "only declared", "missing").otherwise("removed").alias("side"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def skills_system_and_user(s, d):
    return T(s, d, "nation").select(F.col("n_name").alias("name")).union(T(s, d, "region").select("r_name")).distinct()


@query("SELECT n_name AS routine, CASE WHEN r_name IS NULL THEN 'no document' ELSE r_name END AS document FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 1) ON n_regionkey = r_regionkey")
def routines_documents(s, d):
    """Confirmed routines with their documents; those without one are warned of and left out of the schedule."""
    docs = T(s, d, "region").where("r_regionkey <> 1")
    out = T(s, d, "nation").join(docs, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select(F.col("n_name").alias("routine"), F.coalesce("r_name", F.lit("no document")).alias("document"))


@query("WITH r AS (SELECT p_partkey AS pos, replace(p_name, ' ', '/') AS path FROM part) SELECT pos, split_part(path, '/', 1) AS grp, nullif(regexp_replace(path, '^[^/]*/?', ''), '') AS child, min(pos) OVER (PARTITION BY split_part(path, '/', 1)) AS first FROM r")
def groups_with_children(s, d):
    rows = T(s, d, "part").select(F.col("p_partkey").alias("pos"), F.replace("p_name", F.lit(" "), F.lit("/")).alias("path"))
    return planning.groups_with_children(rows).select("pos", "grp", "child", "first")


@query("SELECT min(p_partkey) AS pos, lower(p_brand) AS brand FROM part GROUP BY lower(p_brand)")
def distinct_first_wins(s, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    rows = T(s, d, "part").select(F.col("p_partkey").alias("pos"), name.alias("brand"))
    return planning.first_seen(rows, F.lower("brand")).select("pos", F.lower("brand").alias("brand"))


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) * 2 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 3 AS planned FROM nation")
def planned_documents(s, d):
    c = T(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("projects"))
    a = T(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("areas"))
    n = T(s, d, "nation").join(c, "n_nationkey", "left").join(a, "n_nationkey", "left").fillna(0)
    return n.select("n_nationkey", planning.planned_documents({"p": F.col("projects"), "a": F.col("areas")}, {"p": F.lit(2), "a": F.lit(1)}, F.lit(3)).alias("planned"))


_WEEKS = f"WITH {views.TASKS}, u AS (SELECT DISTINCT item, day - dayofweek(day)::INT AS week FROM tasks WHERE NOT checked AND prior_tag = 'P3'), i AS (SELECT *, week - 7 * row_number() OVER (PARTITION BY item ORDER BY week)::INT AS island FROM u)"


@query(_WEEKS + " SELECT item, week, row_number() OVER (PARTITION BY item, island ORDER BY week) AS run FROM i")
def carried_run(s, d):
    open_ = views.tasks(s, d).where("NOT checked AND prior_tag = 'P3'").select("item", dates.week_start(F.col("day")).alias("week"))
    return matching.carried_run(open_).select("item", "week", "run")


_CARRY = f"WITH {views.LINES}, a AS (SELECT doc_id, norm FROM norms WHERE lang = 'de'), b AS (SELECT norm FROM daily WHERE lang = 'de'), m AS (SELECT a.*, EXISTS (SELECT 1 FROM b WHERE substr(a.norm, 1, 30) = substr(b.norm, 1, 30) AND {views.MATCH}) AS twice FROM a)"


def _carry(s, d):
    lines = views.lines(s, d, "lang = 'de'")
    return matching.carry_forward(lines, views.daily(lines))


@query(_CARRY + " SELECT doc_id FROM m WHERE NOT twice")
def carry_forward_kept(s, d):
    return _carry(s, d)[0].select("doc_id")


@query(_CARRY + " SELECT doc_id FROM m WHERE twice")
def carry_forward_dropped(s, d):
    return _carry(s, d)[1].select("doc_id")


# Changes to notes.

_STAGED = "a AS (SELECT s_nationkey AS k, '- [ ] Call ' || s_name || ' `[P' || (s_suppkey % 3 + 1) || ']`' AS line, s_suppkey % 90 AS p FROM supplier), n AS (SELECT k, string_agg(line, chr(10) ORDER BY p DESC, line) AS block FROM a GROUP BY k)"


@query(
    f"WITH {_STAGED} SELECT n_name AS section, CASE WHEN n.k IS NULL THEN 'Intro' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '#### Suggested' ELSE '' END WHEN n_nationkey % 2 = 0 THEN 'Intro' || chr(10) || '#### Suggested' || chr(10) || block || chr(10) ELSE 'Intro' || chr(10) || chr(10) || '#### Suggested' || chr(10) || block || chr(10) END AS text FROM nation LEFT JOIN n ON n.k = n_nationkey"
)
def stage_suggested(s, d):
    n = T(s, d, "nation")
    sections = n.select(F.col("n_name").alias("section"), F.concat(F.lit("Intro"), F.when(F.col("n_nationkey") % 2 == 0, "\n#### Suggested").otherwise("")).alias("text"))
    new = T(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("section"), F.concat(F.lit("Call "), "s_name").alias("text"), F.concat(F.lit("P"), (F.col("s_suppkey") % 3 + 1).cast("string")).alias("priority"), (F.col("s_suppkey") % 90).alias("p"))
    return planning.stage(sections, new.union(new))


@query("SELECT lower(p_name) AS norm FROM part WHERE p_size < 10 UNION ALL (SELECT DISTINCT lower(p_name) FROM part WHERE p_size >= 10 AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size < 10))")
def note_additions(s, d):
    p = T(s, d, "part").withColumn("norm", text.item_norm(F.col("p_name")))
    return planning.add_to_note(p.where("p_size < 10").select("norm"), p.where("p_size >= 10").select("norm")).select("norm")


@query("WITH done AS (SELECT DISTINCT 'ship ' || p_name AS norm FROM part WHERE p_size = 7) SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '  - [x] Ship ' || p_name || ' `[P1]`' WHEN 'ship ' || p_name IN (SELECT norm FROM done) THEN '  - [x] Ship ' || p_name || ' `[P1]`' ELSE '  - [ ] Ship ' || p_name || ' `[P1]`' END AS line FROM part")
def flip_lines(s, d):
    p = T(s, d, "part")
    box = F.when(F.col("p_size") % 3 == 0, "x").otherwise(" ")
    lines = p.select("p_partkey", F.concat(F.lit("  - ["), box, F.lit("] Ship "), "p_name", F.lit(" `[P1]`")).alias("line"))
    done = p.where("p_size = 7").select(text.item_norm(F.concat(F.lit("ship "), "p_name", F.lit("."))).alias("norm")).distinct()
    return planning.flip_lines(lines, done, text.item_norm).select("p_partkey", "line")


@query("WITH o AS (SELECT c_custkey, c_mktsegment AS v, c_custkey % 9 = 0 AS ended FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.ended THEN 'retire' WHEN o.c_custkey IS NULL THEN 'add' WHEN n.c_custkey IS NULL THEN 'keep' WHEN o.v = n.v THEN 'confirm' ELSE 'revise' END AS verb FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def memory_retire(s, d):
    c = T(s, d, "customer")
    old = c.where("c_custkey % 10 <> 0").select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = c.where("c_custkey % 11 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("v"))
    return reconcile.verbs(old, new, "c_custkey", "v", ended=c.where("c_custkey % 9 = 0").select("c_custkey"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS held FROM customer")
def stated_over_inferred(s, d):
    stated = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return T(s, d, "customer").select("c_custkey", reconcile.settle(stated, F.col("c_name")).alias("held"))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM documents")
def snapshot_full(s, d):
    """The weekly sweep, which lists what has not changed too."""
    new = T(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    old = new.where("path % 10 <> 0").withColumn("size", F.col("size") + F.when(F.col("path") % 7 == 0, 1).otherwise(0))
    return reconcile.changes(old, new, "path", ("size",), full=True)


@query("SELECT doc_id, 'verified' AS state FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'not on disk' FROM documents WHERE doc_id % 5 = 0")
def tag_then_verify(s, d):
    """Tags computed first, committed after, and read back: a note counts only if the disk holds them."""
    computed = T(s, d, "documents").select("doc_id", F.col("lang").alias("tag"))
    on_disk = computed.where("doc_id % 5 <> 0")
    return reconcile.verified(computed, on_disk, "doc_id").select("doc_id", "state")


# Counts.

@query("SELECT count(*) FILTER (event_type = 'view') AS live, count(*) FILTER (event_type = 'click') AS cache, count(*) FILTER (event_type = 'error') AS failed FROM events")
def call_stats(s, d):
    outcome = F.when(F.col("event_type") == "view", "live").when(F.col("event_type") == "click", "cache").when(F.col("event_type") == "error", "failed")
    return udf.call_stats(T(s, d, "events").select(outcome.alias("outcome")))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS n_failed FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') > 0")
def jobs_failed(s, d):
    return T(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_failed")).where("n_failed > 0")


@query("SELECT o_custkey, count(*) FILTER (role <> 'r-3') AS n_connected FROM (SELECT o_custkey, 'r-' || (o_orderkey % 5) AS role FROM orders) GROUP BY o_custkey")
def roles_connected(s, d):
    rows = T(s, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 5 == 3, "none").otherwise("tool").alias("source"))
    return rows.groupBy("o_custkey").agg(F.count_if((F.col("source") != "none") & (F.col("source") != "")).alias("n_connected"))


@query("SELECT c_custkey, array_to_string(list_filter(['chat', 'email', 'code'], lambda r: NOT (r = 'email' AND c_custkey % 2 = 0) AND NOT (r = 'code' AND c_custkey % 3 = 0)), ', ') AS roles FROM customer")
def roles_connected_list(s, d):
    source = lambda role, off: F.struct(F.lit(role).alias("role"), F.when(off, "none").otherwise("tool").alias("source"))
    held = F.array(source("chat", F.lit(False)), source("email", F.col("c_custkey") % 2 == 0), source("web", F.lit(False)), source("code", F.col("c_custkey") % 3 == 0))
    return T(s, d, "customer").select("c_custkey", text.connected_list(held, F.array(*map(F.lit, ("chat", "email", "code")))).alias("roles"))


@query("SELECT split_part(path, '/', 1) AS folder, count(*) AS n_files, count(DISTINCT path) AS n_dirs FROM (SELECT 'Skills/' || p_brand AS path FROM part UNION ALL SELECT 'Routines/' || c_mktsegment FROM customer) GROUP BY 1")
def machinery_counts(s, d):
    paths = T(s, d, "part").select(F.concat(F.lit("Skills/"), "p_brand").alias("path")).union(T(s, d, "customer").select(F.concat(F.lit("Routines/"), "c_mktsegment")))
    return paths.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("n_files"), F.countDistinct("path").alias("n_dirs"))


# The inbox.

@query("SELECT event_id FROM events WHERE user_id % 3 <> 0 AND ts > TIMESTAMP '2024-01-20 00:00:00' AND user_id % 5 <> 4")
def mail_addressed(s, d):
    to = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("ann"))).when(F.col("user_id") % 5 == 4, F.array(*map(F.lit, ("me", "ann", "bo", "cy")))).otherwise(F.array(F.lit("me"), F.lit("ann")))
    mail = T(s, d, "events").select("event_id", "ts", to.alias("to"))
    return inbox.addressed(mail, "me", F.lit("2024-01-20").cast("timestamp"), most=3).select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 6 NOT IN (0, 1) AND event_type <> 'view' AND NOT (event_type = 'click' AND value > 50)")
def mail_from_people(s, d):
    """Vendor mail dropped by address, category or bulk signal; unclear ones kept."""
    sender = F.when(F.col("user_id") % 6 == 0, "no-reply@x.org").when(F.col("user_id") % 6 == 1, "Alerts@x.org").when(F.col("user_id") % 6 == 2, "alertsmith@x.org").otherwise(F.lit(None).cast("string"))
    category = F.when(F.col("event_type") == "view", "Promotions").when(F.col("event_type") == "signup", "primary")
    bulk = F.when(F.col("event_type") == "click", F.col("value") > 50)
    return T(s, d, "events").where(~inbox.automated(sender, category, bulk)).select("event_id")


@query("SELECT conv_id, max(turn) AS last_at, count(*) AS n_messages FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) <> 'assistant'")
def mail_threads(s, d):
    m = T(s, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("ts"), F.col("role").alias("sender"))
    return inbox.threads(m, "assistant").select(F.col("thread").alias("conv_id"), "last_at", "n_messages")


@query("SELECT source, id, sent, row_number() OVER (ORDER BY sent DESC, source, id) AS place FROM (SELECT 'chat' AS source, conv_id AS id, turn AS sent FROM conversations UNION ALL SELECT 'email', event_id, user_id FROM events WHERE event_type = 'signup') ORDER BY place LIMIT 200")
def communication_newest_first(s, d):
    """The merged list in its order; the first two hundred, with their places."""
    from pyspark.sql.window import Window

    chat = T(s, d, "conversations").select(F.lit("chat").alias("source"), F.col("conv_id").alias("id"), F.col("turn").alias("sent"))
    mail = T(s, d, "events").where("event_type = 'signup'").select(F.lit("email").alias("source"), F.col("event_id").alias("id"), F.col("user_id").alias("sent"))
    return inbox.newest_first(chat, mail, ts="sent").limit(200).withColumn("place", F.row_number().over(Window.orderBy(F.desc("sent"), "source", "id")).cast("long"))


# The news.

_NEWS = "i AS (SELECT event_id, user_id AS story, 'http://n.example/' || event_id AS url, ts, value FROM events WHERE event_type IN ('view', 'click') AND user_id % 4 <> 3 AND ts > TIMESTAMP '2024-01-18 07:30:00' AND ts <= TIMESTAMP '2024-01-20 07:30:00' AND event_id % 10 <> 0), b AS (SELECT * FROM i WHERE value > 20 AND story NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-03 00:00:00') QUALIFY row_number() OVER (PARTITION BY story ORDER BY value DESC, url) = 1)"


@query(f"WITH {_NEWS} SELECT story, url, value AS score FROM b ORDER BY value DESC, story LIMIT 7")
def news_brief(s, d):
    e = T(s, d, "events")
    seen = e.where("event_type IN ('view', 'click') AND user_id % 4 <> 3")
    items = seen.select(F.col("user_id").alias("story"), F.lit("t").alias("title"), F.concat(F.lit("http://n.example/"), "event_id").alias("url"), F.col("ts").alias("published"), F.when(F.col("event_id") % 10 != 0, "d").alias("description"), "value")
    now, last = F.lit("2024-01-20 07:30:00").cast("timestamp"), F.lit("2024-01-18 07:30:00").cast("timestamp")
    shown = e.where("event_type = 'error' AND ts <= '2024-01-03'").select(F.col("user_id").alias("story"))
    return inbox.news(items, dates.news_floor(now, last), now, F.col("value") > 20, F.col("value"), shown).select("story", "url", "score")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'http://original.example/' || event_id ELSE 'http://n.example/' || event_id END AS url FROM events")
def news_originals(s, d):
    e = T(s, d, "events").select("event_id", F.concat(F.lit("http://n.example/"), "event_id").alias("url"))
    originals = e.where("event_id % 4 = 0").select("url", F.concat(F.lit("http://original.example/"), "event_id").alias("original"))
    return inbox.redirected(e, originals).select("event_id", "url")


# Tags.

@query(
    f"WITH {views.PART_TAGS}, v AS (SELECT tag, count(*) AS n, array_to_string(list_sort(list_distinct(string_split(tag, '/'))), '/') AS key FROM part_tags GROUP BY tag), pairs AS (SELECT a.tag AS tag1, b.tag AS tag2, a.n AS n1, b.n AS n2, ascii(a.tag) % 2 = 0 AS c1, ascii(b.tag) % 2 = 0 AS c2 FROM v AS a JOIN v AS b ON a.key = b.key AND a.tag < b.tag), w AS (SELECT *, (c1 AND NOT c2) OR (c1 = c2 AND n1 >= n2) AS first FROM pairs) SELECT CASE WHEN first THEN tag2 ELSE tag1 END AS from_tag, CASE WHEN first THEN tag1 ELSE tag2 END AS to_tag FROM w"
)
def lint_merge_plan_canon(s, d):
    vocab = views.part_tags(s, d).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.merge_plan(tags.reordered(vocab), vocab, vocab.where("ascii(tag) % 2 = 0"))


@query(f"WITH {views.PART_TAGS}, v AS (SELECT tag, count(*) AS n, array_to_string(list_sort(list_distinct(string_split(tag, '/'))), '/') AS key FROM part_tags GROUP BY tag), p AS (SELECT CASE WHEN a.n >= b.n THEN b.tag ELSE a.tag END AS f, CASE WHEN a.n >= b.n THEN a.tag ELSE b.tag END AS t FROM v AS a JOIN v AS b ON a.key = b.key AND a.tag < b.tag) SELECT 'tag-merge' AS action, t AS path, f || ' -> ' || t || ' (frequency)' AS summary FROM p")
def lint_merge_log(s, d):
    vocab = views.part_tags(s, d).groupBy("tag").agg(F.count("*").alias("n"))
    return tags.log_lines(tags.merge_plan(tags.reordered(vocab), vocab), "frequency")


@query("SELECT tag FROM (SELECT p_brand AS tag FROM part UNION SELECT 'machinery-' || r_name FROM region)")
def vocab_seeded(s, d):
    return T(s, d, "part").select(F.col("p_brand").alias("tag")).union(T(s, d, "region").select(F.concat(F.lit("machinery-"), "r_name"))).distinct()


@query(f"WITH {views.TASKS} SELECT item, CASE WHEN bool_or(day >= {_TODAY} - 2) THEN 'P1' ELSE 'P2' END AS priority FROM tasks GROUP BY item")
def rnk_without_priorities(s, d):
    """Without a priorities file only deadlines and the calendar speak; there is no prior tag."""
    t = views.tasks(s, d).groupBy("item").agg(F.max(F.col("day") >= F.date_sub(_today(), 2)).alias("soon"))
    return t.select("item", ranking.priority_tag(F.col("soon"), F.lit(False)).alias("priority"))


@query("SELECT p_partkey, array_to_string(list_filter(['lang', p_brand, p_type], lambda x: x <> 'ECONOMY'), '|') AS parts FROM part")
def csv_and_scalar_lists(s, d):
    raw = F.concat(F.lit(" lang , "), "p_brand", F.lit(",,"), F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_type")))
    many, one = arrays.csv_list(raw), arrays.as_list(F.concat(F.lit("["), raw, F.lit("]")))
    return T(s, d, "part").where(F.array_join(many, "|") == F.array_join(one, "|")).select("p_partkey", F.array_join(many, "|").alias("parts"))
