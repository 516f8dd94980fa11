"""Registered queries that write a vault's files and read them again, each with its SQL twin.

What they write lies in the folder all executors share, a new one each time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import reconcile
from ..session import scratch
from ..session import table as T
from ..sources import enex, sinks, vault
from .note_queries import fill
from .registry import query

_S = "n AS (SELECT s_suppkey AS k, s_name, CASE s_suppkey % 4 WHEN 0 THEN 'Projects/P' || (s_suppkey % 3) WHEN 1 THEN 'Areas/A b' WHEN 2 THEN 'Resources/Meetings' ELSE 'Clippings' END AS folder FROM supplier)"


def _vault(s, d) -> str:
    """A vault with a note per supplier, and files that no scan must take for notes."""
    k = F.col("s_suppkey")
    folder = F.when(k % 4 == 0, F.concat(F.lit("Projects/P"), k % 3)).when(k % 4 == 1, "Areas/A b").when(k % 4 == 2, "Resources/Meetings").otherwise("Clippings")
    day = F.when(k % 4 == 2, F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).cast("string"), F.lit(" "))).otherwise("")
    body = F.concat(F.lit("Body of "), "s_name", F.lit("\n"))
    tags = F.array(F.lit("a"), F.concat(F.lit("n/"), F.col("s_nationkey").cast("string")))
    content = sinks.note_text(body, tags, F.lit("2024-01-01"), F.when(k % 3 != 0, text.body_hash(body)).otherwise("stale"), F.lit("note"))
    notes = T(s, d, "supplier").select(F.concat(folder, F.lit("/"), day, "s_name", F.lit("+1.md")).alias("path"), content.alias("content"))
    root = scratch(s, "vault")
    others = s.createDataFrame([("README.md", "x"), ("Projects/README.md", "x"), ("Projects/notes.txt", "x"), (".system/log/x.md", "x"), ("Skills/skill.md", "x")], "path string, content string")
    sinks.write_files(notes.union(others), root)
    return root


_PATH = "folder || '/' || CASE WHEN k % 4 = 2 THEN (DATE '2024-01-01' + (k % 30)::INT)::VARCHAR || ' ' ELSE '' END || s_name || '+1.md'"


@query(f"WITH {_S} SELECT {_PATH} AS path, split_part(folder, '/', 1) || CASE WHEN contains(folder, '/') THEN '/' || split_part(folder, '/', 2) ELSE '' END AS domain, k % 3 <> 0 AS fresh FROM n UNION ALL SELECT 'Projects/README.md', 'Projects', NULL")
def vault_scan(s, d):
    """Content folders only; names with blanks and plus signs are read as they are."""
    p = vault.scan_notes(s, _vault(s, d))
    return p.select("path", "domain", (F.col("tagged_hash") == F.col("body_hash")).alias("fresh"))


@query(f"WITH {_S} SELECT {_PATH} AS path FROM n WHERE k % 4 IN (0, 1)")
def vault_scan_seeded(s, d):
    """Projects and areas, without the documents that tagging leaves alone."""
    return vault.scan_notes(s, _vault(s, d), vault.SEED_FOLDERS, taggable_only=True).select("path")


@query(f"WITH {_S} SELECT {_PATH} AS path, DATE '2024-01-01' + (k % 30)::INT AS day FROM n WHERE k % 4 = 2 AND k % 30 BETWEEN 4 AND 19")
def vault_dated(s, d):
    return vault.dated(vault.scan_notes(s, _vault(s, d)), "Resources/Meetings", F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date")).select("path", "day")


@query(f"WITH {_S} SELECT (DATE '2024-01-01' + (k % 30)::INT)::VARCHAR || ' ' || s_name || '+1' AS title FROM n WHERE k % 4 = 2")
def vault_titles(s, d):
    return vault.titles(vault.scan_notes(s, _vault(s, d)), "Resources/Meetings")


@query(f"WITH {_S} SELECT {_PATH} AS path FROM n WHERE k % 3 = 0")
def vault_drifted(s, d):
    return reconcile.needs_tagging(vault.scan_notes(s, _vault(s, d), taggable_only=True), F.col("body_hash")).select("path")


@query("SELECT 'Projects' AS found")
def vault_first_existing(s, d):
    root = _vault(s, d)
    found = vault.first_existing(s, [f"{root}/{x}" for x in ("tags.md", "Projects", "Areas")])
    return s.createDataFrame([(found.rsplit("/", 1)[-1],)], "found string")


@query("SELECT 'new ' || r_name AS now, 'old ' || r_name AS before FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'old ' || r_name, NULL FROM region WHERE r_regionkey % 2 = 1")
def backup_before_overwrite(s, d):
    """A file that changes is kept beside the new one; one that doesn't is left alone."""
    root = scratch(s, "backup")
    rows = lambda word: T(s, d, "region").select("r_regionkey", F.concat("r_name", F.lit(".md")).alias("path"), F.concat(F.lit(word), "r_name").alias("content"))
    sinks.write_files(rows("old "), root)
    sinks.write_files(rows("new ").where("r_regionkey % 2 = 0").union(rows("old ").where("r_regionkey % 2 = 1")), root)
    files = s.read.text(root, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.md(\.bak)?$", 1).alias("name"), F.col("_metadata.file_path").endswith(".bak").alias("bak"), "value")
    return files.groupBy("name").agg(F.max(F.when(~F.col("bak"), F.col("value"))).alias("now"), F.max(F.when(F.col("bak"), F.col("value"))).alias("before")).drop("name")


@query("SELECT count(*) AS n_denied FROM region WHERE r_regionkey = 0")
def write_denied(s, d):
    """A path that fits a denied pattern fails the job before anything of that row is written."""
    rows = T(s, d, "region").where("r_regionkey = 0").select(F.lit("Resources/Meetings/x.md").alias("path"), F.lit("x").alias("content"))
    try:
        sinks.write_files(rows, scratch(s, "deny"), deny=("Resources/Meetings/*",))
    except Exception as error:  # noqa: BLE001 - Spark wraps what the task raised
        if "PermissionError" not in str(error):
            raise
        return rows.agg(F.count("*").alias("n_denied"))
    return rows.limit(0).agg(F.count("*").alias("n_denied"))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type AS action, date_trunc('second', ts) AS ts, 'p/' || user_id AS path, 'a/b ' || event_id AS summary FROM events")
def log_round_trip(s, d):
    """Actions appended to month files, a line each, and read again."""
    folder = scratch(s, "log")
    rows = T(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), F.concat(F.lit("p/"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("a|b\n"), F.col("event_id").cast("string")).alias("summary"))
    sinks.append_log(rows.where("action = 'error'"), folder)
    sinks.append_log(rows.where("action <> 'error'"), folder)
    back = vault.parse_log(s.read.text(folder).select("value", "month"))
    return back.select(F.date_format(F.to_date("month", "yyyy-MM"), "yyyy-MM").alias("month") if dict(back.dtypes)["month"] == "date" else "month", "action", "ts", "path", "summary")


@query("SELECT 'log-2024-0' || (r_regionkey % 2 + 1) AS file, count(*) AS n, count(*) FILTER (r_regionkey = 3) AS n_broken FROM region WHERE r_regionkey % 2 = 1 GROUP BY 1")
def log_months(s, d):
    """Only the files of the months asked for are read; a line of other than four fields keeps its text and has no fields."""
    root = scratch(s, "months")
    r = T(s, d, "region")
    line = F.when(F.col("r_regionkey") == 3, "2024-01-01T00:00:00|a|b").otherwise(F.concat(F.lit("2024-01-01T00:00:00|a|b|"), "r_name"))
    files = r.groupBy((F.col("r_regionkey") % 2).alias("m")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("content"))
    sinks.write_files(files.select(F.concat(F.lit("log-2024-0"), F.col("m") + 1, F.lit(".csv")).alias("path"), "content"), root)
    got = vault.scan_log(s, root, ["2024-02"])
    return got.groupBy(F.concat(F.lit("log-"), "month").alias("file")).agg(F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("n_broken"))


@query("SELECT 'v' || r_regionkey AS vault, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'offline' ELSE 'live' END AS mode, '2024-01-0' || (r_regionkey + 1) AS anchor_date FROM region")
def sandbox_manifests(s, d):
    root = scratch(s, "sandboxes")
    k = F.col("r_regionkey")
    whole = F.to_json(F.struct(F.lit("x").alias("kind"), F.concat(F.lit("2024-01-0"), k + 1).alias("anchor_date"), F.struct(F.col("r_name").alias("name")).alias("persona"), F.struct(F.when(k % 2 == 0, "offline").otherwise("live").alias("mode")).alias("generation")))
    sinks.write_files(T(s, d, "region").select(F.concat(F.lit("v"), k, F.lit("/.sandbox-manifest.json")).alias("path"), F.regexp_replace(whole, ",", ",\n  ").alias("content")), root)
    paths = [f"{root}/v{r['r_regionkey']}/.sandbox-manifest.json" for r in T(s, d, "region").select("r_regionkey").collect()]
    return vault.scan_sandbox_manifests(s, paths).select("vault", "name", "mode", "anchor_date")


@query("SELECT p_partkey AS pos, p_name AS first, p_brand AS second, '' AS third FROM part")
def persona_records(s, d):
    rows = T(s, d, "part").select(F.lit("people").alias("kind"), F.col("p_partkey").alias("pos"), F.concat(F.lit(" "), "p_name", F.lit(" |"), "p_brand").alias("record"))
    return vault.persona_records(rows).select("pos", "first", "second", "third")


@query("SELECT * FROM (VALUES ('email'), ('seed'), ('projects')) AS v(missing)")
def persona_missing(s, d):
    scalars = s.createDataFrame([("id", "x"), ("name", "y"), ("email", " "), ("vault", "v"), ("seed", None), ("tz", "UTC")], "key string, value string")
    return vault.persona_missing(scalars, s.createDataFrame([("areas", 1, "a|b")], "kind string, pos int, record string"))


_NOTE = """<note><title>{T}</title><created>20240101T000000Z</created><updated>{U}</updated><tag>Big  Tag</tag><tag> </tag><tag>x{K}</tag>
<content><![CDATA[<?xml version="1.0"?><!DOCTYPE en-note SYSTEM "e"><en-note><p>About {N}</p><en-media hash="{H}" type="image/png"/><en-media hash="{J}"/><en-media type="x"/></en-note>]]></content>
<resource><data encoding="base64">{B}
</data><mime>image/png</mime><resource-attributes><file-name>pic.png</file-name></resource-attributes></resource>
<resource><data encoding="base64">!!!</data><mime>text/plain</mime></resource>
<resource><data>{C}</data></resource></note>
"""


def _archive(s, d):
    """An export file per nation with a note per supplier."""
    root = scratch(s, "archive")
    k = F.col("s_suppkey")
    pic, other = F.concat(F.lit("pic"), k.cast("string")), F.concat(F.lit("raw"), k.cast("string"))
    b64 = lambda c: F.base64(F.encode(c, "utf-8"))
    note = fill(_NOTE, T=F.when(k % 3 == 0, "Same").when(k % 3 == 1, "").otherwise(F.concat(F.lit("A/b: "), "s_name")), U=F.when(k % 2 == 0, "20240102T030405Z").otherwise("soon"), K=k, N=F.col("s_name"), H=F.upper(F.md5(F.encode(pic, "utf-8"))), J=F.when(k % 4 == 0, "00ff").otherwise(F.md5(F.encode(other, "utf-8"))), B=b64(pic), C=b64(other))
    docs = T(s, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), note.alias("note")))), lambda x: x["note"]), "").alias("notes"))
    sinks.write_files(docs.select(F.concat(F.lit("n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"), F.lit(".enex")).alias("path"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<en-export>\n'), "notes", F.lit("</en-export>\n")).alias("content")), root)
    return enex.convert(enex.read(s, root))


_NAMED = "o AS (SELECT s_suppkey AS k, s_name, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS no FROM supplier), b AS (SELECT *, CASE k % 3 WHEN 0 THEN 'Same' WHEN 1 THEN 'Untitled Note' ELSE 'A-b- ' || replace(s_name, '#', '-') END AS base FROM o), m AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY no) AS r FROM b), named AS (SELECT *, base || CASE WHEN r = 1 THEN '' ELSE ' (' || r || ')' END AS name FROM m)"


@query(f"WITH {_NAMED} SELECT no::INT AS note_no, name, '2024-01-01 00:00:00' AS created, CASE WHEN k % 2 = 0 THEN '2024-01-02 03:04:05' ELSE 'soon' END AS updated, 'big-tag|x' || k AS tags FROM named")
def archive_notes(s, d):
    return _archive(s, d)[0].select("note_no", "name", "created", "updated", F.array_join("tags", "|").alias("tags"))


_FILES = f"{_NAMED}, f AS (SELECT no, name, 0 AS idx, md5('pic' || k) AS md5, CASE WHEN no = 1 THEN 'pic.png' ELSE 'pic-' || substr(md5('pic' || k), 1, 6) || '.png' END AS file FROM named UNION ALL SELECT no, name, 2, md5('raw' || k), name || '-attachment-2.bin' FROM named)"


@query(f"WITH {_FILES} SELECT no::INT AS note_no, idx, md5, file FROM f")
def archive_attachments(s, d):
    return _archive(s, d)[1].select("note_no", "idx", "md5", "file")


@query(f"WITH {_FILES} SELECT n.no::INT AS note_no, 'About ' || s_name || chr(10) || chr(10) || '![[' || p.file || ']]' || chr(10) || chr(10) || CASE WHEN k % 4 = 0 THEN '*[missing attachment: 00ff]*' ELSE '[[' || r.file || ']]' END || chr(10) AS body FROM named AS n JOIN f AS p ON n.no = p.no AND p.idx = 0 JOIN f AS r ON n.no = r.no AND r.idx = 2")
def archive_bodies(s, d):
    return _archive(s, d)[0].select("note_no", "body")


@query(f"WITH {_FILES} SELECT 'attachments/' || file AS path, (3 + length((SELECT k FROM named WHERE named.no = f.no)::VARCHAR))::BIGINT AS size FROM f")
def archive_files_written(s, d):
    """The attachments on disk, under their names; of those of one name, all but one lie in folders of their own."""
    root = scratch(s, "files")
    sinks.write_files(sinks.attachment_files(_archive(s, d)[1]), root)
    found = s.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.concat(F.lit("attachments/"), F.url_decode(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\+", "%2B"))).alias("path"), F.col("length").alias("size"))


@query("SELECT DISTINCT o_orderdate::DATE AS day, 'Resources/Plans/' || year(o_orderdate::DATE - dayofweek(o_orderdate)::INT) || '/Weekly/Weekly Planning ' || strftime(o_orderdate::DATE - dayofweek(o_orderdate)::INT, '%-m-%-d-%Y') || ' to ' || strftime(o_orderdate::DATE - dayofweek(o_orderdate)::INT + 6, '%-m-%-d-%Y') || '.md' AS path FROM orders")
def weekly_plan_paths(s, d):
    """The path of the week's plan for each day, weeks across a year's end included."""
    day = F.to_date("o_orderdate")
    path = F.concat(F.lit("Resources/Plans/"), F.year(dates.week_start(day)).cast("string"), F.lit("/Weekly/"), dates.weekly_plan_name(day), F.lit(".md"))
    return T(s, d, "orders").select(day.alias("day"), path.alias("path")).distinct()
