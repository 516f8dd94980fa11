"""Sources, functions and operators on hand-written rows."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from notelake.functions import dates, text
from notelake.operators import classify, ranking, reconcile, search, tags, udf
from notelake.sources import enex, sinks, vault


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture
def root(tmp_path):
    files = {
        "Projects/Alpha/Plan one.md": "---\ntags:\n  - work\n  - work/plan\ntype: note\n---\n# Goals\n- [ ] Send the draft by Friday `[P1]`\n- [x] done it (due today)\n### Sub\n- [ ] nested\n## Next\nSee [[Beta|b]] and ![[pic.png]] [[Gone#a]]\n",
        "Areas/b+c.md": "no frontmatter\r\nline",
        "Resources/unclosed.md": "---\ntags: x\nbody only",
        "Archive/empty.md": "---\n---\nbody",
        "Clippings/scalar.md": "---\ntags: solo\nsource: [a, 'b']\n---\ntext",
        "Projects/README.md": "skip me",
        ".system/x.md": "hidden",
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    return str(tmp_path)


def test_scan_and_frontmatter(spark, root):
    rows = {r["path"]: r for r in vault.scan_notes(spark, root, taggable_only=True).collect()}
    assert set(rows) == {"Projects/Alpha/Plan one.md", "Areas/b+c.md", "Resources/unclosed.md", "Archive/empty.md", "Clippings/scalar.md"}
    plan = rows["Projects/Alpha/Plan one.md"]
    assert plan["tags"] == ["work", "work/plan"] and plan["type"] == "note" and plan["domain"] == "Projects/Alpha"
    assert rows["Areas/b+c.md"]["body"] == "no frontmatter\nline"
    assert not rows["Resources/unclosed.md"]["has_frontmatter"]
    assert rows["Archive/empty.md"]["has_frontmatter"] and rows["Archive/empty.md"]["body"] == "body"
    assert rows["Clippings/scalar.md"]["tags"] == ["solo"] and rows["Clippings/scalar.md"]["frontmatter"]["source"] == ["a", "b"]
    assert rows["Archive/empty.md"]["body_hash"] == hashlib.sha256(b"body").hexdigest()[:16]


def test_sections_items_links(spark, root):
    from notelake.operators import graph

    notes = vault.scan_notes(spark, root)
    found = [(r["h1"], r["h3"], r["level"], r["title"]) for r in vault.sections(notes).where("path LIKE '%Plan%'").orderBy("ordinal").collect()]
    assert found == [("Goals", None, 1, "Goals"), ("Goals", "Sub", 3, "Sub"), ("Goals", None, 2, "Next")]
    items = vault.items(notes).orderBy("pos").collect()
    assert [(i["checked"], i["priority"], i["due_today"], i["subsection"]) for i in items] == [(False, "P1", False, None), (True, None, True, None), (False, None, False, "Sub")]
    edges = graph.wikilinks(notes)
    assert {(r["target"], r["is_embed"]) for r in edges.collect()} == {("Beta", False), ("pic.png", True), ("Gone", False)}


def test_tables_records_and_logs(spark):
    doc = spark.createDataFrame([("r", "| Role | Source | Notes |\n|---|---|---|\n| chat | Slack-like | a \\| b |\n| web | none |  |\n- name | kind | what\n  - kid | k | d\n  - Key: v\n- `only`\n- Mail: x | y | z\n1. first\n2. second\n| `plan` | `chat` | pull → land | always |")], "path string, body string")
    assert {(r["role"], r["source"], r["notes"]) for r in vault.registry(doc).collect()} == {("chat", "Slack-like", "a | b"), ("web", "none", "")}
    assert [r["name"] for r in vault.records(doc).orderBy("pos").collect()] == ["name", "only", "Mail: x"]
    assert [(r["parent"], r["name"]) for r in vault.children(doc).collect()] == [("name", "kid")]
    assert [(r["role"], r["source"], r["notes"]) for r in vault.template_roles(doc).collect()] == [("email", "x", "y | z")]
    assert [r["item"] for r in vault.numbered(doc).orderBy("ordinal").collect()] == ["first", "second"]
    assert [tuple(r)[0:2] for r in vault.who_reads_what(doc).collect()] == [("plan", "chat")]
    raw = spark.createDataFrame([("2024-01-02T03:04:05|a|p|\"s", "2024-01"), ("x|y|z", "2024-01"), ("a|b|c|d|e", "2024-01")], "value string, month string")
    assert sorted((r["n_fields"], r["summary"]) for r in vault.parse_log(raw).collect() if r["n_fields"] == 4) == [(4, '"s')]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.slug(lit(" Weekly Plan: #2! "))) == "weekly-plan-2"
    assert one(spark, text.sanitize_filename(lit('  a/b:  "c"  '))) == "a-b- -c-"
    assert one(spark, text.sanitize_filename(lit("  "))) == "untitled"
    assert one(spark, text.enex_date(lit("20230115T182233Z"))) == "2023-01-15 18:22:33"
    assert one(spark, text.enex_date(lit("soon"))) == "soon"
    assert one(spark, text.item_norm(lit("Send  the *draft*, (due today) `[P2]`"))) == "send the draft"
    assert one(spark, text.yaml_escape(lit('a"b\\c'))) == '"a\\"b\\\\c"'
    assert one(spark, text.strip_fence(lit("```md\nbody\n```"))) == "body"
    assert one(spark, text.strip_comments(lit("a<!-- x\ny -->b<!-- open"))) == "ab"
    assert one(spark, text.role_alias(lit("Mail (work)"))) == "email"


def test_sanitize_filename_sees_the_whole_text(spark, tmp_path):
    from notelake.plans.queries import QUERIES

    spark.createDataFrame([(1, " " * 500 + "a  name"), (2, "a" + " " * 500 + "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["name"] for r in QUERIES["sanitize_filename"](spark, str(tmp_path)).collect()} == {1: "a name", 2: "a b"}


def test_dates(spark):
    d = F.lit(dt.date(2026, 1, 1))
    assert one(spark, dates.week_start(d)) == dt.date(2025, 12, 28)
    name = one(spark, dates.weekly_plan_name(d))
    assert name == "Weekly Planning 12-28-2025 to 1-3-2026"
    assert one(spark, dates.weekly_plan_start(F.lit(name + ".md"))) == dt.date(2025, 12, 28)
    assert one(spark, dates.weekly_plan_start(F.lit("Weekly Planning 1-1-2026 to 1-7-2026"))) is None
    assert one(spark, dates.business_days_back(F.lit(dt.date(2026, 1, 5)), 3)) == [dt.date(2026, 1, 5), dt.date(2026, 1, 2), dt.date(2026, 1, 1)]
    for said, cron in (("every weekday at 7:30am", "30 7 * * 1-5"), ("Tuesdays", "0 6 * * 2"), ("daily at 4pm", "0 16 * * *"), ("weekly", "0 6 * * 0")):
        assert one(spark, dates.cron_of(F.lit(said))) == cron
    assert one(spark, dates.cron_of(F.lit("Tuesdays"), strict_reference=True)) == "0 6 * * *"


def test_ranking_bounds_and_flags(spark):
    lit = F.lit
    assert one(spark, ranking.completion(lit("P1"), lit(True), lit(True), lit(0), lit(1.0))) == 97
    assert one(spark, ranking.completion(lit("P3"), lit(False), lit(False), lit(9), lit(0.0))) == 5
    assert one(spark, ranking.completion(lit("P2"), lit(False), lit(True), lit(None).cast("int"), lit(None).cast("double"))) == 55
    assert one(spark, ranking.mismatch(lit("P1"), lit(30))) == "stuck"


def test_gate_on_labelled_candidates(spark):
    rows = [
        ("Send the revised budget to Dana by Friday", False, True), ("Review pull request 41 today", False, True), ("Book the venue before 2026-03-01", False, True),
        ("Draft the release notes by tomorrow", False, True), ("Fix the login redirect by Wed", False, True), ("ping ops re: certs", True, True), ("q3 deck", True, True),
        ("things and stuff", False, False), ("it was discussed and then also noted; maybe", False, False), ("ws3", False, False),
    ]
    df = spark.createDataFrame(rows, "text string, shorthand boolean, want boolean")
    assert classify.gate(classify.score(df), F.col("shorthand")).where("kept <> want").count() == 0


def test_tags_and_reconcile(spark):
    vocab = spark.createDataFrame([("color", 5), ("colour", 2), ("a/b", 3), ("b/a", 3), ("x", 1), ("kitten", 1), ("sitten", 2)], "tag string, n long")
    found = {tuple(r)[:2] for r in tags.edit_distance(vocab, 2, 5).collect()}
    assert found == {("color", "colour"), ("kitten", "sitten")}
    plan = {tuple(r) for r in tags.merge_plan(tags.reordered(vocab), vocab).collect()}
    assert plan == {("b/a", "a/b")}
    same = spark.createDataFrame([("p", 1, 2)], "path string, mtime int, size int")
    assert reconcile.changes(same, same).count() == 0
    planned = spark.createDataFrame([("write the report", False), ("done already", True)], "norm string, checked boolean")
    done = spark.createDataFrame([("write the report",)], "norm string")
    once = reconcile.flip_completed(planned, done)
    assert once.where("NOT checked").count() == 0
    assert sorted(reconcile.flip_completed(once, done).collect()) == sorted(once.collect())
    run, rest = reconcile.with_ceiling(spark.range(10), 3, [F.col("id")])
    assert run.count() == 3 and rest.count() == 7


def test_search_language(spark):
    notes = spark.createDataFrame([("A/x.md", "x.md", "# H\nred apple\n- [ ] buy Pears\n\nblue sky", ["t/u"], {"k": ["5"]}), ("B/y.md", "y.md", "red\napple", ["tu"], {})], "path string, name string, body string, tags array<string>, frontmatter map<string,array<string>>")
    for q, want in (("line:(red apple)", ["A/x.md"]), ("red apple", ["A/x.md", "B/y.md"]), ("tag:t", ["A/x.md"]), ("red -sky", ["B/y.md"]), ("task-todo:pears", ["A/x.md"]), ("task-done:pears", []), ("match-case:pears", []), ("[k:<9]", ["A/x.md"]), ("[k]", ["A/x.md"]), ("path:B OR sky", ["A/x.md", "B/y.md"]), ("/r.d\\s+apple/", ["A/x.md", "B/y.md"]), ("block:(blue sky)", ["A/x.md"])):
        assert sorted(r["path"] for r in search.search(notes, q).collect()) == want, q
    with pytest.raises(ValueError):
        search.compile_query("(a")


def test_sinks(spark, tmp_path):
    doc = F.lit("# A\n\nold\n\n## Sub\n\n# B\n\nkeep\n")
    assert one(spark, sinks.splice(doc, "# A", F.lit("new"))) == "# A\n\nnew\n\n# B\n\nkeep\n"
    assert one(spark, sinks.splice(doc, "# C", F.lit("new"))).endswith("keep\n\n# C\n\nnew\n\n")
    assert one(spark, sinks.strip_section(doc, "# A")) == "# B\n\nkeep\n"
    files = spark.createDataFrame([("Projects/n.md", "one")], "path string, content string")
    sinks.write_files(files, str(tmp_path))
    sinks.write_files(files.withColumn("content", F.lit("two")), str(tmp_path))
    assert (tmp_path / "Projects/n.md").read_text() == "two" and (tmp_path / "Projects/n.md.bak").read_text() == "one"
    with pytest.raises(Exception, match="PermissionError"):
        sinks.write_files(files, str(tmp_path), deny=("Projects/*",))
    body = F.lit("b")
    assert one(spark, sinks.note_text(body, F.array(F.lit("t")), F.lit("2026-01-01"), F.lit("h"), F.lit("note"))) == "---\ntags:\n  - t\ntagged: 2026-01-01\ntagged_hash: h\ntype: note\n---\nb"


def test_enex(spark, tmp_path):
    data = base64.b64encode(b"png").decode()
    md5 = hashlib.md5(b"png").hexdigest()
    note = f"<note><title>A/b</title><content><![CDATA[<?xml version=\"1.0\"?><en-note><h1>T</h1><p>x <b>y</b></p><en-media hash=\"{md5.upper()}\" type=\"image/png\"/><en-media hash=\"00ff\"/><a href=\"evernote:///v\">Other: one</a></en-note>]]></content><created>20230115T182233Z</created><tag>My Tag</tag><resource><data>{data}</data><mime>image/png</mime></resource><resource><data>!!</data></resource></note>"
    (tmp_path / "a.enex").write_text(f"<en-export>{note}{note}<note><title>A-b (2)</title></note></en-export>")
    notes, files = enex.convert(enex.read(spark, str(tmp_path)))
    got = {r["name"]: r for r in notes.collect()}
    assert set(got) == {"A-b", "A-b (3)", "A-b (2)"}
    body = got["A-b"]["body"]
    assert "# T" in body and "**y**" in body and "![[" in body and "*[missing attachment: 00ff]*" in body and "[[Other- one]]" in body
    assert got["A-b"]["created"] == "2023-01-15 18:22:33" and got["A-b"]["tags"] == ["my-tag"]
    assert len({r["file"] for r in files.collect()}) == 2


def test_model_column(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    out = udf.model_column(df, "prompt", lambda t: None if t == "b" else t * 3, stub=lambda t: "stub")
    assert {tuple(r) for r in out.collect()} == {("a", "aaa"), ("b", "stub")}
