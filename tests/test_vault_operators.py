"""Vault operators that a query's SQL can't show: matching against its rule, guards, the engine's passes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notelake import session
from notelake.functions import dates, text
from notelake.operators import engine, matching, planning, reconcile
from notelake.sources import enex, sinks


def rule(a, b):
    return a is not None and b is not None and (a == b or (min(len(a), len(b)) >= 30 and (a.startswith(b) or b.startswith(a))))


def test_matching_against_its_rule(spark):
    r = random.Random(3)
    base = ["".join(r.choice("ab") for _ in range(80)) for _ in range(3)]
    lines = lambda n: [r.choice(base)[: r.choice([5, 28, 29, 30, 31, 45, 80])] + r.choice(["", "", "é", "x" * 20]) for _ in range(n)] + [None, "", base[0]]
    left, right = lines(60), lines(50)
    lf = spark.createDataFrame(list(enumerate(left)), "i long, norm string")
    rf = spark.createDataFrame(list(enumerate(right)), "j long, norm string")
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if rule(a, b)}
    pairs = matching.match_items(lf, rf).select("i", "r_j").collect()
    assert len(pairs) == len(want) and {tuple(p) for p in pairs} == want
    hit = {i for i, _ in want}
    assert {x["i"] for x in matching.match_items(lf, rf, "left_semi").collect()} == hit
    assert {x["i"] for x in matching.match_items(lf, rf, "left_anti").collect()} == set(range(len(left))) - hit
    flipped = reconcile.flip_completed(lf.withColumn("checked", F.lit(False)), rf)
    assert {x["i"] for x in flipped.collect() if x["checked"]} == hit and flipped.count() == len(left)
    assert matching.match_items(lf.limit(0), rf).count() == 0 and matching.match_items(lf, rf.limit(0), "left_anti").count() == len(left)


def test_a_flip_changes_nothing_but_the_box(spark):
    rows = ["- [ ] Ship it `[P1]`", "    - [ ] ship it", "- [x] Ship it", "- [ ] Other", "text - [ ] Ship it", ""]
    lines = spark.createDataFrame(list(enumerate(rows)), "pos long, line string")
    done = spark.createDataFrame([("ship it",)], "norm string")
    got = [x["line"] for x in planning.flip_lines(lines, done, text.item_norm).orderBy("pos").collect()]
    assert got == ["- [x] Ship it `[P1]`", "    - [x] ship it", *rows[2:]]
    again = planning.flip_lines(spark.createDataFrame(list(enumerate(got)), "pos long, line string"), done, text.item_norm)
    assert [x["line"] for x in again.orderBy("pos").collect()] == got


def test_shared_folder():
    from types import SimpleNamespace as Name

    def of(master, folder=None):
        get = lambda key, default=None: folder
        return session.shared_base(Name(conf=Name(get=get), sparkContext=Name(getConf=lambda: Name(get=get), master=master, applicationId="test-app")))

    assert of("spark://host:7077", "file:///shared/") == "file:///shared"
    assert of("local[4]") == of("local")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            of(master)


def test_files_go_to_local_folders_only(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "x")], "path string, content string")
    for root in ("s3a://bucket/x", "viewfs://store/x"):
        with pytest.raises(ValueError):
            sinks.write_files(rows, root)
    sinks.write_files(rows, f"file://{tmp_path}")
    assert (tmp_path / "a/b.md").read_text() == "x"
    with pytest.raises(Exception, match="PermissionError"):
        sinks.write_files(rows.withColumn("path", F.lit("../out.md")), str(tmp_path / "in"))


def test_engine_gives_up_after_three_attempts(spark):
    state = spark.createDataFrame([("a", "h1", None, "pending", 0), ("b", "h2", "h2", "done", 0), ("c", "h3", None, "pending", 2)], engine.STATE)
    after = engine.run(state, lambda rows: rows.limit(0), 10)
    assert {x["path"]: (x["state"], x["attempts"]) for x in after.collect()} == {"a": ("pending", 1), "b": ("done", 0), "c": ("failed", 3)}
    assert engine.run(state, lambda rows: rows, 0).where("state = 'done'").count() == 1


def test_days_named_beyond_the_specification(spark):
    rows = spark.createDataFrame([("Tuesdays at 8am",), ("every thursday",)], "f string")
    assert [x[0] for x in rows.select(dates.cron_of(F.col("f"))).collect()] == ["0 8 * * 2", "0 6 * * 4"]
    assert [x[0] for x in rows.select(dates.cron_of(F.col("f"), strict_reference=True)).collect()] == ["0 8 * * *", "0 6 * * *"]


def test_endings_are_the_standard_library_s():
    assert enex.ENDINGS["image/png"] == ".png" and enex.ENDINGS["application/pdf"] == ".pdf" and len(enex.ENDINGS) > 80


def test_the_entry_can_be_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0


@pytest.mark.parametrize("most", [100_000, 0])
def test_a_tagger_never_broadcasts_words(spark, tmp_path, most):
    """Of notes whose source is so well compressed that the optimizer takes their words for few."""
    from notelake.operators import udf

    spark.range(2000).select(F.concat(F.lit("p"), "id").alias("path"), F.repeat(F.lit("Alpha beta "), 50).alias("body")).write.parquet(f"{tmp_path}/notes")
    tags = spark.createDataFrame([("x/alpha",), ("beta",), ("gamma",)], "tag string")
    out = udf.keyword_tagger(spark.read.parquet(f"{tmp_path}/notes"), tags, **({} if most else {"broadcast_tags": most}))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert ("BuildRight" in plan if most else "SortMergeJoin" in plan) and "BuildLeft" not in plan
    assert sorted((x["tag"], x["count"]) for x in out.groupBy("tag").count().collect()) == [("beta", 2000), ("x/alpha", 2000)]


def test_notes_are_parsed_once(spark):
    """What a filter and several columns read is computed by one place of the plan; in every other it would be done again."""
    from notelake.sources import vault

    p = vault.parse_notes(spark.range(5).select(F.concat(F.lit("---\na: x\ntags: [b]\ntagged_hash: y\n---\n"), "id").alias("text")))
    p = p.where("map_contains_key(frontmatter, 'a') AND tagged_hash <> body_hash AND size(tags) > 0").select("tags", "type", F.explode("tags").alias("tag"))
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1 and plan.count("---") <= 4
    assert [x["tag"] for x in p.collect()] == ["b"] * 5


def test_frontmatter_ends_at_its_rule(spark):
    import re

    from notelake.sources import vault

    pieces = ["---", "", "x: 1", "x: 2", "tags:", "  - a", "---x", "--- ", "é"]
    r = random.Random(5)
    texts = ["\n".join(["---"] * (k % 3 > 0) + [r.choice(pieces) for _ in range(r.randrange(7))]) for k in range(300)] + ["", "---", "---\n", "---\n---", "---\n---\n", "---\r\nx: 1\r\n---\r\nz\r\n", None]
    got = vault.parse_notes(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).select("i", "has_frontmatter", "body", "frontmatter").collect()
    for row in got:
        text = texts[row["i"]]
        if text is None:
            assert row["has_frontmatter"] is None and row["body"] is None
            continue
        m = re.match(r"(?s)\A---\n(.*?\n)??---\n(.*)\Z", text.replace("\r\n", "\n"))
        assert (row["has_frontmatter"], row["body"]) == ((True, m[2]) if m else (False, text.replace("\r\n", "\n")))
        first = re.search(r"(?m)^x: (\d)$", m[1] or "") if m else None
        if "  - a" not in (m[1] or "" if m else ""):
            assert row["frontmatter"].get("x") == ([first[1]] if first else None)


def test_rows_of_one_row_group_are_dealt_out(spark):
    """The notes' table lies in one row group; parsing it is more than one task's work."""
    from pathlib import Path

    from notelake.plans import note_queries

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    used = note_queries.parsed(spark, data).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= spark.sparkContext.defaultParallelism


def test_attachments_of_one_name_are_all_kept(spark, tmp_path):
    """Three pictures whose hashes begin with the same digits, and one that stands in two notes."""
    rows = [("a-123456.png", b"one"), ("a-123456.png", b"two"), ("a-123456.png", b"three"), ("a-123456.png", b"one"), ("b.png", b"four")]
    files = spark.createDataFrame(rows, "file string, data binary").repartition(3)
    sinks.write_files(sinks.attachment_files(files), str(tmp_path))
    found = [x for x in (tmp_path / "attachments").rglob("*") if x.is_file()]
    assert sorted((x.name, x.read_bytes()) for x in found) == sorted(set(rows))
    assert (tmp_path / "attachments/a-123456.png").exists()


def test_calendar_matching_makes_no_pairs(spark):
    import re

    r = random.Random(7)
    said = lambda n: [" ".join(r.choice(["alpha", "Beta", "gamma", "delta!", "of", "epsilon"]) for _ in range(r.randrange(6))) for _ in range(n)] + [None, ""]
    texts, titles = said(80), said(12)
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    events = spark.createDataFrame(list(enumerate(titles)), "event long, title string")
    out = planning.on_calendar(items, events, 3)
    assert "Inner" not in out._jdf.queryExecution().optimizedPlan().toString()
    words = lambda t: {w for w in re.split(r"\W+", (t or "").lower()) if len(w) >= 4}
    want = [i for i, t in enumerate(texts) if any(len(words(t) & words(e)) >= 3 for e in titles)]
    assert want and sorted(x["id"] for x in out.collect()) == want and out.columns == ["id", "text"]


@pytest.mark.parametrize("long", [48, 5])
def test_near_tags_against_all_pairs(spark, monkeypatch, long):
    """By rests and by pieces alike; words of one beginning that are far apart never meet."""
    from notelake.operators import tags

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    monkeypatch.setattr(tags, "LONG", long)
    r = random.Random(11)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(9))) for _ in range(150)} | {"", "a", "b", "ab"})
    frame = spark.createDataFrame([(w,) for w in [*words, words[-1]]], "tag string")
    for most, least in ((2, 1), (2, 0), (1, 3), (2, 6)):
        kept = [w for w in words if len(w) >= least]
        want = {(a, b, distance(a, b)) for a in kept for b in kept if a < b and distance(a, b) <= most}
        got = [tuple(x) for x in tags.edit_distance(frame, most, least).collect()]
        assert len(got) == len(want) and set(got) == want
    far = spark.range(2000).select(F.concat(F.lit("opening"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12)).alias("tag"))
    if long > 20:
        assert tags._by_rests(far.withColumn("len", F.length("tag")), 2).count() < 100


def test_lines_are_made_once_and_offer_few_beginnings(spark):
    """Each side's lines by one pass, whatever reads them; and no hash for a length that no line of the same opening has."""
    from pyspark.sql.types import StringType

    made = spark.sparkContext.accumulator(0)

    def make(i):
        made.add(1)
        return None if i % 50 == 49 else f"{i % 40:040d}" + "x" * (i % 7)

    line = F.udf(make, StringType())
    planned = spark.range(100).select("id", line(F.col("id")).alias("norm"), F.lit(False).alias("checked"))
    completed = spark.range(100, 130).select(line(F.col("id")).alias("norm"))
    out = reconcile.flip_completed(planned, completed, lines=False)
    got = {x["id"]: x["checked"] for x in out.collect()}
    assert made.value == 130 and out.columns == ["id", "checked"]
    text = lambda i: None if i % 50 == 49 else f"{i % 40:040d}" + "x" * (i % 7)
    assert got == {i: any(rule(text(i), text(j)) for j in range(100, 130)) for i in range(100)} and set(got.values()) == {True, False}

    lines = spark.createDataFrame([(f"{k:030d}" + "y" * k,) for k in range(40)], "norm string")
    l, r = matching.sides(lines, lines)  # noqa: E741
    assert {x["n"] for x in matching.keyed(l, r).select(F.size("heads").alias("n")).collect()} == {0}
    assert matching.match_items(lines, lines).count() == 40


def test_pairs_of_lines_read_no_texts(spark):
    """The pairs are made of what is kept of the lines; the notes' texts are read by the passes before."""
    from pathlib import Path

    from notelake.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    plan = QUERIES["match_prefix30"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "text#" not in plan


def test_each_note_is_normalised_once_for_both_sides(spark, monkeypatch):
    """Daily lines are beginnings of the notes' lines, so no note's text is read for them again."""
    from pathlib import Path

    from pyspark.sql.types import StringType

    from notelake.plans import views
    from notelake.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables here")
    docs = session.table(spark, data, "documents")
    for name, asked in (("match_prefix30", "true"), ("reconcile_flip", "true"), ("dedupe_existing", "lang <> 'en' OR doc_id % 3 = 0"), ("completed_unplanned", "lang = 'en' OR doc_id % 3 = 0"), ("carry_forward_kept", "lang = 'de'")):
        made = spark.sparkContext.accumulator(0)
        line = F.udf(lambda t, made=made: (made.add(1), t)[1], StringType())
        monkeypatch.setattr(views, "item_norm", line)
        QUERIES[name](spark, data).collect()
        assert made.value == docs.where(asked).count(), name


def test_pairs_are_read_from_lists(spark):
    """Left times right lines of a common opening never come out of the join row by row; all pairs are there, repeated rows and maps too."""
    head, (m, n) = "one common opening of more than thirty characters", (60, 90)
    left = [(i // 2, head[: 30 + i % 3], {"a": i // 2}) for i in range(m)] + [(m, None, None), (m + 1, "short", None)]
    right = [(j, head + str(j)) for j in range(n)] + [(n, None), (n + 1, "short")]
    lf, rf = spark.createDataFrame(left, "i long, norm string, m map<string, long>"), spark.createDataFrame(right, "j long, norm string")
    pairs = matching.match_items(lf, rf)
    assert pairs.columns == ["i", "norm", "m", "r_j", "r_norm"]
    got = sorted((x["i"], x["norm"], x["m"] and x["m"]["a"], x["r_j"]) for x in pairs.collect())
    assert got == sorted([(i, a, i, j) for i, a, _ in left[:m] for j in range(n)] + [(m + 1, "short", None, n + 1)])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner")


def test_item_norm_is_its_five_steps(spark):
    """The end of a text is looked at in short first; marks behind any number of blanks are found all the same."""
    import re

    def steps(t):
        for pattern, flags, put in ((r"\s*`?\[P[123]\]`?\s*$", 0, ""), (r"\s*\(due today\)\s*$", re.I, ""), (r"[`*_.,;:!?]+", 0, ""), (r"\s+", 0, " "), (r"^\s+|\s+$", 0, "")):
            t = re.sub(pattern, put, t, flags=re.ASCII | flags)
        return t.lower()

    ends = ["", "[P1]", " `[P2]`", " (Due Today)", "(due today) [P3]", " `[P1]` (due today)", "[P4]", "due today)", "]", " (due\ttoday)"]
    texts = [body + end + blank * k for body in ("", "Send  the *draft*", "x" * 70, "a\n" * 40) for end in ends for blank in (" ", "\n", "\t") for k in (0, 1, 38, 39, 40, 41, 52, 60, 63, 64, 65, 200)]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", text.item_norm(F.col("t")).alias("norm")).collect()
    assert len(got) == len(texts) + 1 and all(x["norm"] == (None if x["t"] is None else steps(x["t"])) for x in got)
