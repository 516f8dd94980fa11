"""String functions over columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of the ten connector roles, by canonical role.
ROLE_ALIASES = {
    "email": ("email", "e-mail", "mail", "inbox"),
    "chat": ("messaging", "chat", "slack", "teams", "telegram", "dm", "dms"),
    "meetings": ("meetings", "meeting", "meeting notes", "transcripts"),
    "calendar": ("calendar", "cal", "schedule"),
    "issues": ("project management", "issues", "tickets", "pm", "issue tracker"),
    "code": ("code", "repo", "repos", "git", "source control"),
    "second-vault": ("second vault", "second-vault", "team vault", "second knowledge base"),
    "vault": ("vault", "this vault", "filesystem", "local filesystem"),
    "memory": ("memory",),
    "web": ("web", "news", "web search"),
}
# Other names of bundled skills and routines.
SKILL_ALIASES = {"weekly-plan": "weekly-planning", "daily-planning": "daily-plan", "meeting-preparation": "meeting-prep"}
ROUTINE_ALIASES = {"weekly-plan-update": "weekly-plan-daily-update", "weekly-memory": "memory"}


def once(c: Column) -> Column:
    """The same value, computed once. The test always holds, but as the optimizer can't know, it does not copy what makes the value into every filter and lambda that reads it."""
    return F.when(F.spark_partition_id() >= 0, c)


def trim_ws(c: Column) -> Column:
    """Without white space at either end (``trim`` alone strips blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def slug(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def field(c: Column, n: int) -> Column:
    """The n-th field, from 1, of a bar-separated record, trimmed."""
    return trim_ws(F.split_part(c, F.lit("|"), F.lit(n)))


def sanitize_filename(c: Column, most: int = 150) -> Column:
    clean = trim_ws(collapse_ws(trim_ws(F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', "-"))))
    cut = trim_ws(F.substring(clean, 1, most))
    return F.when(F.length(cut) > 0, cut).otherwise("untitled")


def normalize_tag(c: Column) -> Column:
    return F.lower(F.regexp_replace(trim_ws(c), r"\s+", "-"))


def enex_date(c: Column) -> Column:
    """Compact UTC times as ``yyyy-MM-dd HH:mm:ss``; anything else as it is."""
    t = F.try_to_timestamp(trim_ws(c), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), c)


def enex_timestamp(c: Column) -> Column:
    """The typed twin of ``enex_date``; null where that passes text through."""
    return F.try_to_timestamp(trim_ws(c), F.lit("yyyyMMdd'T'HHmmss'Z'"))


def yaml_escape(c: Column) -> Column:
    """In double quotes, backslashes and quotes escaped, backslashes first."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def safe_title(c: Column) -> Column:
    """Legal as a file name and as a link target."""
    return F.regexp_replace(F.regexp_replace(F.translate(c, "\\/:|#^[]", "--------"), " +", " "), "^[ .-]+|[ .-]+$", "")


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?(-->|\z)", "")


def strip_fence(c: Column) -> Column:
    """Without a code fence around the whole, and without blank lines before it."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\A\s*```[^\n]*\n(.*?)\n?```\s*\z", "$1"), r"\A(\s*\n)+", "")


def item_norm(c: Column) -> Column:
    """The form in which checklist items are compared: no priority tag or due mark at the end, no stray marks, single spaces, lower case.

    The two marks are looked for at the end of the text only, so a long text is read by two regexes and no more. Trimming
    a long text costs as much as those, so it is done only where a mark, or more blanks than can be told, end the text.
    """
    space = F.lit(" \t\n\x0b\f\r")
    ends = F.right(c, F.lit(64)).rlike(r"(?i)(\[P[123]\]`?|\(due today\))\s*$|\s{40}$")
    bare = F.when(F.right(F.rtrim(c, space), F.lit(5)).rlike(r"\[P[123]\]`?$"), F.regexp_replace(c, r"\s*`?\[P[123]\]`?\s*$", "")).otherwise(c)
    due = F.lower(F.right(F.rtrim(bare, space), F.lit(11))) == "(due today)"
    bare = F.when(ends, F.when(due, F.regexp_replace(bare, r"(?i)\s*\(due today\)\s*$", "")).otherwise(bare)).otherwise(c)
    return F.lower(F.trim(collapse_ws(F.regexp_replace(bare, r"[`*_.,;:!?]+", ""))))


def priority_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\[(P[123])\]", 1), F.lit(""))


def body_hash(c: Column, digits: int = 16) -> Column:
    """The head of the body's SHA-256, line ends as LF."""
    return F.substring(F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")), 256), 1, digits)


def domain_of(path: Column) -> Column:
    """The first two folders of a note's path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(2), F.greatest(F.lit(1), F.size(parts) - 1))), "/")


def log_sanitize(c: Column) -> Column:
    """One line, without the separator."""
    return F.translate(F.regexp_replace(c, r"[\r\n]+", " "), "|", "/")


def escape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def clean_title(c: Column) -> Column:
    """Without numbering, bullets or quotes around it."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*([0-9]+[.)]|[-*])\s+", ""), "^[\"'\\s]+|[\"'\\s]+$", "")


def halves(c: Column, pattern: str) -> tuple[Column, Column]:
    """What stands before and after the first match, trimmed; the second is null where there is none."""
    parts = F.split(c, r"\s*" + pattern + r"\s*", 2)
    return trim_ws(F.get(parts, F.lit(0))), trim_ws(F.get(parts, F.lit(1)))


def contributes(c: Column) -> tuple[Column, Column]:
    """Pull and landing place of a contribution."""
    return halves(c, "→")


def shorthand(c: Column) -> tuple[Column, Column]:
    return halves(c, "=")


def _renamed(name: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), name), name)


def role_alias(c: Column) -> Column:
    """The canonical role of any of its names, without what stands in parentheses; other names lower-cased."""
    return _renamed(F.lower(trim_ws(F.regexp_replace(c, r"\(.*\)", ""))), {n: role for role, names in ROLE_ALIASES.items() for n in names})


def skill_alias(c: Column) -> Column:
    """The installed name of a skill that goes by another."""
    return _renamed(c, SKILL_ALIASES)


def routine_alias(c: Column) -> Column:
    return _renamed(c, ROUTINE_ALIASES)


def alias_variants(canonical: str) -> list[str]:
    """All names under which a template may hold a skill's or routine's attributes, the canonical one first."""
    return [canonical, *(n for names in (SKILL_ALIASES, ROUTINE_ALIASES) for n, c in names.items() if c == canonical)]


def connected_list(sources: Column, wanted: Column) -> Column:
    """Of (role, source) records in their order, the wanted roles whose source is neither empty nor ``none``, joined by commas."""
    held = F.filter(sources, lambda s: (F.coalesce(s["source"], F.lit("")) != "") & (s["source"] != "none") & F.array_contains(wanted, s["role"]))
    return F.array_join(F.transform(held, lambda s: s["role"]), ", ")


def normalize_daily(c: Column) -> Column:
    """The three sections of a daily note in order, headings with or without marks; what stands before the first is dropped, blank lines are single, one line end closes it."""
    form = r"(?m)^#*[ \t]*{}[ \t]*:?[ \t]*$"
    # Cut at headings: each piece after the first begins right after a heading line.
    marked = c
    for k, name in enumerate(("Admin", "Goals", "Notes")):
        marked = F.regexp_replace(marked, form.format(name), f"\u0001{k}")
    pieces = F.slice(F.split(marked, "\u0001"), 2, F.greatest(F.size(F.split(marked, "\u0001")), F.lit(1)))

    def section(k: int) -> Column:
        own = F.filter(pieces, lambda x: F.substring(x, 1, 1) == str(k))
        lines = F.transform(own, lambda x: F.regexp_replace(x, r"\A.\n?", ""))
        return F.array_join(F.transform(lines, lambda x: F.when(x.endswith("\n") | (x == ""), x).otherwise(F.concat(x, F.lit("\n")))), "")

    whole = F.concat(F.lit("# Admin\n"), section(0), F.lit("\n# Goals\n"), section(1), F.lit("\n# Notes\n"), section(2))
    return F.concat(F.regexp_replace(F.regexp_replace(whole, r"(\n[ \t]*)(?:\n[ \t]*)+(?=\n)", "$1"), r"\n+\z", ""), F.lit("\n"))


def normalize_weekly(c: Column, required: tuple[str, ...] = ("Weekly Goals", "Admin", "Personal")) -> Column:
    """A weekly plan with each required section it lacks appended, in order, and one line end at its end."""
    out = c
    for name in required:
        out = F.when(c.rlike(rf"(?m)^#*[ \t]*{name}[ \t]*:?[ \t]*$"), out).otherwise(F.concat(out, F.lit(f"\n# {name}\n")))
    return F.concat(F.regexp_replace(out, r"\n+\z", ""), F.lit("\n"))


def fold_case(c: Column, values: dict[str, tuple[str, ...]]) -> Column:
    """The key whose spellings hold the value, case and outer space aside; null if none."""
    flat = list(chain.from_iterable((F.lit(s), F.lit(k)) for k, ss in values.items() for s in ss))
    return F.try_element_at(F.create_map(*flat), F.lower(trim_ws(c)))


def first_set(*columns: Column, unset: str | None = None) -> Column:
    """The first that is neither null, empty nor the placeholder."""
    usable = [F.nullif(F.nullif(trim_ws(c), F.lit("")), F.lit(unset)) if unset else F.nullif(trim_ws(c), F.lit("")) for c in columns]
    return F.coalesce(*usable)


def required_flag(role: Column) -> Column:
    return F.when(role == "vault", "always").otherwise("optional")


def text_counts(c: Column) -> dict[str, Column]:
    """Bytes, white-space words and lines."""
    return {
        "n_bytes": F.octet_length(c).cast("long"),
        "n_words": F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long"),
        "n_lines": F.size(F.split(c, "\n")).cast("long"),
    }


def split_tagged_reply(c: Column) -> tuple[Column, Column]:
    """Tags and body of a reply in two parts; without the divider all is body, which ends in one line end."""
    both = r"(?s)\A\s*TAGS:\s*([^\n]*)\n\s*---BODY---\n(.*)\z"
    tags = F.nullif(F.regexp_extract(c, both, 1), F.lit(""))
    body = F.when(c.rlike(both), F.regexp_extract(c, both, 2)).otherwise(F.regexp_replace(c, r"\A\s*TAGS:[^\n]*\n", ""))
    return tags, F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n"))


def sample_one_in(c: Column, n: int) -> Column:
    """A fixed 1-in-n sample by the hash of a key."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 4), 16, 10).cast("long") % n == 0


def redact_emails(c: Column, mark: str = "[email]") -> Column:
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", mark)
