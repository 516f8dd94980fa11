"""The search language: a query string compiled to one filter column.

Terms are ANDed; ``OR``, ``-`` and parentheses combine; ``"phrase"``, ``/regex/`` and these operators take a term, a
phrase, a regex or a parenthesised expression: ``tag: path: file: content: line: block: section: task: task-todo:
task-done: match-case: ignore-case:``; ``[key]``, ``[key:value]``, ``[key:null]``, ``[key:<n]`` and ``[key:>n]`` test properties.
Matching is by substring, case aside unless asked for; these rules are our own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import tagged

_TOKEN = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<neg>-(?=\S))|(?P<op>(?:tag|path|file|content|line|block|section|task-todo|task-done|task|match-case|ignore-case):)|(?P<prop>\[[^\]]+\])|"(?P<phrase>[^"]*)"|/(?P<regex>(?:\\.|[^/\\])+)/|(?P<word>[^\s()"]+))')


@dataclass(frozen=True)
class Fields:
    """The columns a query reads."""

    path: str = "path"
    name: str = "name"
    body: str = "body"
    tags: str = "tags"
    properties: str = "frontmatter"


@dataclass(frozen=True)
class _Scope:
    text: Column
    fields: Fields
    match_case: bool = False

    def contains(self, term: str) -> Column:
        return self.text.contains(term) if self.match_case else F.lower(self.text).contains(term.lower())

    def matches(self, pattern: str) -> Column:
        return self.text.rlike(pattern if self.match_case else "(?i)" + pattern)


def _tokens(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"cannot read the query at {query[at:]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, query: str) -> None:
        self.tokens, self.at = _tokens(query), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self, s: _Scope) -> Column:
        out = self.both(s)
        while self.peek() == ("word", "OR"):
            self.take()
            out = out | self.both(s)
        return out

    def both(self, s: _Scope) -> Column:
        out = None
        while self.peek()[0] not in ("end", "close") and self.peek() != ("word", "OR"):
            c = self.one(s)
            out = c if out is None else out & c
        if out is None:
            raise ValueError("a term is missing")
        return out

    def one(self, s: _Scope) -> Column:
        kind, text = self.take()
        if kind == "neg":
            return ~F.coalesce(self.one(s), F.lit(False))
        if kind == "open":
            out = self.either(s)
            if self.peek()[0] != "close":
                raise ValueError("a parenthesis is not closed")
            self.take()
            return out
        if kind == "prop":
            return _property(text[1:-1], s.fields)
        if kind == "op":
            return self.scoped(text[:-1], s)
        if kind == "regex":
            return s.matches(text)
        return s.contains(text)

    def scoped(self, op: str, s: _Scope) -> Column:
        f = s.fields
        if op == "tag":
            _, text = self.take()
            return tagged(F.col(f.tags), text.lstrip("#"))
        if op in ("match-case", "ignore-case"):
            return self.one(replace(s, match_case=op == "match-case"))
        if op in ("path", "file", "content"):
            return self.one(replace(s, text=F.col({"path": f.path, "file": f.name, "content": f.body}[op])))
        start = self.at

        def inner(part: Column) -> Column:
            self.at = start
            return self.one(replace(s, text=part))

        return F.exists(_parts(op, F.col(f.body)), inner)


def _parts(op: str, body: Column) -> Column:
    if op == "line":
        return F.split(body, "\n")
    if op == "block":
        return F.split(body, r"\n\s*\n")
    if op == "section":
        return F.split(body, r"(?m)^(?=#{1,6}\s)")
    box = {"task": r"^\s*- \[[ xX]\] ", "task-todo": r"^\s*- \[ \] ", "task-done": r"^\s*- \[[xX]\] "}[op]
    return F.filter(F.split(body, "\n"), lambda x: x.rlike(box))


def _property(text: str, f: Fields) -> Column:
    key, colon, value = (x.strip() for x in text.partition(":"))
    held = F.try_element_at(F.col(f.properties), F.lit(key))
    if not colon:
        return F.map_contains_key(F.col(f.properties), key)
    if value == "null":
        return F.map_contains_key(F.col(f.properties), key) & (held.isNull() | (F.size(held) == 0))
    if value[:1] in "<>" and value:
        number = F.try_element_at(held, F.lit(1)).try_cast("double")
        bound = float(value[1:])
        return F.coalesce(number < bound if value[0] == "<" else number > bound, F.lit(False))
    return F.coalesce(F.array_contains(held, value), F.lit(False))


def compile_query(query: str, fields: Fields | None = None) -> Column:
    """The query as a filter column."""
    fields = fields or Fields()
    parser = _Parser(query)
    out = parser.either(_Scope(F.col(fields.body), fields))
    if parser.peek()[0] != "end":
        raise ValueError("a parenthesis is not opened")
    return out


def search(notes: DataFrame, query: str, fields: Fields | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Matching notes; excluded path prefixes are left out."""
    fields = fields or Fields()
    out = notes.where(compile_query(query, fields))
    for prefix in exclude:
        out = out.where(~F.col(fields.path).startswith(prefix))
    return out


def excluded(notes: DataFrame, query: str, exclude: tuple[str, ...], fields: Fields | None = None) -> DataFrame:
    """prefix, n_excluded: how many matching notes each excluded path prefix holds back, so that none is left out in silence."""
    fields = fields or Fields()
    prefix = F.coalesce(*[F.when(F.col(fields.path).startswith(p), p) for p in exclude])
    return notes.where(compile_query(query, fields)).select(prefix.alias("prefix")).where("prefix IS NOT NULL").groupBy("prefix").agg(F.count("*").alias("n_excluded"))


def context(notes: DataFrame, query: str, fields: Fields | None = None) -> DataFrame:
    """path, pos, line of the lines that match the query by themselves."""
    fields = fields or Fields()
    l = notes.select(F.col(fields.path).alias("path"), F.posexplode(F.split(fields.body, "\n")).alias("pos", "line"))  # noqa: E741
    return l.where(compile_query(query, replace(fields, body="line")))


def expansions(notes: DataFrame, queries: list[str], k: int | None = None, fields: Fields | None = None, key: str = "path") -> DataFrame:
    """path, hits: how many of several queries find each note, best first. One scan: each query is a column, not a pass."""
    fields = fields or Fields()
    hits = sum((F.coalesce(compile_query(q, fields), F.lit(False)).cast("long") for q in queries), F.lit(0).cast("long"))
    out = notes.select(key, hits.alias("hits")).groupBy(key).agg(F.max("hits").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key)
    return out.limit(k) if k else out


def by_code(notes: DataFrame, code: str | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A Spark SQL predicate, or any function of the notes."""
    return notes.where(F.expr(code)) if isinstance(code, str) else code(notes)
