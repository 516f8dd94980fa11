"""Item matching: equal after normalisation, or one a prefix of the other with the shorter at least 30 characters.

Nothing but hashes meets: a line offers the hash of itself and, for each length that a line of the other side with the same
opening has, the hash of its own beginning of that length. Both are 128 bits, so equal hashes are equal texts. The hashes
a line offers are bounded by those lengths, and lines that share an opening but do not match never meet. Each side's lines
are made once, in a cut; where one side's lines are beginnings of the other's, both come of one cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..session import cut

PREFIX = 30

#: The left lines that wait at one door are dealt over so many lists at most, and the right ones over so many shares.
LISTS, SHARES = 16, 8


def matches(a: Column, b: Column) -> Column:
    """The rule itself, on two texts."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= PREFIX) & (F.startswith(a, b) | F.startswith(b, a)))


def digest(text: Column) -> Column:
    """A line's hash."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def lines(df: DataFrame, norm: str, most: int | None = None) -> DataFrame:
    """``df`` without its lines, but with ``own`` (the line's hash, null for a null line), ``size__``, ``opening__`` (its first PREFIX characters' hash) and ``begin__``: the line, or its first ``most`` characters. A cut, as lines may be costly to make."""
    rest = [c for c in df.columns if c != norm]
    known = df.select(*rest, once(F.col(norm)).alias("line__"))
    start = lambda n: F.substring("line__", 1, n)
    own, begin = F.when(F.col("line__").isNotNull(), digest(F.col("line__"))), F.col("line__") if most is None else start(most)
    return cut(known.select(*rest, own.alias("own"), F.length("line__").alias("size__"), digest(start(PREFIX)).alias("opening__"), begin.alias("begin__")), "lines")


def sides(left: DataFrame, right: DataFrame, left_norm: str = "norm", right_norm: str = "norm") -> tuple[DataFrame, DataFrame]:
    """Both sides' lines, the left's whole and the right's as far as the left's reach; the shorter lines do best on the left."""
    l = lines(left, left_norm)  # noqa: E741
    return l, lines(right, right_norm, l.agg(F.max("size__")).first()[0] or 0)


def beginnings(made: DataFrame, size: Column) -> DataFrame:
    """Of ``lines`` their first ``size`` characters, as lines. They are made of ``begin__``, which must reach as far, and no text is read again."""
    rest = [c for c in made.columns if c not in ("own", "size__", "opening__", "begin__")]
    known = made.select(*rest, F.substring(F.col("begin__"), F.lit(1), size.cast("int")).alias("begin__"))
    own, opening = F.when(F.col("begin__").isNotNull(), digest(F.col("begin__"))), digest(F.substring("begin__", 1, PREFIX))
    return known.select(*rest, own.alias("own"), F.length("begin__").alias("size__"), opening.alias("opening__"), "begin__")


def keyed(side: DataFrame, other: DataFrame) -> DataFrame:
    """Of ``sides`` one with ``own`` and ``heads`` (the hashes of its lines' beginnings of the lengths that the other side's lines with that opening have, those shorter than it). Rows with a null line are left out."""
    asked = other.where((F.col("size__") >= PREFIX) & (F.col("size__") < side.agg(F.max("size__")).scalar()))
    lengths = asked.groupBy("opening__").agg(F.collect_set("size__").alias("lengths__"))
    shorter = F.filter(F.coalesce("lengths__", F.array().cast("array<int>")), lambda n: n < F.col("size__"))
    heads = F.transform(shorter, lambda n: digest(F.substring(F.col("begin__"), F.lit(1), n)))
    known = side.where("own IS NOT NULL").join(lengths, "opening__", "left")
    return known.withColumn("heads", heads).drop("opening__", "size__", "begin__", "lengths__")


def _doors(side: DataFrame, left: bool) -> DataFrame:
    """A row for each hash under which a line is met: ``door``, and whether its own hash stands there (``whole``).

    On the left a line waits whole at door A and by its beginnings at B; on the right it waits whole at both and by
    its beginnings at A. So two lines meet if they are equal or one begins the other, and never by a common beginning.
    """
    door = lambda key, name: F.struct(key.alias("key"), F.lit(name).alias("name"))
    heads = F.transform("heads", lambda h: door(h, "B" if left else "A"))
    whole = [door(F.col("own"), "A")] if left else [door(F.col("own"), "A"), door(F.col("own"), "B")]
    rest = [c for c in side.columns if c != "heads"]
    return side.select(*rest, F.explode(F.concat(F.array(*whole), heads)).alias("door"))


def join_keyed(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of keyed lines that match, each once; columns of both sides but ``own`` and ``heads``. One join of hashes.

    There may be as many pairs at a door as left times right lines, so the left ones are joined as lists, which the pairs
    are read from last, and the right ones of a door are dealt over several tasks.
    """
    # The parts of a door as columns: rows are sorted by long numbers much faster than by structs.
    parts = {"x__": F.col("door.key.x"), "y__": F.col("door.key.y"), "name__": F.col("door.name")}
    l, r = (_doors(side, first).drop("own").withColumns(parts).drop("door") for side, first in ((left, True), (right, False)))  # noqa: E741
    ours, theirs = ([c for c in side.columns if c not in parts] for side in (l, r))
    lists = l.groupBy(*parts, _dealt(l, ours, LISTS).alias("list__")).agg(F.collect_list(F.struct(*ours)).alias("lines__")).drop("list__")
    lists = lists.withColumn("share__", F.explode(F.array(*map(F.lit, range(SHARES)))))
    # By merging: a broadcast would leave a door's right lines in the task that made them.
    return r.withColumn("share__", _dealt(r, theirs, SHARES)).join(lists.hint("merge"), [*parts, "share__"]).select(F.inline("lines__"), *theirs)


def _dealt(doors: DataFrame, columns: list[str], n: int) -> Column:
    """A number below ``n`` for each row, of these columns; maps have no hash."""
    told = [c for c, kind in doors.dtypes if c in columns and "map<" not in kind and "variant" not in kind]
    return F.pmod(F.xxhash64(*told), F.lit(n)).cast("int") if told else F.lit(0)


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """own: the hashes of the keyed left lines that match any right one, each once."""
    return _doors(left.select("own", "heads"), True).join(_doors(right.select("own", "heads"), False).select("door").distinct(), "door", "left_semi").select("own").distinct()


def match_lines(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """The left of two sides' lines that match any right one (left_semi) or none (left_anti)."""
    return left.join(matched(keyed(left, right), keyed(right, left)), "own", how)


def match_items(left: DataFrame, right: DataFrame, how: str = "inner", left_norm: str = "norm", right_norm: str = "norm") -> DataFrame:
    """Joins two frames on matching items. The right side's columns get the prefix ``r_``; semi and anti joins keep the left's only.

    A null line matches nothing. Each pair comes once.
    """
    if how in ("left_semi", "left_anti"):
        l, r = sides(left, right.select(right_norm), left_norm, right_norm)  # noqa: E741
        return match_lines(l, r, how).select(*[F.col("begin__").alias(c) if c == left_norm else F.col(c) for c in left.columns])
    twice = lambda df, norm, name: df.withColumn(name, F.col(norm))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    l, r = sides(twice(left, left_norm, "line_l__"), twice(r, f"r_{right_norm}", "line_r__"), "line_l__", "line_r__")  # noqa: E741
    return join_keyed(keyed(l, r), keyed(r, l))


def carried_weeks(unchecked: DataFrame, key: str = "item", week: str = "week", weeks: int = 3) -> DataFrame:
    """Items open in ``weeks`` weeks running: key and the last of the weeks. Each (key, week) counts once."""
    seen = unchecked.select(F.col(key).alias("key"), F.col(week).alias("week")).distinct()
    out = seen
    for k in range(1, weeks):
        before = seen.select("key", F.date_add("week", 7 * k).alias("week"))
        out = out.join(before, ["key", "week"], "left_semi")
    return out.select(F.col("key").alias(key), F.col("week").alias(week))


def carried_run(unchecked: DataFrame, key: str = "item", week: str = "week") -> DataFrame:
    """key, week, run: in how many weeks running, up to that one, an item has been open. A gap begins anew."""
    from pyspark.sql.window import Window

    seen = unchecked.select(key, week).distinct()
    order = Window.partitionBy(key).orderBy(week)
    island = F.date_sub(week, (7 * F.row_number().over(order)).cast("int"))
    seen = seen.withColumn("island__", island)
    return seen.withColumn("run", F.row_number().over(Window.partitionBy(key, "island__").orderBy(week)).cast("long")).drop("island__")


def carry_forward(last: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last week's open items in two parts: those that go on, and those also open the week before, which are dropped and reported. Both sides are ``lines``."""
    return match_lines(last, before, "left_anti"), match_lines(last, before, "left_semi")
