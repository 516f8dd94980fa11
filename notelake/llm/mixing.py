"""Temperature mixing of sources.

Source weights are token shares raised to an exponent and normalised. The exponent is bisected, on aggregates,
until the weights meet a target entropy or a limit on how much more often one source repeats than another. The
budget is the smallest at which every source is passed over once, so nothing is dropped; a source of ``e`` epochs
gives each of its documents ``floor(e)`` copies, and one more to the head of a keyed permutation of each of its
blocks, until the block's share of the rest is spent. Blocks are small by construction, whatever a source's size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import column, cut


@dataclass(frozen=True)
class MixingParams:
    """Exactly one of ``target_entropy`` (nats) and ``repetition_limit`` (most epochs of a source over the fewest of one) is set."""

    repetition_limit: float | None = 1.5
    target_entropy: float | None = None
    block_rows: int = 1000
    seed: str = "mix"
    #: Bisection rounds; each narrows the exponent 16 times.
    rounds: int = 9


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")), F.lit(0)).cast("long")


def counted(docs: DataFrame, params: MixingParams, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """source, key, tokens of each row, written once: the only pass over the texts that the plan needs."""
    return cut(docs.select(column(source).cast("string").alias("source"), _key(params, source, doc_id).alias("key"), word_count(column(text)).alias("tokens")), "mix-counted")


def _key(params: MixingParams, source: str, doc_id: str) -> Column:
    """A row's place in its source's permutation."""
    return F.md5(F.concat_ws("/", F.lit(params.seed), F.coalesce(column(source).cast("string"), F.lit("")), F.coalesce(column(doc_id).cast("string"), F.lit(""))))


def shares(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """source, rows, tokens; a null source is one of its own."""
    return _shares_of(docs.select(column(source).cast("string").alias("source"), word_count(column(text)).alias("tokens")))


def _shares_of(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens")), "mix-shares")


def solve_exponent(table: DataFrame, params: MixingParams) -> float:
    """The exponent in [0, 1] of the weights: with a repetition limit the smallest that keeps it, with a target entropy the largest that reaches it (0 if none does).

    Both measures fall as the exponent rises. A round evaluates a grid of exponents in one aggregation over the
    sources, so only the grid's measures reach the driver.
    """
    if (params.repetition_limit is None) == (params.target_entropy is None):
        raise ValueError("set either repetition_limit or target_entropy")
    total = table.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    p = table.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def meets(grid: list[float]) -> list[bool]:
        x, epochs = F.pow("p", "alpha"), F.pow(F.col("p"), F.col("alpha") - 1)
        measures = (F.sum(x).alias("z"), F.sum(x * F.col("alpha") * F.log("p")).alias("xl"), (F.max(epochs) / F.min(epochs)).alias("spread"))
        rows = p.select("p", F.explode(F.array(*map(F.lit, grid))).alias("alpha")).groupBy("alpha").agg(*measures).collect()
        by = {r["alpha"]: r for r in rows}
        if params.repetition_limit is not None:
            return [by[a]["spread"] <= params.repetition_limit for a in grid]
        return [math.log(by[a]["z"]) - by[a]["xl"] / by[a]["z"] >= params.target_entropy for a in grid]

    at_0, at_1 = meets([0.0, 1.0])
    if params.repetition_limit is not None:
        if at_0:
            return 0.0
        good, bad = 1.0, 0.0
    else:
        if at_1 or not at_0:
            return 1.0 if at_1 else 0.0
        good, bad = 0.0, 1.0
    for _ in range(params.rounds):
        grid = [good + (bad - good) * k / 16 for k in range(1, 16)]
        met = sum(meets(grid))
        good, bad = ([good, *grid][met], [*grid, bad][met])
    return good


def epochs(table: DataFrame, exponent: float) -> DataFrame:
    """source, rows, tokens, epochs: passes over each source under the budget at which the least repeated one has exactly 1. A source without tokens has 1."""
    total = table.agg(F.sum("tokens")).first()[0] or 1
    x = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent - 1)))
    least = table.select(F.min(x).alias("least")).first()["least"]
    return table.withColumn("epochs", F.coalesce(x / F.lit(least), F.lit(1.0)) if least else F.lit(1.0))


def _placed(docs: DataFrame, params: MixingParams, doc_id: str, source: str, text: str) -> DataFrame:
    """row (all columns of a row of ``docs`` as one, so that no name of theirs can meet one of the plan's), tokens, block, copies."""
    rows = counted(docs, params, doc_id, source, text)
    table = _shares_of(rows)
    plan = cut(epochs(table, solve_exponent(table, params)), "mix-epochs")
    few = plan.limit(100_001).count() <= 100_000
    by_source = plan.select(F.col("source").alias("of"), "rows", "epochs")
    by_source = F.broadcast(by_source) if few else by_source
    block = F.pmod(F.conv(F.substring("key", 25, 8), 16, 10).cast("long"), F.ceil(F.col("rows") / params.block_rows)).cast("long")
    dealt = rows.join(by_source, F.col("source").eqNullSafe(F.col("of"))).withColumns({"block": block, "rest": F.col("epochs") - F.floor("epochs")}).where("rest > 0")
    inside = Window.partitionBy("source", "block")
    run = F.sum("tokens").over(inside.orderBy("key", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    heads = dealt.select("source", "block", "key", (run - F.col("tokens") / 2 <= F.col("rest") * F.sum("tokens").over(inside)).alias("more")).where("more")
    cuts = cut(heads.groupBy(F.col("source").alias("at"), F.col("block").alias("nr")).agg(F.max("key").alias("last")), "mix-cuts")
    packed = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(source).cast("string").alias("source"), _key(params, source, doc_id).alias("key"), word_count(column(text)).alias("tokens"))
    keyed = packed.join(by_source, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block)
    placed = keyed.join(cuts, F.col("source").eqNullSafe(F.col("at")) & (F.col("block") == F.col("nr")), "left")
    copies = (F.floor("epochs") + F.coalesce((F.col("key") <= F.col("last")).cast("long"), F.lit(0))).cast("int")
    return placed.select("row", "tokens", "block", copies.alias("copies"))


def with_copies(docs: DataFrame, params: MixingParams | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every row of ``docs``, all columns, with ``__tokens``, ``__block`` and ``__copies`` (at least 1); columns of ``docs`` with those names are replaced.

    A null source is one of its own; a null or blank text counts no tokens and a null id is as an id of its own.
    Rows of one source that share an id are permuted together, so they get the same copies. Texts of any length are
    counted whole. Other columns may have any names. An empty table gives an empty result.
    """
    out = _placed(docs, params or MixingParams(), doc_id, source, text)
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("__tokens", "__block", "__copies")]
    return out.select(*others, F.col("tokens").alias("__tokens"), F.col("block").alias("__block"), F.col("copies").alias("__copies"))


def mix(docs: DataFrame, params: MixingParams | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its source's weight asks for, columns unchanged, whatever their names. Nulls and repeated rows are as in ``with_copies``; an empty table stays empty."""
    out = _placed(docs, params or MixingParams(), doc_id, source, text)
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


# The same plan for the default parameters in SQL: with a repetition limit the exponent has a closed form.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	

]+'), lambda w: w <> ''))::BIGINT AS n_tokens,
         md5('mix/' || coalesce(source, '') || '/' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
t AS (SELECT source, count(*) AS n_rows, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY source),
p AS (SELECT source, n_rows, tokens / (SELECT sum(tokens) FROM t) AS p FROM t),
a AS (SELECT CASE WHEN max(p) / min(p) <= 1.5 THEN 0 ELSE 1 - ln(1.5) / ln(max(p) / min(p)) END AS alpha FROM p WHERE p > 0),
e AS (SELECT source, n_rows, CASE WHEN p > 0 THEN pow(p, alpha - 1) / (SELECT min(pow(p, alpha - 1)) FROM p, a WHERE p > 0) ELSE 1 END AS epochs FROM p, a),
k AS (
  SELECT d.*, e.epochs, ('0x' || substr(key, 25, 8))::BIGINT % ceil(e.n_rows / 1000.0)::BIGINT AS block
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
r AS (
  SELECT *, epochs - floor(epochs) AS rest,
         sum(n_tokens) OVER (PARTITION BY source, block ORDER BY key, n_tokens ROWS UNBOUNDED PRECEDING) AS run,
         sum(n_tokens) OVER (PARTITION BY source, block) AS total
  FROM k),
m AS (SELECT *, max(CASE WHEN rest > 0 AND run - n_tokens / 2.0 <= rest * total THEN key END) OVER (PARTITION BY source, block) AS last FROM r)
SELECT doc_id, source, n_tokens, block::BIGINT AS block,
       (floor(epochs) + CASE WHEN rest > 0 AND key <= last THEN 1 ELSE 0 END)::INTEGER AS copies
FROM m
"""
