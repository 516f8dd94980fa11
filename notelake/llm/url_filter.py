"""URL filtering by rules and by the ratio of two character language models, in DataFrame operations only.

Urls that rules accept or reject train two variable-order Markov models of characters. A model interpolates
every order up to ``order`` by Witten-Bell smoothing, so each context is trusted as far as it was seen. The two
are held in one table of the corpus's distinct character runs, built order by order from the longest runs; its
rows grow with the variety of the urls, and no join key has more rows than there are characters. A url's score is
the mean log-likelihood difference of its characters; the threshold is calibrated on labelled urls that
training left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import cut

# The rules of the registered query, as (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlModelParams:
    order: int = 5
    #: Labelled urls whose hash has this remainder calibrate the threshold; the others train.
    folds: int = 5
    #: Steps per unit of score and largest score told apart when the threshold is chosen.
    steps: int = 32
    largest: int = 16
    #: Copies of the model among which each url's runs are dealt, so that a run all urls share is no hot key.
    salts: int = 4


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_string(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as host and path in one string; null if none does. Equally long rules: the first listed."""
    return _longest(host, path, rules, lambda h, p, v: h + p)


def rule_verdict(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    return _longest(host, path, rules, lambda h, p, v: v)


def _longest(host: Column, path: Column, rules, value) -> Column:
    out = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(value(h, p, v))).otherwise(out)
    return out


def _grams(url: Column, order: int) -> Column:
    """The runs of ``order + 1`` characters that end at each character of the url after its scheme; the first ones begin with filler."""
    text = F.concat(F.lit("\u0002" * order), F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", ""))
    letters = F.split(text, "")
    n = F.size(letters) - order
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(letters, i, order + 1), ""))).otherwise(F.array().cast("array<string>"))


def log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """gram, ratio: log of its last character's probability in the accepted over the rejected model.

    ``counts``: gram (``order + 1`` characters), good, bad (times seen in either training set; 0 in both allowed).
    """
    levels = {order: counts.select(F.col("gram").alias("g"), "good", "bad")}
    for k in range(order - 1, -1, -1):
        shorter = F.expr(f"substr(g, -{k + 1})")
        levels[k] = cut(levels[k + 1].groupBy(shorter.alias("g")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), f"url-level{k}")
    # Below order 0 every character is as likely as any other.
    below = levels[0].select("g").withColumn("u", F.lit(1.0) / F.count("*").over(Window.partitionBy(F.lit(0)))).select("g", F.col("u").alias("pg"), F.col("u").alias("pb"))
    for k in range(order + 1):
        table = levels[k].withColumns({"ctx": F.substring("g", 1, k), "short": F.expr(f"substr(g, -{k})") if k else F.col("g")})
        same = Window.partitionBy("ctx")
        for side in ("good", "bad"):
            table = table.withColumns({f"n_{side}": F.sum(side).over(same), f"t_{side}": F.sum((F.col(side) > 0).cast("long")).over(same)})
        lower = below.select(F.col("g").alias("short"), F.col("pg").alias("lg"), F.col("pb").alias("lb"))

        def smoothed(side: str, low: str) -> Column:
            n, t = F.col(f"n_{side}"), F.col(f"t_{side}")
            return F.when(n > 0, (F.col(side) + t * F.col(low)) / (n + t)).otherwise(F.col(low))

        below = table.join(lower, "short").select("g", smoothed("good", "lg").alias("pg"), smoothed("bad", "lb").alias("pb"))
        below = cut(below, f"url-prob{k}")
    return below.select(F.col("g").alias("gram"), F.log(F.col("pg") / F.col("pb")).alias("ratio"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, params: UrlModelParams | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    A rule's verdict stands; any other url is allowed if its score reaches the threshold. An empty url scores 0, as
    every url does when no rule accepts, or none rejects, any. A null url is as an empty one; a null id is returned as
    null; repeated rows are judged alike, and each trains. Urls of any length are scored whole. Other columns are ignored.
    """
    params = params or UrlModelParams()
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    urls = source.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.withColumns({"rule": rule_string(F.col("host"), F.col("path"), rules), "said": rule_verdict(F.col("host"), F.col("path"), rules)})
    # Equal urls are scored once.
    fold = F.pmod(F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(params.folds))
    distinct = cut(urls.groupBy("url").agg(F.count("*").alias("times"), F.first("said").alias("said")).withColumns({"fold": fold, "uid": F.md5(F.coalesce("url", F.lit("")))}), "urls")
    # A url grows into a row per character; a fixed number of partitions keeps small tables from growing in one task.
    distinct = distinct.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "uid")
    trains = F.col("fold") > 0
    good = F.when(trains & (F.col("said") == "allow"), F.col("times")).otherwise(0)
    bad = F.when(trains & (F.col("said") == "block"), F.col("times")).otherwise(0)
    runs = distinct.select(good.alias("good"), bad.alias("bad"), F.explode(_grams(F.col("url"), params.order)).alias("gram"))
    counts = cut(runs.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-counts")
    model = log_ratios(counts, params.order).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))))
    dealt = distinct.select("uid", F.explode(_grams(F.col("url"), params.order)).alias("gram")).withColumn("salt", F.pmod(F.hash("uid"), F.lit(params.salts)))
    scores = dealt.join(model, ["gram", "salt"]).groupBy("uid").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scored = cut(distinct.join(scores, "uid", "left").select("url", "times", "said", "fold", F.coalesce("score", F.lit(0.0)).alias("score")), "url-scores")
    both = counts.agg((F.sum("good") > 0) & (F.sum("bad") > 0)).first()[0]
    threshold = calibrate(scored.where("fold = 0 AND said IS NOT NULL"), params)
    score = F.col("score") if both else F.lit(0.0)
    found = scored.select(F.col("url").alias("u"), score.alias("score"))
    verdict = F.coalesce("said", F.when((F.floor(F.col("score") * params.steps) >= threshold) | (F.length(F.coalesce("url", F.lit(""))) == 0), "allow").otherwise("block"))
    return urls.join(found, F.col("url").eqNullSafe(F.col("u"))).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def calibrate(labelled: DataFrame, params: UrlModelParams) -> int:
    """The step (a ``1 / steps`` of score) from which urls are accepted: that with the smallest sum of both kinds' error rates, the one nearest 0 of several. 0 without labelled urls of both kinds.

    Only counts per step, of which there are a fixed number, reach the driver.
    """
    most = params.steps * params.largest
    step = F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.col("score") * params.steps))).cast("int")
    rows = labelled.groupBy(step.alias("step"), "said").agg(F.sum("times").alias("n")).collect()
    good = {r["step"]: r["n"] for r in rows if r["said"] == "allow"}
    bad = {r["step"]: r["n"] for r in rows if r["said"] == "block"}
    if not good or not bad:
        return 0

    def error(t: int) -> float:
        return sum(n for s, n in good.items() if s < t) / sum(good.values()) + sum(n for s, n in bad.items() if s >= t) / sum(bad.values())

    return min(range(-most, most + 1), key=lambda t: (round(error(t), 12), abs(t), t))
