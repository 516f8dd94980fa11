"""Tag vocabulary, lint detectors, merge plans and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import replace_tag, segment_key
from ..functions.text import fold_case
from ..session import spread


def vocabulary(notes: DataFrame, tags: str = "tags") -> DataFrame:
    """tag and how often it stands, most used first."""
    return notes.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def coverage(vocab: DataFrame, declared: DataFrame, established: int = 5) -> DataFrame:
    """Share of established tags that are declared; under 60 % of them, or with none, the mode is ``frequency``, else ``canon``."""
    known = declared.select("tag", F.lit(1).alias("listed"))
    return (
        vocab.where(F.col("n") >= established)
        .join(known, "tag", "left")
        .agg(F.count("*").alias("n_established"), F.count("listed").alias("n_listed"))
        .withColumn("mode", F.when((F.col("n_established") > 0) & (F.col("n_listed") * 100 >= F.col("n_established") * 60), "canon").otherwise("frequency"))
    )


def against_declared(vocab: DataFrame, declared: DataFrame) -> DataFrame:
    """Every tag of either side with its status: both, unlisted (used, not declared), unused."""
    v, d = vocab.select(F.col("tag").alias("used")), declared.select(F.col("tag").alias("listed"))
    status = F.when(F.col("listed").isNull(), "unlisted").when(F.col("used").isNull(), "unused").otherwise("both")
    return v.join(d, F.col("used") == F.col("listed"), "full_outer").select(F.coalesce("used", "listed").alias("tag"), status.alias("status"))


def reordered(vocab: DataFrame) -> DataFrame:
    """Pairs of tags with the same segments."""
    return _equal_by(vocab, segment_key(F.col("tag")))


def case_or_separator(vocab: DataFrame) -> DataFrame:
    """Pairs that differ in case or separators only."""
    return _equal_by(vocab, F.lower(F.regexp_replace("tag", "[-_ ]", "")))


def _equal_by(vocab: DataFrame, key) -> DataFrame:
    keyed = vocab.select("tag", key.alias("key")).distinct()
    other = keyed.select(F.col("tag").alias("tag2"), "key")
    return keyed.join(other, "key").where("tag < tag2").select(F.col("tag").alias("tag1"), "tag2")


def edit_distance(vocab: DataFrame, most: int = 2, least_length: int = 1) -> DataFrame:
    """Pairs within an edit distance.

    Words within a distance of d are equal once d characters are dropped from the longer and d less the difference of
    lengths from the shorter; so pairs are joined on what is left, which only near words share, by its hash. A word of
    more than LONG characters has too many such rests, and its pieces are long enough to tell it: there pairs are
    joined on those. Either way a pair is tested before it is dealt out.
    """
    # Few bytes, but much is made of each.
    words = spread(vocab.select("tag").where(F.length("tag") >= least_length).distinct(), "tag").withColumn("len", F.length("tag"))
    pairs = _by_rests(words, most).union(_by_pieces(words.where(F.col("len") > LONG - most), most))
    distance = F.levenshtein("tag1", "tag2", most)
    return pairs.select(F.least("tag1", "tag2").alias("tag1"), F.greatest("tag1", "tag2").alias("tag2")).withColumn("distance", distance).where("distance >= 0").distinct()


#: Words of more characters meet by pieces.
LONG = 48


def _dropped(texts: Column) -> Column:
    """The distinct texts left by dropping one character of any; of an empty text, itself."""
    without = lambda t, i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: without(t, i)))))


def _by_rests(words: DataFrame, most: int) -> DataFrame:
    """tag1, tag2: pairs of words of at most LONG characters that share a rest."""
    short = words.where(F.col("len") <= LONG).withColumn("rests0", F.array("tag"))
    for k in range(most):
        short = short.withColumn(f"rests{k + 1}", _dropped(F.col(f"rests{k}")))

    def offers(k: int) -> Column:
        """With k characters dropped: the length of the longer words it meets, and the rest's hash."""
        return F.transform(f"rests{k}", lambda t: F.struct((F.col("len") + most - k).alias("size"), F.xxhash64(t).alias("rest")))

    longer = short.select(F.col("tag").alias("tag1"), F.explode(offers(most)).alias("door"))
    other = short.select(F.col("tag").alias("tag2"), "len", F.explode(F.concat(*[offers(k) for k in range(most + 1)])).alias("door"))
    # Of two words of one length each is the longer; they are taken once.
    once_each = (F.col("len") < F.col("door.size")) | (F.col("tag1") < F.col("tag2"))
    return longer.join(other, "door").where(once_each).select("tag1", "tag2")


def _by_pieces(words: DataFrame, most: int) -> DataFrame:
    """tag1, tag2: pairs of which the longer has more than LONG characters and any of ``most`` + 1 pieces of the shorter, at a place moved by at most ``most``."""
    pieces = F.sequence(F.lit(0), F.lit(most))
    bound = lambda k: F.floor(F.col("len") * k / (most + 1)).cast("int")
    left = words.select(F.col("tag").alias("tag1"), F.col("len").alias("len1"), F.explode(pieces).alias("k"), "len")
    left = left.select("tag1", "len1", "k", bound(F.col("k")).alias("at"), (bound(F.col("k") + 1) - bound(F.col("k"))).alias("size"))
    left = left.select("tag1", "len1", "k", "at", F.expr("substr(tag1, at + 1, size)").alias("piece"))
    # The longer (or equally long) word offers its text at every place a piece of a shorter one may have moved to.
    right = words.where(F.col("len") > LONG).select(F.col("tag").alias("tag2"), F.col("len").alias("len2"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("d"))
    right = right.withColumn("len1", F.col("len2") - F.col("d")).where("len1 > 0").withColumn("k", F.explode(pieces))
    at = F.floor(F.col("len1") * F.col("k") / (most + 1)).cast("int")
    size = F.floor(F.col("len1") * (F.col("k") + 1) / (most + 1)).cast("int") - at
    right = right.withColumns({"at": at, "size": size, "move": F.explode(F.sequence(F.lit(-most), F.lit(most)))})
    right = right.where("at + move >= 0 AND at + move + size <= len2").select("tag2", "len2", "len1", "k", "at", F.expr("substr(tag2, at + move + 1, size)").alias("piece"))
    return left.join(right, ["len1", "k", "at", "piece"]).where("tag1 <> tag2").select("tag1", "tag2")


def merge_plan(pairs: DataFrame, vocab: DataFrame, canon: DataFrame | None = None) -> DataFrame:
    """For each pair the winner: the declared spelling in canon mode, else the more used, else the smaller. A proposal; nothing is written."""
    n = vocab.select("tag", "n")
    out = pairs.join(n.select(F.col("tag").alias("tag1"), F.col("n").alias("n1")), "tag1").join(n.select(F.col("tag").alias("tag2"), F.col("n").alias("n2")), "tag2")
    first = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("tag1") < F.col("tag2")))
    if canon is not None:
        listed = canon.select("tag").distinct()
        out = out.join(listed.select(F.col("tag").alias("tag1"), F.lit(True).alias("c1")), "tag1", "left").join(listed.select(F.col("tag").alias("tag2"), F.lit(True).alias("c2")), "tag2", "left")
        c1, c2 = F.coalesce("c1", F.lit(False)), F.coalesce("c2", F.lit(False))
        first = (c1 & ~c2) | ((c1 == c2) & first)
    return out.select(F.when(first, F.col("tag2")).otherwise(F.col("tag1")).alias("from_tag"), F.when(first, F.col("tag1")).otherwise(F.col("tag2")).alias("to_tag"))


def merge(notes: DataFrame, old: str, new: str, tags: str = "tags") -> DataFrame:
    """Notes with one tag replaced; no other column changes."""
    return notes.withColumn(tags, replace_tag(F.col(tags), old, new))


def log_lines(plan: DataFrame, mode: str) -> DataFrame:
    """One log row per merge, naming the mode."""
    return plan.select(F.lit("tag-merge").alias("action"), F.col("to_tag").alias("path"), F.concat(F.col("from_tag"), F.lit(" -> "), F.col("to_tag"), F.lit(f" ({mode})")).alias("summary"))


# Spellings of the lint's modes.
MODES = {"canon": ("canon", "canonical", "strict"), "frequency": ("frequency", "freq"), "auto": ("auto", "")}


def mode_of(c: Column) -> Column:
    """The lint's mode in any spelling; none given is ``auto``, an unknown one null."""
    return fold_case(F.coalesce(c, F.lit("")), MODES)
