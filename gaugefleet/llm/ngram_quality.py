"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Word unigrams and bigrams are hashed into ``BUCKETS`` buckets. One multinomial comes from the
trusted target, one from the raw corpus (every document). A document's score is the mean over its
n-grams of log(target / raw); every document is thresholded, without sampling. The weights are one
number per bucket, a fixed bound, and reach the tasks as a constant array: documents don't move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, staged

BUCKETS = 1 << 16
SMOOTHING = 0.5
THRESHOLD = -0.15
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _starts(column: Column, width: int) -> Column:
    """First places of the windows of an array, from 1; none if it is shorter."""
    n = F.size(column)
    return F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(F.array().cast("array<int>"))


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def with_base(docs: DataFrame) -> DataFrame:
    """Adds __words and the base counts to a table with __text."""
    text = F.col("__text")
    df = docs.withColumn("__words", words(text))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0)
    df = df.withColumn("__lines", lines)
    df = df.withColumn("__windows", F.transform(_starts(F.col("__words"), WINDOW), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__sorted", F.when(repeats, F.array_sort(placed)))
    near = lambda i: F.get("__sorted", i)["h"]
    twice = F.filter("__sorted", lambda x, i: (x["h"] == F.coalesce(near(i - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(near(i + 1), F.bitwise_not(x["h"]))))
    df = df.withColumn("__places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__places", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b
    )
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("__lines", "__windows", "__sorted", "__places")


def grams(words_: str) -> Column:
    """Buckets of the word unigrams and bigrams."""
    one = F.transform(words_, lambda w: _bucket(w))
    two = F.transform(_starts(F.col(words_), 2), lambda i: _bucket(F.get(words_, i - 1), F.get(words_, i)))
    return F.concat(one, two)


def gram_weights(docs: DataFrame, target_ids: DataFrame) -> Column:
    """A constant array: log(target / raw) per bucket, smoothed; zeros if there is no target."""
    trusted = staged(target_ids.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__target")).where("__id is not null").distinct())
    marked = docs.join(trusted, F.col("__id") == F.col("doc_id"), "left")
    exploded = marked.select("__target", F.explode(grams("__words")).alias("bucket"))
    counts = staged(exploded.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__target").alias("target")))
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total["target"]:
        return F.array_repeat(F.lit(0.0), BUCKETS)
    smoothed = lambda c: F.log((F.coalesce(F.col(c), F.lit(0)) + SMOOTHING) / (total[c] + SMOOTHING * BUCKETS))
    full = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    rows = full.select("bucket", F.round(smoothed("target") - smoothed("raw"), 4).cast("string").alias("w"))
    text = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda r: r["w"]), ",").alias("all")).first()["all"]
    return F.split(F.lit(text), ",").cast("array<double>")


def quality_rules(docs: DataFrame, target_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, score and verdict for every document.

    ``docs`` needs doc_id and text, ``target_ids`` the doc_id of the trusted documents; other columns
    are ignored. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and llr. A null or empty text has no words, llr 0 and fails the base; without
    trusted documents every llr is 0, which passes; repeated rows each get their row.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    table = gram_weights(given.withColumn("__words", words(F.col("__text"))), target_ids)
    df = with_base(given).withColumn("__grams", grams("__words"))
    total = F.aggregate("__grams", F.lit(0.0), lambda a, b: a + F.get(table, b))
    df = df.withColumn("llr", F.when(F.size("__grams") > 0, total / F.size("__grams")).otherwise(0.0))
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 1"))
