"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line is its sequence of lower-cased words. Equal lines (by two independent 64-bit hashes) form one
class, represented by its earliest place. Lines of ``NEAR_WORDS`` words or more are also duplicates within an edit bound of
one word (one word replaced, added or left out): each emits every variant with one word deleted as
a hashed key, equal variants are joined, and the edit distance is verified on the words. Variant
hashes are sums of word hash times place coefficient, so all n variants of a line come from running
sums. Before that, lines are left out that share neither half with another line: one edit spares
one half, so nothing is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import broadcast_if_small, read, staged

LEAST_WORDS = 1
NEAR_WORDS = 5  # one word is at most a fifth of such lines
_PRIME = (1 << 31) - 1
_SPACE = " \t\n\x0b\f\r"


def _place(doc: Column, line: Column) -> Column:
    """(doc_id, line) as one number in the same order."""
    return (doc.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + line).cast("decimal(32,0)")


def _words(line: Column) -> Column:
    """Words of a line that has some and no spaces around it. Only white space other than single spaces needs the pattern, which is slow."""
    odd = reduce(Column.__or__, (line.contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")))
    return F.when(odd, F.split(F.btrim(line, F.lit(_SPACE)), r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))


def _lines(docs: DataFrame) -> DataFrame:
    """place, line_no, n and words of every line of at least ``LEAST_WORDS`` words."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.ltrim(F.col("line"), F.lit(_SPACE)) != "")  # a filter on the words would split anew for each mention
    lines = lines.select("doc_id", "line_no", F.lower(F.trim("line")).alias("line")).select("doc_id", "line_no", _words(F.col("line")).alias("words")).withColumn("n", F.size("words"))
    if LEAST_WORDS > 1:
        lines = lines.where(F.col("n") >= LEAST_WORDS)
    return lines.select("doc_id", "line_no", _place(F.col("doc_id"), F.col("line_no")).alias("place"), "n", F.xxhash64("words").alias("h"), F.xxhash64(F.lit("again"), "n", "words").alias("g"), "words")


def _halves(words: Column, n: Column) -> Column:
    """Keys of the halves: its own, and those of a line one word shorter that it may contain."""

    def pair(size: Column) -> list[Column]:
        left = F.floor(size / 2).cast("int")
        right = size - left
        return [F.xxhash64(F.lit("l"), size, F.slice(words, 1, left)), F.xxhash64(F.lit("r"), size, F.slice(words, n - right + 1, right))]

    return F.when(n >= NEAR_WORDS, F.array(*pair(n), *pair(n - 1)))


def _variants(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, place, key, at) of every one-word deletion, and (h, place, key) of whole lines."""
    words = lines.select("h", "place", "n", F.posexplode("words").alias("at", "word"))
    value = F.pmod(F.xxhash64("word"), F.lit(_PRIME))
    coefficient = lambda at, salt: F.pmod(F.xxhash64(at, F.lit(salt)), F.lit(_PRIME))
    steps = {}
    for salt in (1, 2):
        steps[f"a{salt}"] = (value * coefficient(F.col("at"), salt)) % _PRIME
        steps[f"b{salt}"] = (value * coefficient(F.col("at") - 1, salt)) % _PRIME
    words = words.withColumns(steps).drop("word")
    line = Window.partitionBy("h")
    before = line.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    until = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = {f"d{s}": (F.coalesce(F.sum(f"a{s}").over(before), F.lit(0)) + F.sum(f"b{s}").over(line) - F.sum(f"b{s}").over(until)) % _PRIME for s in (1, 2)}
    whole = {f"w{s}": F.sum(f"a{s}").over(line) % _PRIME for s in (1, 2)}
    words = words.withColumns(after | whole)
    deleted = words.select("h", "place", F.xxhash64(F.col("n") - 1, "d1", "d2").alias("key"), "at", F.when(F.col("at") == 0, F.xxhash64(F.col("n"), "w1", "w2")).alias("whole"))
    deleted = staged(deleted)
    return deleted.drop("whole"), deleted.where("at = 0").select("h", "place", F.col("whole").alias("key"))


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """First places of the classes that an earlier class comes within one word of."""
    keys = distinct.where("halves is not null").select("h", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    open_ = staged(keys.join(shared, "key", "left_semi").select("h").distinct())
    first = staged(distinct.select("h", "place").join(open_, "h", "left_semi"))
    holders = staged(first.select(F.floor(F.col("place") / F.lit(1 << 32).cast("decimal(11,0)")).cast("long").alias("doc_id")).distinct())
    lines = _lines(docs.join(broadcast_if_small(holders), "doc_id", "left_semi"))  # only documents with such lines are read again
    texts = staged(lines.select("h", "place", "n", "words").join(broadcast_if_small(first), ["h", "place"], "left_semi").dropDuplicates(["h"]))
    deleted, whole = _variants(texts)
    groups = deleted.groupBy("key", "at").agg(F.min("place").alias("other"), F.max("place").alias("last")).where("other <> last")
    replaced = deleted.join(groups, ["key", "at"]).select("h", "place", "other")
    both = deleted.alias("d").join(whole.alias("w"), F.expr("d.key = w.key and d.h <> w.h"))
    added = both.select("d.h", "d.place", F.col("w.place").alias("other")).union(both.select("w.h", "w.place", F.col("d.place").alias("other")))
    earlier = replaced.union(added).where("other < place").groupBy("h").agg(F.min("other").alias("other"))
    pairs = staged(earlier).join(texts.select("h", F.col("words").alias("x")), "h").join(texts.select(F.col("place").alias("other"), F.col("words").alias("y")), "other")
    near = pairs.where(_within_one(F.col("x"), F.col("y"))).select("h")
    return staged(texts.select("h", "place").join(near, "h").select("place"))


def _within_one(x: Column, y: Column) -> Column:
    """Whether two word sequences are within one edit: equal start and end cover all but one word."""
    longest = F.greatest(F.size(x), F.size(y))

    def common(a: Column, b: Column) -> Column:
        at = F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at > 0, at - 1).otherwise(longest)

    return common(x, y) + common(F.reverse(x), F.reverse(y)) >= longest - 1


def drop_duplicate_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Drop each line that equals an earlier line, or comes within one word of one.

    ``docs`` needs doc_id, text and the columns of ``keep``; other columns are ignored. Earlier means
    a smaller doc_id, then a smaller line number. Lines without a word stay; those below ``NEAR_WORDS`` words are dropped only for an equal line. Returns the columns of
    ``keep``, text (the kept lines), n_lines and n_dropped; columns of ``keep`` with the last two names give way. A null text stays null and has no lines;
    rows without doc_id keep all lines and count for none; rows with one doc_id are one document, so
    repeated rows all keep their lines.
    """
    docs = docs.select(*dict.fromkeys((*keep, "doc_id", "text")))
    lines = _lines(docs)
    seen = staged(lines.select("doc_id", "line_no", "place", "h", "g", _halves(F.col("words"), F.col("n")).alias("halves")))
    distinct = staged(seen.groupBy("h", "g").agg(F.min("place").alias("place"), F.any_value("halves", True).alias("halves")))
    near = _near(docs, distinct).select(F.col("place").alias("first"), F.lit(True).alias("near"))
    firsts = distinct.select("h", "g", F.col("place").alias("first")).join(near, "first", "left")
    marked = seen.select("doc_id", "line_no", "place", "h", "g").join(firsts, ["h", "g"])
    dropped = marked.where("near or place <> first").groupBy("doc_id").agg(F.collect_set("line_no").alias("__dropped"))
    dropped = broadcast_if_small(staged(dropped), 2_000_000, "2 + size(__dropped)")  # else texts are shuffled once
    out = docs.join(dropped, "doc_id", "left").withColumn("__lines", F.split("text", "\n"))
    kept = F.filter("__lines", lambda x, i: ~F.coalesce(F.array_contains("__dropped", i), F.lit(False)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long")
    columns = [c for c in keep if c not in ("text", "n_lines", "n_dropped")]
    return out.select(*columns, F.array_join(kept, "\n").alias("text"), n_lines.alias("n_lines"), F.when(F.col("__dropped").isNull(), F.lit(0)).otherwise(size("__dropped")).cast("long").alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_duplicate_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
