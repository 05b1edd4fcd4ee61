"""URL rules and site lists by cascades of Bloom filters, in DataFrame operations only.

A cascade tells the listed keys from all other keys of a complete universe: level 1 encodes the
listed keys, level 2 the others that level 1 lets through, level 3 the listed ones that level 2 lets
through, and so on until a level lets none through. A key of the universe is then judged without
error and without a join, by the first level that lacks it. Each level is an array of 64-bit words
sent with the plan; a key sets three bits of one word, so a test reads one word.

The universe is what the corpus can ask: of every URL the ends of its host times the starts of its
path that have the lengths of rules, and the labels of its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, staged

#: Bits of a level for each key that it encodes, and the most 64-bit words of a level (16 MB). Beyond
#: 8 million keys that the corpus has, levels let more through and the cascade gets longer, not wrong.
BITS, MOST_WORDS = 16, 1 << 21
_MOST_LEVELS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query: host, start of the path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: The listed sites of the query: a host with such a label is blocked where no rule fits.
SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case and the path; both empty for a null or where no ``://`` is."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _word_and_mask(key: Column, level: int, words: int) -> tuple[Column, Column]:
    """The word of a key in a level (low bits of its hash) and the key's three bits there (high bits)."""
    h = F.xxhash64(F.lit(level), key)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit(words - 1)).cast("int"), bit(46).bitwiseOR(bit(52)).bitwiseOR(bit(58))


def _passes(words: list[int], level: int, key: Column) -> Column:
    at, mask = _word_and_mask(key, level, len(words))
    sent = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one constant
    return F.get(sent, at).bitwiseAND(mask) == mask


def build_cascade(keys: DataFrame) -> list[list[int]]:
    """The levels for ``keys`` (key, listed): every key that may be asked, once, and whether it is listed.

    Keys are kept in the shared folder; only the words of a level, at most ``MOST_WORDS``, come to the driver.
    No listed key gives no level.
    """
    left, levels = keys, []
    for level in range(_MOST_LEVELS):
        encoded = F.col("listed") == F.lit(level % 2 == 0)
        n = left.where(encoded).count()
        if not n:
            return levels
        size = min(MOST_WORDS, 1 << max(0, (n * BITS // 64 - 1).bit_length()))
        at, mask = _word_and_mask(F.col("key"), level, size)
        words = [0] * size
        for row in left.where(encoded).groupBy(at.alias("at")).agg(F.bit_or(mask).alias("word")).collect():
            words[row.at] = row.word
        levels.append(words)
        left = left.where(encoded | _passes(words, level, F.col("key")))
    raise ValueError(f"more than {_MOST_LEVELS} levels: too many keys for {MOST_WORDS} words")


def is_listed(levels: list[list[int]], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that lacks it decides, else the last level has it."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        out = F.when(~_passes(levels[level], level, key), F.lit(level % 2 == 1)).otherwise(out)
    return out


def _universe(pages: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """Every key of the pages once, with the column of ``listed`` (key, listed), null where it isn't there."""
    once = pages.select(F.explode(keys).alias("key")).distinct()
    return staged(once.join(listed, "key", "left"))


def _fitting_keys(rules: DataFrame) -> Column:
    """All ends of ``host`` with as many labels as a rule's host, times starts of ``path`` as long as a rule's path."""
    lengths = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("path")).first()
    labels = F.size(F.split("host", r"\."))
    keys = [F.when((labels >= n) & (F.length("path") >= m), F.concat(F.substring_index("host", ".", -n), F.left("path", F.lit(m)))) for n in sorted(lengths.labels) for m in sorted(lengths.path)]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, sites: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The verdict on every URL: that of the longest fitting rule, else block if the host has a listed label, else allow.

    ``pages`` needs url and the columns of ``keep``, of which host, path, rule and verdict give way; other
    columns are ignored. ``rules``: host, path, verdict (``allow`` or ``block``); a rule fits its host and all
    subdomains where the URL's path starts with the rule's; of equal rules a block wins. ``sites``: label. A null
    URL, or one without ``://``, has an empty host and path, no rule, and is allowed; repeated rows each get their
    row; empty tables of pages, rules or sites are as they say.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(*[c for c in keep if c not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    fitting, labels = _fitting_keys(rules), F.split("host", r"\.")
    by_rule = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max(F.col("verdict") == "block").alias("blocks"))
    asked = _universe(pages, fitting, by_rule)
    ruled = build_cascade(asked.select("key", F.col("blocks").isNotNull().alias("listed")))
    blocks = build_cascade(asked.where("blocks is not null").select("key", F.col("blocks").alias("listed")))
    names = sites.select(F.col("label").alias("key"), F.lit(True).alias("there")).distinct()
    listed = build_cascade(_universe(pages, labels, names).select("key", F.col("there").isNotNull().alias("listed")))

    fits = F.filter(fitting, lambda k: is_listed(ruled, k))
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    judged = pages.withColumn("rule", longest)
    blocked = F.when(F.col("rule").isNotNull(), is_listed(blocks, F.col("rule"))).otherwise(F.exists(labels, lambda x: is_listed(listed, x)))
    return judged.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))


def _values(spark: SparkSession, names: str, *rows: tuple[str, ...]) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(str(r) if len(r) > 1 else f'({r[0]!r})' for r in rows)} AS t({names})")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, sites = _values(spark, "host, path, verdict", *RULES), _values(spark, "label", *[(s,) for s in SITES])
    return judge_urls(read(spark, sf_dir, "pages"), rules, sites)
