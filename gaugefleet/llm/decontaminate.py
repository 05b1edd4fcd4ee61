"""Benchmark decontamination with one FM-index per training shard.

Every task cuts its documents into shards of bounded size and indexes each: suffix order by prefix
doubling, Burrows-Wheeler string in a wavelet matrix, suffix positions sampled. Test phrases (the
windows of the benchmark items) are found by backward search through wavelet ranks, located by
walking to sampled positions, and merged into removal spans. Words that no test phrase has cannot
be part of an occurrence, nor can runs of known words shorter than the shortest phrase; both
become separators, which keeps the index small and loses nothing.

Only texts go to Python, and documents are not shuffled for it. Phrases go to the tasks in blocks of
at most ``block_bytes`` of item text, one block in one pass, so what is broadcast is bounded whatever
the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import broadcast_if_small, read, slices, staged

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words of a text that is not lower-cased yet, for the JVM.
WORD_TEXT = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
WINDOW = 10
SAMPLE_EVERY = 16
SHARD_WORDS = 500_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def phrases_of(items: list[tuple[int, str | None]], window: int) -> dict[tuple[bytes, ...], list[int]]:
    """Each distinct test phrase with the items that have it."""
    found: dict[tuple[bytes, ...], list[int]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners = found.setdefault(tuple(words[i : i + window]), [])
            if not owners or owners[-1] != item:
                owners.append(item)
    return found


class Phrases:
    """A block of test phrases over its own alphabet 1..n."""

    def __init__(self, items: list[tuple[int, str | None]], window: int) -> None:
        found = phrases_of(items, window)
        self.codes = {w: i + 1 for i, w in enumerate(sorted({w for p in found for w in p}))}
        self.shortest = min(map(len, found), default=0)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for phrase in found:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.groups, owners = [], []
        for length, phrases in sorted(by_length.items()):
            self.groups.append((len(owners), np.array([[self.codes[w] for w in p] for p in phrases], np.int64).reshape(-1, length)))
            owners += [found[p] for p in phrases]
        self.owner_start = np.concatenate([[0], np.cumsum([len(x) for x in owners], dtype=np.int64)])
        self.owners = np.array([i for x in owners for i in x], np.int64)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order. A zero ends every comparison; equal suffixes up to it go by position."""
    n, bits = len(symbols), max(1, int(symbols.max()).bit_length())
    width = max(1, 62 // bits)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(width):
        at = np.zeros(n, np.int64)
        at[: max(0, n - j)] = symbols[j:]
        alive &= at > 0
        key = (key << bits) | np.where(alive, at, 0)
    order = np.argsort(key, kind="stable")
    sorted_key, ended = key[order], ~alive[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | ended[1:]
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = np.cumsum(fresh) - 1, -1
    starts = np.flatnonzero(fresh)
    rank[order] = starts[rank[order]]
    done = width
    while True:
        size = np.diff(np.append(starts, n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        who = order[at]
        ahead = rank[np.minimum(who + done, n)]
        by = np.lexsort((ahead, rank[who]))
        who, ahead = who[by], ahead[by]
        order[at] = who
        same = np.zeros(len(at), bool)
        same[1:] = (rank[who[1:]] == rank[who[:-1]]) & (ahead[1:] == ahead[:-1])
        fresh[at] = ~same
        starts = np.flatnonzero(fresh)
        new = starts[np.cumsum(fresh) - 1]
        rank[order[at]] = new[at]
        done *= 2


class FMIndex:
    """Symbols above 0 can be searched; 0 separates. Ends with a 0."""

    def __init__(self, symbols: np.ndarray, sample_every: int = SAMPLE_EVERY) -> None:
        n = len(symbols)
        order = suffix_order(symbols)
        previous = np.where(order > 0, symbols[order - 1], 0)
        top = int(symbols.max())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.levels = []
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (previous >> level) & 1
            self.levels.append((level, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), n - int(ones.sum())))
            previous = np.concatenate([previous[ones == 0], previous[ones == 1]])
        starts = np.zeros(n, bool)  # a walk never has to step over a separator
        starts[0], starts[1:] = True, symbols[:-1] == 0
        kept = starts[order] | (order % sample_every == 0)
        self.kept, self.kept_before, self.samples = kept, np.cumsum(kept) - 1, order[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the Burrows-Wheeler string before its row."""
        lo = np.zeros(len(row), np.int64)
        for level, ones, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            row = np.where(one, zeros + ones[row], row - ones[row])
        return row - lo

    def symbol(self, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(row), np.int64)
        for _, ones, zeros in self.levels:
            one = ones[row + 1] > ones[row]
            out = (out << 1) | one
            row = np.where(one, zeros + ones[row], row - ones[row])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns of one length: those found, with their first and last row."""
        last = len(self.before) - 1
        which = np.flatnonzero((patterns < last).all(axis=1))
        symbol = patterns[which, -1] if len(which) else np.zeros(0, np.int64)
        lo, hi = self.before[symbol], self.before[symbol + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            live = hi > lo
            which, lo, hi = which[live], lo[live], hi[live]
            symbol = patterns[which, j]
            lo, hi = self.before[symbol] + self.rank(symbol, lo), self.before[symbol] + self.rank(symbol, hi)
        live = hi > lo
        return which[live], lo[live], hi[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            hit = self.kept[rows]
            out[todo[hit]] = self.samples[self.kept_before[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol = self.symbol(rows)
            rows = self.before[symbol] + self.rank(symbol, rows)
            steps += 1
        return out


def occurrences(codes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences in ``codes`` (0: no known word): phrase, place of its first word, length."""
    none = np.zeros(0, np.int64)
    known = np.concatenate([[False], codes > 0, [False]])
    first, end = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(~known[1:] & known[:-1])
    long_ = end - first >= max(1, phrases.shortest)
    first, end = first[long_], end[long_]
    if not len(first):
        return none, none, none
    step = end - first + 1
    at = np.arange(step.sum()) - np.repeat(np.cumsum(step) - step, step) + np.repeat(first, step)
    symbols = np.where(at < np.repeat(end, step), codes[np.minimum(at, len(codes) - 1)], 0)
    index = FMIndex(symbols)
    found = []
    for base, patterns in phrases.groups:
        which, lo, hi = index.search(patterns)
        if len(which):
            n = hi - lo
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append((np.repeat(which + base, n), at[index.locate(rows)], np.full(len(rows), patterns.shape[1], np.int64)))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (none, none, none)


def _shard(docs: list[np.ndarray], phrases: Phrases) -> list[dict]:
    """Spans (merged, in words) and items of the documents of one shard, given by the codes of their words."""
    size = np.array([len(x) for x in docs], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)])  # a gap after each document
    whole = np.zeros(start[-1], np.int64)
    for s, codes in zip(start, docs, strict=False):
        whole[s : s + len(codes)] = codes
    phrase, place, length = occurrences(whole, phrases)
    mark = np.zeros(start[-1] + 1, np.int64)
    np.add.at(mark, place, 1)
    np.add.at(mark, place + length, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    doc = np.searchsorted(start, place, side="right") - 1
    n = phrases.owner_start[phrase + 1] - phrases.owner_start[phrase]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.owner_start[phrase], n)
    pairs = np.unique(np.stack([np.repeat(doc, n), phrases.owners[at]], axis=1), axis=0)
    cut, spans_cut = np.searchsorted(pairs[:, 0], np.arange(len(docs) + 1)), np.searchsorted(begins, start)
    rows = []
    for i, codes in enumerate(docs):
        of = slice(spans_cut[i], spans_cut[i + 1])
        spans = np.stack([begins[of], ends[of]], axis=1) - start[i]
        rows.append({"n_words": len(codes), "spans": spans.tolist(), "items": pairs[cut[i] : cut[i + 1], 1].tolist()})
    return rows


def _without(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "replace")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, done = [], 0
    for b, e in spans:
        out.append(raw[done : at[b][0]])
        done = at[e - 1][1]
    return b"".join([*out, raw[done:]]).decode()


_FOUND = "n_words long, spans array<array<long>>, items array<long>, cut string"
_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64())), ("cut", pa.string())])


def _search(phrases: Broadcast, shard_words: int, clean: bool = False) -> Callable:
    """A column function: what a block of phrases finds in each text, and when ``clean`` the text without it if there is any.

    A shard never spans Arrow batches.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows, shard, held = [], [], 0
            for part in slices(batch):
                for text in part.to_pylist():
                    words = words_of(text)
                    shard.append(np.fromiter(map(phrases.value.codes.get, words, repeat(0)), np.int32, len(words)))
                    held += len(shard[-1]) + 1
                    if held >= shard_words:
                        rows += _shard(shard, phrases.value)
                        shard, held = [], 0
            if shard:
                rows += _shard(shard, phrases.value)
            for i, row in enumerate(rows if clean else ()):
                row["cut"] = _without(batch[i].as_py(), row["spans"]) if row["spans"] else None
            yield pa.array(rows, _FOUND_TYPE)

    return F.arrow_udf(run, _FOUND).asNondeterministic()


def _cut(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts of documents with spans, without them; null for the others."""
    for text, spans in texts:
        yield pa.array([_without(t, s) if s else None for a, b in zip(slices(text), slices(spans), strict=True) for t, s in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[int, Broadcast]]:
    """The number of blocks with each: phrases of at most about ``block_bytes`` of text, ready for the tasks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items
        yield n, spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()], window))


def _merged(spans: Column) -> Column:
    """Spans in order, overlapping and touching ones as one."""
    none = F.array().cast("array<array<bigint>>")

    def step(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = F.coalesce(x[0] <= last[1], F.lit(False))
        longer = F.array(last[0], F.greatest(last[1], x[1]))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), none, step)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keep: tuple[str, ...] = ("doc_id",),
    clean: bool = False,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Occurrences of benchmark windows in every document.

    ``docs`` needs ``text`` and the columns of ``keep``; ``benchmark`` needs item_id and text. Other
    columns are ignored, and columns of ``keep`` that are named like a result give way. Returns the
    columns of ``keep``, n_words, n_hit, n_items, items (sorted as strings, comma-joined), spans
    (merged, in words, end exclusive) and clean_text (the text without the spans when ``clean``, else
    null). A null text has no words and its clean_text is null; an empty benchmark hits nothing;
    repeated rows each get their row; an item without id or words is no item. A shard holds whole
    documents: one more than ``shard_words`` long is a shard of its own.

    A benchmark of several blocks takes one pass over the documents for each. Passes keep what they
    find by the text's SHA-256, so that equal texts share it, and one join brings it together.
    """
    names = [c for c in keep if c not in ("n_words", "n_hit", "n_items", "items", "spans", "clean_text")]
    given = docs.select(*names, F.col("text").alias("__text"))
    passes = []
    for n, block in _blocks(benchmark, window, block_bytes):
        found = _search(block, shard_words, clean and n == 1)(F.col("__text"))
        if n == 1:
            marked = given.withColumn("__f", found)
            break
        texts = given.select("__text").where("__text is not null")
        part = texts.select(F.sha2("__text", 256).alias("__sha"), found.alias("f")).where(F.size("f.spans") > 0)
        passes.append(staged(part.select("__sha", "f.spans", "f.items").dropDuplicates(["__sha"])))
        block.destroy()
    else:
        union = reduce(DataFrame.unionByName, passes).groupBy("__sha").agg(_merged(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
        n_words = F.when(F.col("__text").isNull(), 0).otherwise(F.regexp_count("__text", F.lit(WORD_TEXT))).cast("long")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
        joined = given.withColumn("__sha", F.sha2("__text", 256)).join(broadcast_if_small(staged(union), 100_000, "1 + size(s) + size(i)"), "__sha", "left")
        marked = joined.withColumn("__f", F.struct(n_words.alias("n_words"), none("s", "array<array<bigint>>").alias("spans"), none("i", "array<bigint>").alias("items"))).drop("s", "i", "__sha")
        again = F.arrow_udf(_cut, "string")(F.when(F.size("__f.spans") > 0, F.col("__text")), F.col("__f.spans")) if clean else F.lit(None).cast("string")
        marked = marked.withColumn("__f", F.col("__f").withField("cut", again))
    items, spans = F.array_sort(F.col("__f.items").cast("array<string>")), F.col("__f.spans")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    cut = F.coalesce("__f.cut", "__text") if clean else F.lit(None).cast("string")
    return marked.select(*names, F.col("__f.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.array_join(items, ",").alias("items"), spans.alias("spans"), cut.alias("clean_text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the occurrences of every benchmark window in every document."""
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
