"""Periodic runs of words, by uniting suffix classes in the order of falling common prefixes.

The suffixes of a document's words are sorted, and neighbours in that order are edges weighted by
their longest common prefix (LCP). As in Kruskal's algorithm the edges are taken from the longest on,
and union-find joins the classes of positions whose suffixes share so many words; each class keeps
its positions in order. When a union makes two positions neighbours, they share exactly that many
words; if they are no farther apart than that, the words between are a period. The pair is the seed of
a run: it ends where the common prefix ends, and it begins at the pair's first position if the word
before breaks the period. Every run comes out once: its first word and the one a period later share
all but a period of the run, and no position between them can be in their class, as that would be a
shorter period. A document is one row, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, slices

#: A run has at least so many words, and twice its period.
LEAST_WORDS = 12
_CHUNK = 2048

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


class _Positions:
    """An ordered set of positions in sorted chunks, so that an insertion moves few of them."""

    def __init__(self, first: int) -> None:
        self.chunks, self.lows, self.n = [[first]], [first], 1

    def add(self, x: int) -> None:
        k = max(0, bisect_left(self.lows, x) - 1)
        chunk = self.chunks[k]
        insort(chunk, x)
        self.lows[k] = chunk[0]
        self.n += 1
        if len(chunk) > _CHUNK:
            half = len(chunk) // 2
            self.chunks[k : k + 1] = chunk[:half], chunk[half:]
            self.lows.insert(k + 1, self.chunks[k + 1][0])

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of a member; -1 where there is none."""
        k = max(0, bisect_left(self.lows, x + 1) - 1)
        chunk = self.chunks[k]
        i = bisect_left(chunk, x)
        before = chunk[i - 1] if i else (self.chunks[k - 1][-1] if k else -1)
        after = chunk[i + 1] if i + 1 < len(chunk) else (self.chunks[k + 1][0] if k + 1 < len(self.chunks) else -1)
        return before, after

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk


def _suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the LCP of each with the next, by doubling the words that ranks tell apart."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, width = [], 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32))
        order = np.argsort(rank, kind="stable")
        if width >= n or len(np.unique(rank)) == n:
            break
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
    a, b, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in reversed(range(len(levels))):
        x, y = np.minimum(a + common, n), np.minimum(b + common, n)
        common[levels[k][x] == levels[k][y]] += 1 << k
    return order, common


def _repeats(codes: np.ndarray, width: int) -> bool:
    """Whether any ``width`` words may stand twice in the text (equal by a 64-bit sum)."""
    if len(codes) <= width:
        return False
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for j in range(width):
        h = (h ^ codes[j : len(codes) - width + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def periodic_runs(codes: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` and two periods, by start, then period."""
    shared = (least + 1) // 2  # a run of length n and period q has n - q >= max(q, least - q) words twice
    if not _repeats(codes, shared):
        return []
    order, common = _suffixes(codes)
    word, runs = codes.tolist(), []
    parent: dict[int, int] = {}
    members: dict[int, _Positions] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    edges = np.flatnonzero(common >= shared)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    for left, right, n in zip(order[edges].tolist(), order[edges + 1].tolist(), common[edges].tolist(), strict=True):
        a, b = root(left), root(right)
        small, large = members.pop(a, None) or _Positions(a), members.pop(b, None) or _Positions(b)
        if small.n > large.n:
            a, b, small, large = b, a, large, small
        parent[a], members[b] = b, large
        mine = list(small)
        for x in mine:
            large.add(x)
        own = set(mine) if len(mine) > 1 else ()
        for x in mine:
            before, after = large.around(x)
            for i, j in ((before, x), (x, after)):
                if i < 0 or j < 0 or (own and i in own and j in own):
                    continue
                q = j - i
                if q <= n and n + q >= least and (i == 0 or word[i - 1] != word[j - 1]):
                    runs.append((i, n + q, q))
    return sorted(runs)


def _read_text(text: bytes | None, least: int) -> dict:
    words = text.split() if text else []
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    runs = periodic_runs(codes, least)
    if runs:
        again = np.zeros(len(words) + 1, np.int32)
        for start, length, period in runs:
            again[start + period] += 1
            again[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(again[:-1]).tolist(), strict=True) if not n]
    return {"n_words": len(codes), "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": b" ".join(words)}


def find_periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS) -> DataFrame:
    """The periodic runs of every text, and the text without their repetitions.

    ``docs`` needs text and the columns of ``keep``, of which n_words, runs and collapsed give way; other
    columns are ignored. A run is a longest stretch of words of which those a smallest period apart are
    equal, of at least ``least`` words and two periods. Returns the columns of ``keep``, n_words, runs (array of
    start, length, period in words, by start, then period) and collapsed: the words joined by one space,
    without those of any run after its first period. A null text, an empty one or one without words has no
    words, no runs and collapses to the empty text; repeated rows each get their row.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_read_text(t.as_py(), least) for part in slices(batch, 64) for t in part]
            yield pa.array([p | {"collapsed": p["collapsed"].decode()} for p in parts], _FOUND)

    find = F.arrow_udf(run, "n_words long, runs array<struct<start long, length long, period long>>, collapsed string").asNondeterministic()
    keep = tuple(c for c in keep if c not in ("n_words", "runs", "collapsed"))
    found = docs.select(*keep, find(F.col("text").cast("binary")).alias("__found"))
    return found.select(*keep, "__found.n_words", "__found.runs", "__found.collapsed")


def _with_repetitions(docs: DataFrame) -> DataFrame:
    """The query's input: a tenth of the documents, by a checksum of their id, repeat a stretch of words to their end."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sums in batches:
            out = []
            for text, g in zip(texts, sums.to_pylist(), strict=True):
                words = text.as_py().split() if text.is_valid else []
                if words:
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    tail = words[a : a + p]
                    words = words[:a] + (tail * (1 + (len(words) - a) // p))[: len(words) - a]
                out.append(b" ".join(words).decode())
            yield pa.array(out, pa.string())

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))  # a row without id stays as it is
    repeat = F.arrow_udf(run, "string").asNondeterministic()
    again = repeat(F.when(chosen, F.col("text").cast("binary")), F.floor(h / 10).cast("long"))
    return docs.select("doc_id", F.when(chosen, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_periodic_runs(_with_repetitions(read(spark, sf_dir, "documents")))
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.withColumn("__longest", longest)
    length, period = F.col("__longest.length"), -F.col("__longest.p")
    return out.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("__longest.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
