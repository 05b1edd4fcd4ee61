"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two signature values, its minimum and its
maximum, so half the hash evaluations give a signature of the same length. Documents with equal
sets form one class; only class representatives are banded. Within a band's bucket every member is
paired with the bucket's smallest id (a star, never all pairs) and links are confirmed on full
sets. Buckets that then still span several components are looked at once more: members outside
the bucket's largest component against members of other components, behind an exact bound from set
bitmaps, so that only pairs that can reach the similarity leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, slices, staged

BANDS, ROWS = 32, 4
BITMAP_LONGS = 16
_SEED = 20_241


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the ``width``-word shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j : len(h) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    n = BANDS * ROWS // 2
    return rng.integers(0, 2**63, n, np.uint64) * 2 + 1, rng.integers(0, 2**63, n, np.uint64)


def band_keys(hashes: np.ndarray, permutations: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """One 64-bit key per band of the min-max signature."""
    a, b = permutations
    low, high = np.full(len(a), 2**32 - 1, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(hashes), 2048):
        v = ((hashes[None, i : i + 2048] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    both = np.concatenate([low, high]).reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - 2**63 for i, row in enumerate(both)]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_LONGS * 64, np.uint8)
    bits[(hashes % np.uint64(BITMAP_LONGS * 64)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n, key of the whole set, band keys and bitmap."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        permutations = _permutations()
        for batch in batches:
            rows = []
            for part in slices(batch):
                for text in part.to_pylist():
                    h = shingles(text, width)
                    some = len(h) > 0
                    rows.append({"n": len(h), "key": xxhash.xxh3_128_digest(h.tobytes()), "bands": band_keys(h, permutations) if some else None, "bits": bitmap(h) if some else None})
            yield pa.array(rows, _SET)

    sets = F.arrow_udf(run, "n long, key binary, bands array<long>, bits array<long>").asNondeterministic()
    return docs.select("doc_id", sets("text").alias("s")).select("doc_id", "s.*")


_SET = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    pairs = staged(pairs)
    ids = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = staged(docs.join(ids, "doc_id", "left_semi"))
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")  # sorted by a; the same plan at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, 64):
                keep = []
                for a, left, right in zip(part[0].to_pylist(), part[2], part[3], strict=True):
                    if a != last:
                        last, mine = a, shingles(left.as_py(), width)
                    other = shingles(right.as_py(), width)
                    near = 100 * min(len(mine), len(other)) >= percent * max(len(mine), len(other))
                    if near:
                        common = len(np.intersect1d(mine, other, assume_unique=True))
                        near = 100 * common >= percent * (len(mine) + len(other) - common)
                    keep.append(near)
                yield pa.record_batch([part[0], part[1]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(both.mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of the edges (a, b), by alternating large and small stars.

    Each step joins vertices with the smallest neighbour, so no neighbourhood is ever collected.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = None
    while True:
        e = staged(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("a").alias("v"), F.col("b").alias("component")).union(e.select("b", "b")).distinct()
        state = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        e = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest).distinct()


def _can_reach(percent: int) -> Column:
    """Whether sets o and y can be as similar as asked, from sizes and then bitmaps."""

    def reach(common: Column) -> Column:  # 100 c >= percent (n + m - c)
        return (100 + percent) * common >= percent * (F.col("o.n") + F.col("y.n"))

    both = [F.bit_count(F.col(f"o.w{i}").bitwiseAND(F.col(f"y.w{i}"))) for i in range(BITMAP_LONGS)]
    shared = sum(both[1:], both[0])  # a bit of one set that the other lacks is a shingle that the other lacks
    return reach(F.least(F.col("o.n"), F.col("y.n"))) & reach(F.least(F.col("o.spare"), F.col("y.spare")) + shared)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The component of every document under links of at least ``percent`` % set similarity.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_shingles,
    component_id and kept. A null text or one without words has an empty set and is its own
    component; repeated rows share a component and each get their row; a row without id takes the
    component of a row with the same set, or none, and then is kept. An empty table gives no rows.
    A link is missed only if no band of ``BANDS`` agrees: below 1e-7 at 80 %.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(_sets(docs, width))
    classes = staged(sets.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")))
    reps = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.where("n > 0").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("h"))
    buckets = banded.groupBy("h").agg(F.min("rep").alias("center"), F.max("rep").alias("most")).where("center <> most")
    members = staged(banded.join(buckets, "h").select("h", "rep", "center"))
    links = _confirmed(members.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), docs, width, percent)
    labels = staged(components(links))

    labelled = staged(members.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("h", "rep", F.coalesce("component", "rep").alias("c")))
    sizes = labelled.groupBy("h", "c").agg(F.count("*").alias("k"))
    several = sizes.groupBy("h").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    words = [F.col("bits")[i].alias(f"w{i}") for i in range(BITMAP_LONGS)]
    spare = F.col("n") - F.aggregate("bits", F.lit(0), lambda a, b: a + F.bit_count(b))  # shingles that share a bit with another
    bits = reps.select(F.col("doc_id").alias("rep"), "n", spare.alias("spare"), *words)
    open_ = staged(labelled.join(several.select("h", "main"), "h").join(bits, "rep"))
    odd = open_.where("c <> main").alias("o")
    across = F.expr("o.h = y.h and o.c <> y.c and (y.c = y.main or o.rep < y.rep)") & _can_reach(percent)
    more = odd.join(open_.alias("y"), across).select(F.least("o.rep", "y.rep").alias("a"), F.greatest("o.rep", "y.rep").alias("b")).distinct()
    more = _confirmed(more, docs, width, percent)
    if not more.isEmpty():
        labels = staged(components(more.union(labels.select(F.col("component").alias("a"), F.col("v").alias("b")))))

    of_class = staged(classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("found")))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(of_class, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)
