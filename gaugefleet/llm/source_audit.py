"""How the words of each source differ from its language's, by chunk factorization.

White space parts texts into chunks, and no term crosses white space. So chunks are counted per
document, each globally distinct chunk is tokenized once, and its terms are joined back. Documents are
taken in parts of bounded size: a chunk's row has the documents of one part that hold it, with their
counts, so what is joined is a row for each part and chunk, not for each document and chunk, and a
chunk in a third of all documents is no hot key. The documents of a term are then the distinct ones
over its chunks in a part, summed over parts, as no document is in two.

Pairs of sources are compared in buckets of about ``BUCKET`` terms, each a small table of sources by
terms, whose sums are added up; no pair of rows is ever joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import read, staged, unstage

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that a term needs in a language, and terms of a group in the report.
LEAST_DOCUMENTS, TOP = 10, 10
BUCKET = 128
#: A part of a task's documents ends where it holds so many distinct chunks, bytes of text, or chunks in all.
_CHUNKS, _BYTES, _HELD = 900_000, 128 << 20, 10_000_000
#: So many documents of a term are one task's.
_SPREAD = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCALE = 1_000_000_000


def packed(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of documents, one after the other, as bytes: differences in groups of seven bits, and the bytes' starts and end."""
    v = np.diff(docs, prepend=0)
    v[starts] = docs[starts]
    size = 1 + sum((v >> shift > 0).astype(np.int8) for shift in (7, 14, 21, 28))
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    for j in range(5):
        more = np.flatnonzero(size > j)
        out[at[more] + j] = (v[more] >> 7 * j & 127) + 128 * (size[more] > j + 1)
    return out, np.append(at[starts], len(out))


def unpacked(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of lists that were packed, and how many each list has; ``ends`` are those of the lists' bytes."""
    last = np.flatnonzero(data < 128).astype(np.int32)
    at = np.append(np.int32(0), last[:-1] + np.int32(1))[: len(last)]
    size, v = (last - at + 1).astype(np.int8), np.zeros(len(last), np.int64)
    del last
    for j in range(5):
        more = np.flatnonzero(size > j)
        v[more] |= (data[at[more] + j].astype(np.int64) & 127) << 7 * j
    first = np.searchsorted(at, ends[:-1])
    n = np.diff(np.append(first, len(v)))
    total = np.cumsum(v)
    return total - np.repeat(total[first[n > 0]] - v[first[n > 0]], n[n > 0]), n


_COUNTED = pa.schema([("part", pa.int64()), ("chunk", pa.binary()), ("docs", pa.binary()), ("n_docs", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("number", pa.int32())])


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class _Part:
    """Documents of a part as they are read: the number of each chunk, and for each time that a document holds one the pair of both numbers."""

    def __init__(self, most: int) -> None:
        self.chunks = _Numbers()
        self.groups: dict[tuple[str, str], list[int]] = {}
        self.keys, self.n, self.size = np.empty(most, np.int64), 0, 0  # memory is taken as it is filled

    def add(self, lang: str, source: str, text: bytes) -> bool:
        """Take a document in, unless it is for the next part; an empty part takes any."""
        words = text.split()
        if not words:
            return True
        n, group = self.n + len(words), self.groups.get((lang, source))
        full = n > len(self.keys) or self.size > _BYTES or len(self.chunks) > _CHUNKS or (group[1] if group else len(self.groups) << 1) == 1 << 16
        if full and self.n:
            return False
        if n > len(self.keys):
            self.keys = np.empty(n, np.int64)
        group = self.groups.setdefault((lang, source), [len(self.groups), 0])
        keys = self.keys[self.n : n]
        keys[:] = np.fromiter(map(self.chunks.__getitem__, words), np.int64, len(words))
        keys <<= 32
        keys |= group[0] << 16 | group[1]
        group[1] += 1
        self.n, self.size = n, self.size + len(text)
        return True

    def written(self, part: int) -> Iterator[pa.RecordBatch]:
        keys = self.keys[: self.n]
        keys.sort()
        new = np.append(True, keys[1:] != keys[:-1])
        starts = np.searchsorted(keys, np.arange(len(self.chunks)) << 32)
        n_docs = np.add.reduceat(new, starts, dtype=np.int64)
        names = list(self.chunks)
        for i in range(0, len(names), 20_000):
            mine = starts[i : i + 20_000]
            end = starts[i + 20_000] if i + 20_000 < len(starts) else len(keys)
            data, ends = packed(keys[mine[0] : end] & 0xFFFFFFFF, mine - mine[0])
            held = pa.BinaryArray.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(data)])
            none = pa.nulls(len(mine), pa.string())
            yield pa.record_batch([pa.array(np.full(len(mine), part)), pa.array(names[i : i + 20_000], pa.binary()), held, pa.array(n_docs[i : i + 20_000]), none, none, pa.nulls(len(mine), pa.int32())], schema=_COUNTED)
        rows = len(self.groups)
        none, numbers = pa.nulls(rows, pa.binary()), pa.array([g[0] for g in self.groups.values()], pa.int32())
        yield pa.record_batch([pa.array(np.full(rows, part)), none, none, pa.nulls(rows, pa.int64()), *(pa.array(x, pa.string()) for x in zip(*self.groups, strict=True)), numbers], schema=_COUNTED)


def count_chunks(docs: DataFrame, most: int = _HELD) -> DataFrame:
    """(part, chunk, docs, n_docs, lang, source, number): the documents of a part that hold a chunk, once for each time that they do, and how many they are.

    A document is a number: the upper 16 bits are its group's number in the part, the lower its place there. Rows
    without chunk name the groups: lang, source and number. A part holds at most ``most`` words, or one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = TaskContext.get().partitionId() << 32, _Part(most)
        for batch in batches:
            for lang, source, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
                text = text.as_py()
                if not part.add(lang, source, text):
                    yield from part.written(number)
                    number, part = number + 1, _Part(most)
                    part.add(lang, source, text)
        if part.chunks:
            yield from part.written(number)

    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    rows = rows.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 4))  # larger parts have fewer rows for a chunk
    out = rows.mapInArrow(run, "part long, chunk binary, docs binary, n_docs long, lang string, source string, number int")
    return out.withColumn("chunk", F.col("chunk").cast("string"))


_IN_GROUP = pa.struct([("group", pa.int32()), ("docs", pa.int64()), ("n", pa.int64())])


def _slices(docs: pa.Array, times: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows that together hold about a megabyte of packed documents, and at least one."""
    size = np.zeros(len(docs), np.int64)
    lists = np.asarray(pa.compute.binary_length(docs.flatten()), np.int64)
    np.add.at(size, np.repeat(np.arange(len(docs)), np.asarray(docs.value_lengths())), lists)
    cut = np.flatnonzero(np.diff(np.cumsum(size) >> 20, prepend=0))
    for a, b in pairwise([0, *(cut[cut > 0].tolist()), len(docs)]):
        yield docs.slice(a, b - a), times.slice(a, b - a)


def _by_group(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of each row's lists of documents, and how often each list counts: the distinct documents and all occurrences, by group."""
    for batch in batches:
        yield pa.concat_arrays([_summed(*part) for part in _slices(*batch)])


def _summed(docs: pa.Array, times: pa.Array) -> pa.Array:
    lists = docs.flatten()
    ends = np.frombuffer(lists.buffers()[1], "<i4")[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, "<i4")
    data = np.frombuffer(lists.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(lists) else np.zeros(0, np.uint8)
    doc, size = unpacked(data, ends - ends[0])
    row = np.repeat(np.repeat(np.arange(len(docs)), np.asarray(docs.value_lengths())), size)
    keys = np.repeat((row << 32) + doc, np.repeat(np.asarray(times.flatten()), size))
    keys.sort()
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    group = keys >> 16
    at = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(keys)])
    found = [group[at] & 0xFFFF, np.add.reduceat(new.astype(np.int64), at) if len(at) else at, np.diff(np.append(at, len(keys)))]
    offsets = np.searchsorted(group[at] >> 16, np.arange(len(docs) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x.astype(t)) for x, t in zip(found, (np.int32, np.int64, np.int64), strict=True)], fields=list(_IN_GROUP)))


def term_counts(counted: DataFrame, least: int = 1, spread: int = _SPREAD) -> DataFrame:
    """(lang, source, term, docs, n) from counted chunks: documents of a group that have a term, and its occurrences there.

    A term whose chunks have fewer than ``least`` documents in all, counted once for each chunk, can't have so many, and
    is left out before documents are joined to it.
    """
    # Dealt by chunk once, for the dictionary and for the join: both read all columns, so that Spark shuffles them once.
    held = counted.where("chunk is not null").select("part", "chunk", "docs", "n_docs").repartition("chunk")
    found = F.regexp_extract_all(F.translate("chunk", _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    chunks = held.groupBy("chunk").agg(F.sum("n_docs").alias("n_docs"), F.sum(F.octet_length("docs")).alias("bytes"), F.min("part").alias("part")).where("bytes >= n_docs AND part >= 0")
    terms = chunks.select("chunk", "n_docs", F.explode(found).alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("k"), F.min("n_docs").alias("n_docs"))
    terms = terms.withColumn("in_all", F.sum("n_docs").over(Window.partitionBy("term"))).where(F.col("in_all") >= least)
    deals = F.floor(F.col("in_all") / spread) + 1  # a term of very many documents is dealt to several tasks, by part
    terms = terms.select("chunk", "term", "k", deals.alias("deals"))
    joined = held.join(terms.hint("shuffle_hash"), "chunk")
    docs = F.when(F.col("n_docs") > 0, F.col("docs")).alias("docs")
    joined = joined.select("part", "term", F.pmod(F.xxhash64("part"), "deals").alias("deal"), docs, "k").repartition("term", "deal")
    by_part = joined.groupBy("part", "term", "deal").agg(F.collect_list(F.struct("docs", "k")).alias("x"))  # at most what a part holds
    summed = F.arrow_udf(_by_group, "array<struct<group int, docs long, n long>>").asNondeterministic()
    of_group = by_part.select("part", "term", F.explode(summed("x.docs", "x.k")).alias("g")).select("part", "term", "g.*")
    groups = counted.where("chunk is null").select("part", F.col("number").alias("group"), "lang", "source")
    return of_group.join(groups, ["part", "group"]).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exactly; null where the language keeps no term."""
    wide = lambda c: c.cast("decimal(27,0)")
    below = F.nullif(wide(total) + wide(2 * terms), F.lit(0).cast("decimal(28,0)"))
    return F.lit(1).cast("long") + F.call_function("div", wide(count + 2) * F.lit(_SCALE).cast("decimal(10,0)"), below)


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)  # below 2^60


def _pairs(cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language, from ``cells`` (lang, bucket, source, term, p).

    A row without term gives the p of all terms of the bucket that the source lacks; every source has it in every bucket.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        sources, row = np.unique(np.array(table["source"].to_pylist(), object), return_inverse=True)
        there = np.array(table["term"].is_valid())
        terms, column = np.unique(np.array(table["term"].drop_null().to_pylist(), object), return_inverse=True)
        p = np.array(table["p"])
        lacking = np.zeros(len(sources), np.int64)
        lacking[row[~there]] = p[~there]
        cell = np.repeat(lacking[:, None], len(terms), axis=1)
        cell[row[there], column] = p[there]
        value = np.zeros((len(sources), len(sources)), np.int64)
        for i in range(len(sources) if len(terms) else 0):
            d = cell[i] - cell
            value[i] = (d * d // (cell[i] + cell)).sum(axis=1)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        lang = pa.array([table["lang"][0].as_py()] * len(a), pa.string())
        return pa.table([lang, pa.array(sources[a], pa.string()), pa.array(sources[b], pa.string()), pa.array(value[a, b])], schema=schema)

    parts = cells.groupBy("lang", "bucket").applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set each apart.

    ``docs`` needs text, lang and source; other columns are ignored; every row is a document, so repeated rows
    count each. Nulls there are read as the empty text. A term is a stretch of ASCII letters and characters beyond
    ASCII, with A-Z lower-cased; a language keeps those in at least ``least_documents`` of its rows. Returns
    lang, source, part, item, value and rank: part ``pair`` has every other source of the language, also of
    groups without terms (value 0 if none is kept), part ``term`` the ``top`` terms more frequent in the group than in
    its language, ranked by value, then item. No rows give no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = docs.select("lang", "source").distinct()
    counted, of_term = staged(count_chunks(docs)), Window.partitionBy("lang", "term")
    sums = {"all": F.sum("n").over(of_term), "in_docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1}
    cells = staged(term_counts(counted, least_documents).withColumns(sums).where(F.col("in_docs") >= least_documents).drop("docs", "in_docs"))
    unstage(counted)
    of_lang = cells.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    sizes = staged(sizes.withColumn("buckets", F.ceil(F.greatest("terms", F.lit(1)) / BUCKET)))

    sized = cells.join(sizes, ["lang", "source"])
    p, q = _p(F.col("n"), F.col("total"), F.col("terms")), _p(F.col("all"), F.col("lang_total"), F.col("terms"))
    sized = sized.select("lang", "source", "term", p.alias("p"), q.alias("q"), F.pmod(F.xxhash64("term"), "buckets").alias("bucket"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = sized.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    best = best.withColumn("rank", place).where(F.col("rank") <= top)

    lacking = F.coalesce(_p(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0).cast("long"))
    empty = sizes.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"), "source", F.lit(None).cast("string").alias("term"), lacking.alias("p"))
    pairs = _pairs(sized.select("lang", "bucket", "source", "term", "p").union(empty))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    return pairs.union(best).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))
