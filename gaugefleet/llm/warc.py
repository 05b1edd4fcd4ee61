"""WARC archives: writing with revisit records, and reading verified by boundary chains.

Records end with two line breaks, so Spark's text writer, with that as its line separator, writes
plain archives. Reading splits the files at the record magic, wherever it stands: each task emits
the offset of every candidate record and that of its successor, taken from its length header.
Starting at each file's first byte, pointer jumping doubles the reachable part of the chain each
round; candidates it never reaches are magic inside payloads, and belong to the record around them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import read, shared_folder, staged

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 8192
_ID = "urn:x-page:"
_DATE = "2024-01-01T00:00:00Z"
_HEADER = re.compile(rb"(?:\A|\r\n)([A-Za-z-]+):[ \t]*([^\r]*)")


def base32_sha1(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1 (20 bytes: 32 characters, no padding)."""

    def run(given: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in given:
            yield part.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode(), na_action="ignore")

    return F.pandas_udf(run, "string")(hex_digest)


def digests(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Small tables only: (page_id, n, sha1) of every page, and (page_id, sha1, refers_to) of revisits."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    all_ = staged(pages.select("page_id", F.octet_length(payload).cast("long").alias("n"), F.sha1(payload).alias("sha1")))
    groups = all_.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    revisits = all_.join(groups, "sha1").where((F.col("page_id") != F.col("first")) & (F.col("n") >= min_bytes))
    return all_, staged(revisits.select("page_id", F.unhex("sha1").alias("sha1"), F.col("first").alias("refers_to")).distinct())


def _target(url: str) -> Column:
    """A url as a header field: no line breaks, and a blank where its end and the break after it would be a magic."""
    return F.regexp_replace(F.regexp_replace(url, r"[\r\n]", ""), r"WARC/1\.0\z", "WARC/1.0 ")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One WARC record per row of ``pages`` (page_id, url, html), in plain .txt part files.

    Among pages with equal payloads of at least ``min_bytes`` bytes that with the smallest page_id is
    a response, the others are revisits without payload. A null html is an empty payload, a null url
    an empty target; rows without page_id are never revisits and are written with an empty id. Rows
    of one page_id are records of their own; of those with equal payloads every one is what the first is.
    """
    _, revisits = digests(pages, min_bytes)
    payload = F.coalesce("html", F.lit(""))
    body = F.when(F.col("refers_to").isNull(), payload).otherwise("")
    lines = [
        F.when(F.col("refers_to").isNull(), "WARC-Type: response").otherwise("WARC-Type: revisit"),
        F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(_target("url"), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.octet_length(payload)),
        F.concat(F.lit(f"WARC-Refers-To: <{_ID}"), F.col("refers_to").cast("string"), F.lit(">")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), body)
    given = pages.select("page_id", "url", "html").withColumn("sha1", F.unhex(F.sha1(payload.cast("binary")))).join(revisits, ["page_id", "sha1"], "left")
    given = given.withColumn("digest", base32_sha1(F.hex("sha1")))
    given.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, in file order: file, split, nth, text."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value"
    )


def _parsed(raw: bytes) -> tuple[int, dict[str, str]] | None:
    """Bytes up to the block's start (magic not counted) and the headers; none if it is no record."""
    at = raw.find(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(raw[:at])} if at >= 0 else {}
    return (at + 4, fields) if fields.get("content-length", "").isdigit() else None


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every candidate record: file, offset, successor and, if its block is in one segment, its facts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, split, nth, text in zip(pdf["file"], pdf["split"], pdf["nth"], pdf["value"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                head = _parsed(raw)
                need = head[0] + int(head[1]["content-length"]) if head else None
                whole = head is not None and len(raw) >= need
                fact = _facts(head[1], raw[head[0] : need]) if whole else (None,) * 6
                rows.append((file, split, nth, len(raw), need, *fact))
            out = pd.DataFrame(rows, columns=["file", "split", "nth", "bytes", "need", *_FACTS])
            for c in ("need", "page_id", "n", "refers_to"):
                out[c] = out[c].astype("Int64")
            yield out

    schema = f"file string, split long, nth long, bytes long, need long, {_FACT_TYPES}"
    seen = staged(_segments(spark, path).mapInPandas(run, schema))
    after = F.col("offset") + len(MAGIC) + F.col("need") + len(END)
    return staged(_placed(seen).withColumn("successor", after))


def _placed(seen: DataFrame) -> DataFrame:
    """Adds the byte offset in its file to the segments of one staged scan; the stretch before the first magic starts before 0."""
    m = len(MAGIC)
    per_split = seen.groupBy("file", "split").agg(F.sum(F.col("bytes") + m).alias("size"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = per_split.select("file", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return seen.join(base, ["file", "split"]).withColumn("offset", F.col("base") + F.coalesce(F.sum(F.col("bytes") + m).over(inside), F.lit(0)) - m).drop("base")


_FACTS = ["page_id", "n", "digest", "type", "refers_to", "intact"]
_FACT_TYPES = "page_id long, n long, digest string, type string, refers_to long, intact boolean"


def _number(field: str | None) -> int | None:
    digits = (field or "").removeprefix(f"<{_ID}").removesuffix(">")
    return int(digits) if re.fullmatch(r"-?\d+", digits) else None


def _facts(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    found = base64.b32encode(hashlib.sha1(block).digest()).decode()
    if kind == "revisit":
        return _number(fields.get("warc-record-id")), int(fields.get("warc-payload-length", 0)), digest, kind, _number(fields.get("warc-refers-to")), not block
    return _number(fields.get("warc-record-id")), len(block), found, kind, None, found == digest


def reachable(found: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on each file's chain from its first byte."""
    points = found.where("need is not null").select("file", "offset", F.col("successor").alias("to"))
    points = points.join(points.select("file", F.col("offset").alias("to"), F.lit(True).alias("there")), ["file", "to"], "left")
    jump = staged(points.select("file", "offset", F.when(F.col("there"), F.col("to")).alias("to")))
    on = staged(jump.where("offset = 0").select("file", "offset"))
    while True:
        ahead = on.join(jump, ["file", "offset"]).where("to is not null").select("file", F.col("to").alias("offset"))
        grown = staged(on.union(ahead).distinct())
        if grown.count() == on.count():
            return grown
        on = grown
        far = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("far"))
        jump = staged(jump.where("to is not null").join(far, ["file", "to"], "left").select("file", "offset", F.col("far").alias("to")))
    return on


def _check_ends(found: DataFrame, chain: DataFrame) -> None:
    """Raise if the chain of some file does not end at its last byte, so that records would be missing."""
    reached = found.join(chain.withColumn("on", F.lit(True)), ["file", "offset"], "left")
    ends = reached.groupBy("file").agg(F.max(F.col("offset") + len(MAGIC) + F.col("bytes")).alias("end"), F.max(F.when(F.col("on"), F.col("successor"))).alias("reached"))
    short = ends.where(~F.col("end").eqNullSafe(F.col("reached"))).limit(3).collect()
    if short:
        raise ValueError("no whole chain of records: " + ", ".join(f"{r.file} ends at {r.end}, its chain at {r.reached}" for r in short))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of plain archives under ``path``: page_id, n, digest, type, refers_to, intact.

    n and digest are those of the full payload; a revisit declares them. ``intact`` tells whether the
    block has the declared digest. Empty files have no records; a file whose records do not follow one
    another to its last byte raises ValueError.
    """
    found = candidates(spark, path)
    chain = reachable(found)
    _check_ends(found, chain)
    mine = found.join(chain, ["file", "offset"])
    plain = mine.where("type is not null").select(*_FACTS)
    # Blocks with magic inside: the segments of their files are read again, once into a table, and put together record by record.
    broken = staged(mine.where("type is null").select("file", "offset", "successor"))
    if broken.isEmpty():
        return plain
    files = staged(broken.select("file").distinct())
    again = staged(_segments(spark, path).join(files, "file", "left_semi"))
    placed = _placed(again.select("file", "split", "nth", F.octet_length("value").alias("bytes")))
    starts = broken.select("file", "offset", F.col("successor").alias("until"))
    by_file = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.last(F.when(F.col("until").isNotNull(), F.struct(F.col("offset").alias("record"), "until")), True).over(by_file)
    parts = placed.join(starts, ["file", "offset"], "left").withColumn("r", around).where(F.col("offset") < F.col("r.until"))
    texts = again.select("file", "split", "nth", "value").join(staged(parts.select("file", "split", "nth", "offset", "r.record")), ["file", "split", "nth"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = MAGIC.encode().join(t.encode("utf-8", "surrogatepass") for t in pdf.sort_values("offset")["value"])
        at, fields = _parsed(raw)
        out = pd.DataFrame([_facts(fields, raw[at : at + int(fields["content-length"])])], columns=_FACTS)
        return out.astype({c: "Int64" for c in ("page_id", "n", "refers_to")})

    return plain.unionByName(texts.groupBy("file", "record").applyInPandas(run, _FACT_TYPES))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_archives(read(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    return records.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "intact")
