"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are paths of block elements with their
classes. A node's presentation importance is the entropy of its child layouts over the host's
pages; its content importance falls with the entropy of its texts over them, so texts that many
pages share count little. Both are sums that Spark adds up over (node, layout or text), so a host
with a third of all pages is spread like any other. Landmarks that authors declare (article, main,
nav, class names) shift the importance by less than its range; branches of low importance are removed
from each page. Blocks of a declared nav, aside, form or listed class name are never main text.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import broadcast_if_small, read, staged

DECAY = 0.9
LEAST = 0.3
SHIFT = 0.2
# HTML elements that break lines, that hold no text, and that close one another.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe object svg math textarea select title canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Elements and words of class, id and role that mark what is not the article.
ASIDE_TAGS = frozenset("nav aside footer header form fieldset menu dialog button search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    path: str
    inside: int  # 1: in the article, -1: in what is not, 0: neither declared
    comment: bool
    layout: list[str] = field(default_factory=list)
    up: Node | None = None
    holds: bool = False  # an article stands in it


@dataclass
class Block:
    node: Node
    text: str


def _child(parent: Node | None, tag: str, attributes: str) -> Node:
    named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    marks = set(_WORD.findall(" ".join(named.values())))
    inside, comment = (parent.inside, parent.comment) if parent else (0, False)
    if tag == "main" or named.get("role") == "main":
        inside = 1
    elif marks & ASIDE_WORDS and tag not in ("html", "body"):
        inside, comment = -1, comment or bool(marks & {"comment", "comments", "disqus", "replies", "reply", "respond"})
    elif tag == "article" and not comment:
        inside = 1
    elif tag in ASIDE_TAGS and not (tag == "header" and inside == 1):
        inside = -1
    step = ".".join([tag, *sorted(named.get("class", "").split())])
    return Node(tag, f"{parent.path}>{step}" if parent else step, inside, comment, up=parent)


def parse(page: str | None) -> tuple[list[Block], list[Node]]:
    """Text blocks in page order, and all block elements."""
    page = page or ""
    root = Node("", "", 0, False)
    nodes, blocks, here, parts, at = [root], [], root, [], 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(here, text))
            parts.clear()

    def keep(text: str) -> None:
        parts.append(html_lib.unescape(text) if "&" in text else text)

    while m := _TAG.search(page, at):
        if m.start() > at:
            keep(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif not end and tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page) if tag in ("script", "style") else at
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if end:
                match = here
                while match is not root and match.tag != tag:
                    match = match.up
                here = match.up if match is not root else here
            else:
                if here.tag == "p":
                    here = here.up
                while here.tag in CLOSES.get(tag, ()):
                    here = here.up
                here.layout.append(tag)
                child = _child(here if here is not root else None, tag, attributes)
                child.up = here
                nodes.append(child)
                if tag not in VOID:
                    here = child
    keep(page[at:])
    flush()
    return blocks, nodes[1:]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(host: str, path: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host} {path}") - 2**63


def _observations(pages: DataFrame) -> DataFrame:
    """Per page and node, once each: that it is there (kind 0), its texts (1) and its layouts (2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"], strict=True):
                host = host_of(url)
                if not host:
                    continue
                blocks, nodes = parse(page)
                keys = {n.path: _key(host, n.path) for n in nodes}
                for path, key in keys.items():
                    line = path.split(">")
                    rows.append((key, 0, 0, host, [keys.get(">".join(line[:i]), key) for i in range(1, len(line))]))
                rows += [(keys[p], 1, h, None, None) for p, h in {(b.node.path, xxhash.xxh3_64_intdigest(b.text) - 2**63) for b in blocks if b.node.path}]
                rows += [(keys[p], 2, h, None, None) for p, h in {(n.path, xxhash.xxh3_64_intdigest(" ".join(dict.fromkeys(n.layout))) - 2**63) for n in nodes}]
            yield pd.DataFrame(rows, columns=["node", "kind", "feature", "host", "above"])

    return pages.select("url", "html").mapInPandas(run, "node long, kind int, feature long, host string, above array<long>")


def node_importance(pages: DataFrame) -> DataFrame:
    """node, host, pages and importance (0 to 1) of every node of every host's style tree."""
    seen = _observations(pages).groupBy("node", "kind", "feature").agg(F.count("*").alias("df"), F.first("host", True).alias("host"), F.first("above", True).alias("above"))
    kind = lambda k, c: F.sum(F.when(F.col("kind") == k, c).otherwise(0.0))
    df = F.col("df").cast("double")
    sums = seen.groupBy("node").agg(
        F.first("host", True).alias("host"), F.first("above", True).alias("above"),
        kind(0, df).alias("m"), kind(1, F.lit(1.0)).alias("texts"), kind(1, F.log(df)).alias("shared"),
        kind(2, F.lit(1.0)).alias("styles"), kind(2, df).alias("laid"), kind(2, df * F.log(df)).alias("dlogd"),
    )
    sums = staged(sums)
    below = sums.where("texts > 0").select(F.explode(F.array_union(F.coalesce("above", F.array().cast("array<long>")), F.array("node"))).alias("node"), F.col("texts").alias("l"), F.when(F.col("m") > 1, F.col("shared") / F.log("m")).otherwise(0.0).alias("h"))
    content = below.groupBy("node").agg((1 - F.sum("h") / F.sum("l")).alias("content"))
    layout = F.when(F.col("m") > 1, (F.log("laid") - F.col("dlogd") / F.col("laid")) / F.log("m")).otherwise(1.0)
    weight = F.pow(F.lit(DECAY), F.greatest("styles", F.lit(1.0)))
    both = sums.join(content, "node", "left")
    return both.select("node", "host", F.col("m").alias("pages"), ((1 - weight) * layout + weight * F.coalesce("content", layout)).alias("importance"))


def extract_text(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    ``pages`` needs page_id, url and html; other columns are ignored. A null or empty html has the
    text "". A branch of one page only, or a null url, has nothing to compare: declared landmarks
    decide there. Elsewhere a branch needs the importance ``least``, ``SHIFT`` less in a declared
    article, and ``SHIFT`` more outside one on pages that declare one. Repeated rows each get their
    row. Equal pages of a host count as one page.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    given = pages.select("page_id", "url", "html").withColumn("host", host)
    known = node_importance(_distinct_pages(given)).where("pages > 1")
    level = F.when(F.col("importance") < least - SHIFT, 0).when(F.col("importance") < least, 1).when(F.col("importance") < least + SHIFT, 2).otherwise(3)
    low = staged(known.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("node", level.alias("level")))).alias("low")))
    fields = {f.name: f.dataType.simpleString() for f in given.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(u, h, {} if x is None else dict(x)) for u, h, x in zip(pdf["url"], pdf["html"], pdf["low"], strict=True)]
            out = pdf[["page_id", "url"]].astype(object).where(pdf[["page_id", "url"]].notna(), None)
            yield out.assign(text=texts, n_chars=[len(t) for t in texts])

    joined = given.join(low, "host", "left").select("page_id", "url", "html", "low")
    return joined.mapInPandas(run, f"page_id {fields['page_id']}, url string, text string, n_chars long")


def _distinct_pages(given: DataFrame) -> DataFrame:
    """Equal pages of a host once, that of the smallest page_id."""
    given = given.withColumn("__h", F.xxhash64("html"))
    copies = given.groupBy("host", "__h").agg(F.min("page_id").alias("__first"), F.count("*").alias("k")).where("k > 1").drop("k")
    return given.join(broadcast_if_small(staged(copies)), ["host", "__h"], "left").where("__first is null or page_id = __first")


def main_text(url: str | None, page: str | None, low: Mapping[int, int] | set[int]) -> str:
    """Blocks whose branch is important. ``low`` has the level of each branch that several pages of the host have:
    0 too low even in an article, 1 anywhere else, 2 outside the article of a page that declares one, 3 important."""
    blocks, nodes = parse(page)
    declared, host = any(n.inside == 1 for n in nodes), host_of(url)
    for n in nodes:
        while n.inside == 1 and n.up is not None and not n.up.holds:
            n = n.up
            n.holds = True
    doomed: dict[int, bool] = {}

    def removed(n: Node | None) -> bool:
        if n is None or not n.path:
            return False
        if id(n) not in doomed:
            doomed[id(n)] = removed(n.up) or level(n) < (1 if n.inside == 1 or n.holds else 3 if declared else 2)
        return doomed[id(n)]

    def level(n: Node) -> int:
        return low.get(_key(host, n.path), 3) if low else 3

    def kept(b: Block) -> bool:
        if b.node.inside < 0 or removed(b.node):
            return False
        return b.node.inside > 0 or not declared or (bool(low) and _key(host, b.node.path) in low)

    return "\n\n".join(b.text for b in blocks if b.node.tag != "head" and kept(b))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
