"""Periodic runs, source audit and URL rules against brute force, with nulls, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugefleet.llm import periodic_runs as PR
from gaugefleet.llm import source_audit as SA
from gaugefleet.llm import url_filter as UF
from gaugefleet.llm.queries import queries

DATA = Path("/root/testdata/sf0.001")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_periods(w, least=12):
    """Every period on its own: stretches where words that far apart are equal, without a smaller period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q) and not any(all(w[i + k] == w[i + k + r] for k in range(n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def random_words(rng):
    n, k = rng.randrange(90), rng.choice((1, 2, 2, 3, 5))
    w = [rng.randrange(k) for _ in range(n)]
    if n > 4 and rng.random() < 0.5:
        p = rng.randrange(1, n // 2)
        a = rng.randrange(n - p)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_equal_a_search_by_periods():
    rng, found = random.Random(3), 0
    for _ in range(600):
        w = random_words(rng)
        got = PR.periodic_runs(np.array(w, np.int64))
        assert got == runs_by_periods(w)
        found += len(got)
    assert found > 300


def test_runs_of_long_texts():
    assert PR.periodic_runs(np.zeros(20_000, np.int64)) == [(0, 20_000, 1)]
    w = np.tile(np.arange(3000), 3)
    assert PR.periodic_runs(np.append(w, [7, 8, 9])) == [(0, 9000, 3000)]


def test_positions_stay_in_order_over_chunks():
    rng, there = random.Random(5), {10_000}
    s = PR._Positions(10_000)
    for x in rng.sample(range(10_000), 7000):
        s.add(x)
        there.add(x)
    assert list(s) == sorted(there) and len(s.chunks) > 2
    order = sorted(there)
    for i in (0, 1, 2047, 2048, 5000, len(order) - 1):
        assert s.around(order[i]) == (order[i - 1] if i else -1, order[i + 1] if i + 1 < len(order) else -1)


def test_periodic_runs_of_a_table(spark):
    rng = random.Random(8)
    texts = [" \n".join(f"wé{x}" for x in random_words(rng)) for _ in range(60)]
    rows = [(i, t, 1, "x") for i, t in enumerate([*texts, None, "", " \t", "a " * 12, "a " * 11, texts[0]])]
    rows += [rows[2], (None, "b c " * 6, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = PR.find_periodic_runs(docs, keep=("doc_id", "runs", "text")).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "n_words", "runs", "collapsed"]
    for r in got:
        w = SPACED.findall(r.text or "")
        runs = runs_by_periods(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(w), runs)
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert PR.find_periodic_runs(docs.limit(0)).collect() == []


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_periodic_runs_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    rows, found = queries()["op11_periodic_runs"](spark, str(DATA)).collect(), 0
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        w, h = SPACED.findall(texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if len(w) > 3000:
            continue  # too slow to search by periods
        runs = runs_by_periods(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (len(runs), *best, milli, *digests)
        found += len(runs)
    assert found > 10


def audit(rows, least):
    """The contract word by word, in Python's whole numbers."""
    docs = [tuple(x or "" for x in r[:3]) for r in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))
    seen, count, groups = Counter(), defaultdict(Counter), {(g, s) for g, s, _ in docs}
    for g, s, t in docs:
        w = terms(t)
        seen.update((g, x) for x in set(w))
        count[g, s].update(w)
    out = set()
    for g in {g for g, _ in groups}:
        kept = sorted(x for (h, x), n in seen.items() if h == g and n >= least)
        mine = sorted(s for h, s in groups if h == g)
        p = {}
        for s in [*mine, None]:
            c = Counter()
            for o in mine if s is None else [s]:
                c.update({x: count[g, o][x] for x in kept})
            n = sum(c[x] for x in kept)
            p[s] = {x: 1 + 10**9 * (c[x] + 2) // (n + 2 * len(kept)) for x in kept}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in mine:
            pairs = sorted(((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode(), o) for o in mine if o != s))
            best = sorted((-f(p[s][x], p[None][x]), x.encode(), x) for x in kept if count[g, s][x] and p[s][x] > p[None][x])[:10]
            out |= {(g, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)} | {(g, s, "term", x, -v, i + 1) for i, (v, _, x) in enumerate(best)}
    return out


def test_source_audit(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "Ab«é" for b in ("one", "TWO", "thrée", "f-o", "x", "y2z")]
    rows = [(g, s, " \n".join(rng.choices(words[: rng.randrange(2, len(words))], k=rng.randrange(25)))) for g in ("en", "de", None) for s in ("a", "b", "é", None) for _ in range(40)]
    rows += [("fr", "a", "one"), ("fr", "b", None), ("it", "only", "x " * 30), rows[0], rows[0], ("en", "late", ""), ("en", "long", "word " * 9000)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    got = SA.audit_sources(docs).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == audit(rows, 10)
    assert SA.audit_sources(docs.limit(0)).collect() == []
    assert {r.value for r in got if r.lang == "fr"} == {0}


def test_chunks_are_counted_in_parts(spark):
    """Every document counts once for a term, whatever chunks hold it and wherever parts end."""
    rows = [("en", "a", f"Same, same d{i}") for i in range(150)] + [("en", "b", "same same.")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    want = {("a", "same"): (150, 300), ("b", "same"): (1, 2), ("a", "d"): (150, 150)}
    for held, spread in ((SA._HELD, SA._SPREAD), (40, 7)):
        counted = SA.count_chunks(docs, held)
        assert (counted.select("part").distinct().count() > 1) == (held == 40)
        assert counted.where("chunk is null").count() == counted.select("part").distinct().count() + 1
        assert {(r.source, r.term): (r.docs, r.n) for r in SA.term_counts(counted, 1, spread).collect()} == want


def test_packed_lists():
    rng = np.random.default_rng(6)
    for _ in range(30):
        lists = [np.sort(rng.integers(0, int(top), int(n))) for n, top in zip(rng.integers(1, 30, 40), 10.0 ** rng.integers(1, 10, 40), strict=True)]
        data, ends = SA.packed(np.concatenate(lists), np.cumsum([0, *(len(x) for x in lists[:-1])]))
        docs, n = SA.unpacked(data, ends)
        assert docs.tolist() == np.concatenate(lists).tolist() and n.tolist() == [len(x) for x in lists] and len(data) >= len(docs)
    assert [len(x) for x in SA.unpacked(np.zeros(0, np.uint8), np.zeros(1, np.int64))] == [0, 0]


URLS = [
    None, "", "no scheme", "://", "http://", "http://example.org", "http://example.org/", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/",
    "x://a.com/fr/", "x://a.com/fr", "x://com/de/1#/fr/", "x://com.net/de/", "x://A.b.CASINO-win.net/", "x://casino-win.com/fr/x", "x://casino-winner.net/", "x://é.org/ü", "a://b://c.org/", "x://a.com?/fr/", "x://" + "l." * 3000 + "org/" + "p" * 5000,
]


def verdict(url, rules, sites):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    block = any(x in sites for x in host.split("."))
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "block" if block else "allow")


def test_url_rules_and_sites(spark):
    rows = [(i, u, "x") for i, u in enumerate([*URLS, URLS[7]])]
    pages = spark.createDataFrame([*rows, rows[8], (None, URLS[9], "x")], "page_id long, url string, host string")
    rules, sites = UF._values(spark, "host, path, verdict", *UF.RULES), UF._values(spark, "label", *[(s,) for s in UF.SITES])
    got = UF.judge_urls(pages, rules, sites, keep=("page_id", "host", "url")).collect()
    assert len(got) == len(rows) + 2 and got[0].__fields__ == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == verdict(r.url, UF.RULES, UF.SITES)
    assert {r.verdict for r in got} == {"allow", "block"}
    assert UF.judge_urls(pages.limit(0), rules, sites).collect() == []
    bare = UF.judge_urls(pages, rules.limit(0), sites.limit(0)).collect()
    assert {(r.rule, r.verdict) for r in bare} == {(None, "allow")}


def test_random_rules(spark):
    rng = random.Random(4)
    hosts = [".".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(300)]
    paths = ["/" + "/".join(rng.choices(("x", "y", "xx"), k=rng.randrange(3))) for _ in range(300)]
    urls = [f"s://{h}{p}" for h, p in zip(hosts, paths, strict=True)]
    rules = sorted({(h, p): (h, p, rng.choice(("allow", "block"))) for h, p in zip(hosts[:40], paths[:40], strict=True)}.values())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = UF.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([("b",)], "label string"))
    for r in got.collect():
        host, path, rule, v = verdict(urls[r.page_id], rules, ("b",))
        assert (r.host, r.path) == (host, path) and len(r.rule or "") == len(rule or "")
        ties = {x for h, p, x in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) == len(rule or "")}
        assert r.verdict in ties if rule else r.verdict == v


def test_cascade_is_exact_and_has_levels(spark, monkeypatch):
    monkeypatch.setattr(UF, "BITS", 3)  # filters that let much through need more levels
    keys = spark.range(20_000).select(F.concat(F.lit("key"), "id").alias("key"), (F.col("id") % 10 == 0).alias("listed"))
    levels = UF.build_cascade(keys)
    wrong = keys.where(UF.is_listed(levels, F.col("key")) != F.col("listed")).count()
    assert wrong == 0 and len(levels) > 3
    assert UF.build_cascade(keys.where("not listed")) == []
    assert keys.where(UF.is_listed([], F.col("key"))).count() == 0
    full = UF.build_cascade(keys.where("listed"))
    assert len(full) == 1 and keys.where("listed").where(~UF.is_listed(full, F.col("key"))).count() == 0
