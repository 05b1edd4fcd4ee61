"""The registered queries on the smallest tables: against their SQL, or against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from gaugefleet.llm import pack as PK
from gaugefleet.llm import queries as Q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = Q.queries()[name](spark, str(DATA))
    cursor = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(cursor.fetchall())


def test_pack_holds_every_document(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PK.tokenizer_file())
    expected = Counter()
    for doc, text in documents.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.update((doc, k, b, len(part), zlib.crc32(part.tobytes())) for k, b in enumerate(range(0, len(ids), 2048)) for part in [ids[b : b + 2048]])
    rows = Q.queries()["op1_pack"](spark, str(DATA)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts) + 1)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_special_tokens_are_what_the_tokenizer_makes_of_them():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(PK.tokenizer_file()), PK.encoder()
    texts = ["hello <|endoftext|> x", "<|startoftext|>a b<|endoftext|>", "a<|ENDOFTEXT|>é 漢字 \n\t<|endoftext|", "<|", "x" * 100_000 + "<|endoftext|>", ""]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_quality_rule_columns(spark, documents):
    for r in Q.queries()["op3_quality_rules"](spark, str(DATA)).collect():
        text = documents[r.doc_id]
        w, lines, places = SPACED.findall(text), [x for x in text.split("\n") if SPACED.search(x)], defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        repeated = {k + j for v in places.values() if len(v) > 1 for k in v for j in range(8)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_personal_data_digests(spark, documents):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn) or (kind == "phone" and 8 <= len(digits) <= 15)

    found = 0
    for r in Q.queries()["op5_personal_data"](spark, str(DATA)).collect():
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, documents[r.doc_id]) if good(k, m[0])] for k, p in patterns.items()}
        text = ",".join(x for k in patterns for x in spans[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in patterns)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        found += len(text) > 0
    assert found


def test_quality_scores_and_folds(spark, documents):
    rows = Q.queries()["op7_quality"](spark, str(DATA)).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


@pytest.mark.parametrize("name", ["op4_extract", "op8_licences"])
def test_one_row_per_input(spark, name):
    table, key = {"op4_extract": ("pages", "page_id"), "op8_licences": ("documents", "doc_id")}[name]
    rows = Q.queries()[name](spark, str(DATA)).collect()
    ids = [r[0] for r in spark.read.parquet(str(DATA / f"{table}.parquet")).select(key).collect()]
    assert Counter(r[key] for r in rows) == Counter(ids)
    if name == "op4_extract":
        assert all(r.n_chars == len(r.text) for r in rows) and any(r.text for r in rows)
