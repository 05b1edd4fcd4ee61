"""Personal data: pattern spans, and terms that disclose protected entities, in DataFrame operations.

Emails, IP addresses, card and phone numbers are protected entities. A term of a document with an
entity discloses it as far as the corpus says so: with document counts c, the pointwise mutual
information log(N c(e,t) / (c(e) c(t))) is compared with the entity's own information
log(N / c(e)). Terms that reach ``disclosure`` of it are removed in the documents that hold the
entity; entities are generalised to their kind. What a single mention holds is no statistic, so an
entity needs at least ``support`` witnesses, and so does each pair; words within an entity are no terms. A witness is a distinct wording
around the entity: copies and near copies of one document repeat it and are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import read, staged

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.9
SUPPORT = 2
WORDING_CHARS = 60
#: The patterns, with starts inside a run ruled out (a run's start decides) and no backtracking.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap sign without which a text has no span of the kind.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_WORD = r"[\p{L}][\p{L}\p{N}_'-]*+"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def matches(text: Column, pattern: Column, kind: str, group: int = 0) -> Column:
    """Matches of a pattern (or of the group at its end) with their places in code points, end exclusive. For patterns with few matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    values = F.regexp_extract_all(text, pattern, F.lit(group)) if group else found
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(n + F.coalesce(F.get(out, F.size(out) - 1), F.lit(0)))))
    span = lambda e, m: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))
    return F.zip_with(ends, values, span)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    sign = text.contains(SIGNS[kind]) if kind == "email" else text.rlike(SIGNS[kind])
    none = F.array().cast(_SPAN)
    return F.when(sign, F.filter(matches(text, F.lit(PATTERNS[kind]), kind), lambda s: _valid(kind, s["value"]))).otherwise(none)


def term(word: Column) -> Column:
    return F.lower(word)


def _with_entities(docs: DataFrame) -> DataFrame:
    """doc_id, sig and size (of the text), the spans by kind, and the entities with the wording around them."""
    df = docs.withColumns({k: base_spans(F.col("__text"), k) for k in KINDS})

    def around(s: Column) -> Column:
        left = F.substring(F.col("__text"), F.greatest(s["start"] + 1 - WORDING_CHARS, F.lit(1)), F.least(s["start"], F.lit(WORDING_CHARS)))
        right = F.substring(F.col("__text"), s["end"] + 1, F.lit(WORDING_CHARS))
        return F.struct(F.xxhash64(s["kind"], F.lower(s["value"])).alias("entity"), F.xxhash64(left, right).alias("wording"))

    entities = F.transform(F.concat(*KINDS), around)
    return df.select("doc_id", *_key(F.col("__text")), *KINDS, entities.alias("entities"))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("sig"), F.octet_length(text).alias("size")]


_KEY = ["sig", "size"]


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), term))


def disclosing_terms(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term) pairs over the disclosure threshold; ``found`` is the staged table of entities."""
    held = found.where(F.size("entities") > 0)
    met = held.select(*_KEY, F.explode("entities").alias("e")).select(*_KEY, "e.entity", "e.wording").distinct()
    known = staged(met.select("entity", "wording").distinct().groupBy("entity").agg(F.count("*").alias("w")).where(F.col("w") >= support).select("entity"))
    none = known.select("entity", F.lit("").alias("term")).limit(0)
    if known.isEmpty():
        return none
    met = staged(met.join(known, "entity"))
    copies = staged(held.groupBy(*_KEY).agg(F.count("*").alias("k")).join(met.select(*_KEY).distinct(), _KEY, "left_semi"))
    n = float(docs.count())
    c_e = staged(met.select(*_KEY, "entity").distinct().join(copies, _KEY).groupBy("entity").agg(F.sum("k").alias("c_e")))
    # c(e,t) <= c(e), so a term of more than N^(1-d) c(e)^d documents cannot reach d of the entity's information.
    most = c_e.agg(F.max(F.pow(F.lit(n), 1 - disclosure) * F.pow("c_e", F.lit(disclosure)))).first()[0]
    c_t = docs.select(F.explode(_terms(F.col("__text"))).alias("term")).groupBy("term").agg(F.count("*").alias("c_t")).where(F.col("c_t").between(support, most * 1.000001))
    in_texts = docs.select(*_key(F.col("__text")), "__text").join(copies, _KEY).dropDuplicates(_KEY).select(*_KEY, F.explode(_terms(F.col("__text"))).alias("term"))
    rare = staged(in_texts.join(c_t, "term"))
    pairs = rare.join(met, _KEY).groupBy("entity", "term", "wording", *_KEY).agg(F.first("c_t").alias("c_t"))
    pairs = pairs.join(copies, _KEY).groupBy("entity", "term", "wording").agg(F.sum("k").alias("k"), F.first("c_t").alias("c_t"))
    by_pair = pairs.groupBy("entity", "term").agg(F.count("*").alias("witnesses"), F.sum("k").alias("c_et"), F.first("c_t").alias("c_t")).where(F.col("witnesses") >= support)
    scored = by_pair.join(c_e, "entity").withColumn("c_et", F.least("c_et", "c_e", "c_t"))  # a text may hold an entity in several wordings
    gain = F.log(n * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    return scored.where((gain >= disclosure * F.log(n / F.col("c_e")) - 1e-9) & (F.col("c_e") < n)).select("entity", "term")


def _spans(docs: DataFrame, disclosure: float, support: int) -> DataFrame:
    """doc_id, sig, size and the spans by kind and of terms, for every row of ``docs`` (doc_id and __text)."""
    found = staged(_with_entities(docs))
    risky = staged(disclosing_terms(docs, found, disclosure, support))
    base = found.select("doc_id", *_KEY, *KINDS)
    if risky.isEmpty():
        return base.withColumn("term", F.array().cast(_SPAN))
    held = found.select(*_KEY, F.explode("entities.entity").alias("entity")).distinct().join(risky, "entity")
    held = held.groupBy(*_KEY).agg(F.collect_set("term").alias("terms"))
    held = staged(held.join(found.select(*_KEY, F.concat(*KINDS).alias("__base")).dropDuplicates(_KEY), _KEY))
    hit = docs.select(*_key(F.col("__text")), "__text").join(held, _KEY).dropDuplicates(_KEY)
    # A word is a run of letters, digits and _'- from its first letter on. Terms hold only these, and the dotted i of a lower-case \u0130.
    either = F.replace(F.array_join("terms", "|"), F.lit("i\u0307"), F.lit("\u0130"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_'-])[\p{N}_'-]*+((?iu:"), either, F.lit(r"))(?![\p{L}\p{N}_'-])"))
    apart = lambda s: ~F.exists("__base", lambda b: (s["start"] < b["end"]) & (s["end"] > b["start"]))
    spans = hit.select(*_KEY, F.filter(matches(F.col("__text"), pattern, "term", 1), lambda s: F.array_contains("terms", term(s["value"])) & apart(s)).alias("term"))
    return base.join(staged(spans), _KEY, "left").withColumn("term", F.coalesce("term", F.array().cast(_SPAN)))


def _given(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))


def find_personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Spans of personal data in every document: doc_id, email, ip, card, phone, term (arrays of spans).

    ``docs`` needs doc_id and text; other columns are ignored. A null text is empty and has no spans;
    repeated rows each get their row, rows of one id their own spans; an empty table gives no rows.
    """
    return _spans(_given(docs), disclosure, support).drop(*_KEY)


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id and text with entities generalised to their kind and disclosing terms removed, for every row."""
    given = _given(docs)
    spans = _spans(given, disclosure, support).drop("doc_id").dropDuplicates(_KEY)
    both = given.select("*", *_key(F.col("__text"))).join(spans, _KEY)
    ordered = F.array_sort(F.transform(F.concat(*KINDS, "term"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        named = F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        out = F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, s["start"] - acc["at"]), named)
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    text = F.aggregate(ordered, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, F.lit(2**31 - 1))))
    return both.select("doc_id", text.alias("text"))


def joined(*kinds: str) -> Column:
    """Spans as kind:start:end, by kind in the order given, then by start."""
    return F.array_join(F.concat(*[F.transform(F.col(k), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])) for k in kinds]), ",")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(*KINDS), 256).alias("base_sha256"), joined(*KINDS, "term").alias("spans"))
