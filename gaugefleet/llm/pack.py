"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces of one length are interchangeable, so the whole problem is the count of each length: at most
``capacity`` numbers, whatever the corpus holds. A chromosome is a multiset of bins, kept as bin
patterns with their multiplicities. Crossover injects whole well-filled bins of one parent into the
other, drops the other parent's bins whose pieces are then placed twice, and best-fits the displaced
pieces. Every island is a Spark task with its own population; after each epoch the islands pass
their elites to the next island. The best chromosome then deals its places to the pieces by their
rank within their length, which is counted per task and offset per task: no sort and no group of
one length in one task.
"""

from __future__ import annotations

import json
import os
import pickle
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import read, record_batch, slices, staged

CAPACITY = 2048
END_ID = 0
Pattern = tuple[tuple[int, int], ...]
Bins = dict[Pattern, int]


# --- token ids -----------------------------------------------------------------------------------

_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Texts of visible ASCII, white space, Latin letters and common marks: their lower case and normal form need no context.
_PLAIN = re.compile(rf"[\x09-\x0D\x20-\x7E\u00a1-\u00a9\u00ab-\u00ac\u00ae-\u00b1\u00b6\u00b7\u00bb\u00bf\u2010-\u2027\u20ac{_LETTERS}]*")
#: How the tokenizer splits such texts, in lower case, before it merges bytes.
_PIECE = re.compile(rf"[a-z{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\x09-\x0D\x20a-z0-9{_LETTERS}]+")
#: Bytes as the characters that stand for them: visible Latin-1 as it is, the others in order from 256 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
_BYTES = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: The splitting rule and normalizers of the tokenizer for which the patterns hold.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PIECE_CHARS = 64
_MEMO_ENTRIES = 120_000
_MET = 1 << 21
_PART_ROWS, _PART_CHARS = 256, 1_000_000
_loaded: dict[str, Callable] = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit bytes; one encoder per worker and file."""
    path = path or tokenizer_file()
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = _by_pieces(tokenizer) if _known(path) else _whole(tokenizer)
    return _loaded[path]


def _known(path: str) -> bool:
    """Whether the file has the rules that ``_PIECE`` states."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal, split = (rules.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    names = [x.get("type") for x in normal.get("normalizers", [])]
    patterns = [x.get("pattern", {}).get("Regex") for x in split.get("pretokenizers", [])]
    return names == _NORMALIZERS and patterns[:1] == [_RULE]


def _names_special(tokenizer) -> Callable[[str], bool]:
    """Whether a text may name one of the tokenizer's added tokens, in any case."""
    names = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if not names:
        return lambda text: False
    start, any_name = os.path.commonprefix(names), re.compile("|".join(map(re.escape, names)), re.I)
    start = start if start == start.lower() == start.upper() else ""
    return lambda text: start in text and any_name.search(text) is not None


def _whole(tokenizer) -> Callable[[list[str]], list[bytes]]:
    return lambda texts: [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class _Ids(dict):
    """Ids of pieces that recur. A piece is remembered when it is met again, in two generations: what is asked for
    after the younger was full moves up, the rest is forgotten."""

    def __init__(self, merge: Callable) -> None:
        super().__init__()
        self.merge, self.old, self.met, self.n_met = merge, {}, bytearray(_MET), 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        ids = array("I", [t.id for t in self.merge(raw)]).tobytes()
        place = hash(piece) % _MET
        if not self.met[place]:
            self.met[place] = 1
            self.n_met += 1
        elif len(piece) <= _PIECE_CHARS:
            self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > _MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        if self.n_met > _MET // 4:
            self.met, self.n_met = bytearray(_MET), 0


def _by_pieces(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """White space ends every token, so a text is the concatenation of its pieces; each is merged once and remembered.

    Other texts are cut at blanks and newlines, and chunks that aren't plain go to the tokenizer; texts that name a special token go there whole.
    """
    ids, special, whole = _Ids(tokenizer.model.tokenize), _names_special(tokenizer), _whole(tokenizer)
    of = ids.__getitem__

    def plain(text: str) -> bytes:
        return b"".join(map(of, _PIECE.findall(text.lower())))

    def encode(texts: list[str]) -> list[bytes]:
        odd: dict[int, list[str]] = {}
        out = []
        for i, t in enumerate(texts):
            if special(t):
                out += whole([t])
            elif _PLAIN.fullmatch(t):
                out.append(plain(t))
            else:
                odd[i] = t.replace("\n", " ").split(" ")
                out.append(b"")
        strange = {c: b"" for cs in odd.values() for c in cs if not _PLAIN.fullmatch(c)}
        chunks = list(strange)
        for k in range(0, len(chunks), 4096):
            part = chunks[k : k + 4096]
            for c, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                strange[c] = array("I", e.ids).tobytes()
        for i, cs in odd.items():
            out[i] = b"".join([strange[c] if c in strange else plain(c) for c in cs])
        ids.age()
        return out

    return encode


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a few rows and characters (a longer text is a part of its own)."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= _PART_ROWS or held + len(t) > _PART_CHARS):
            yield first, i
            first, held = i, 0
        held += len(t)
    if texts:
        yield first, len(texts)


def tokenize(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and task and nth.

    ``nth`` counts the pieces of one length within the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, _PART_ROWS):
                ids, texts, rows = part[0].to_pylist(), part[1].to_pylist(), []
                for a, b in _parts(texts):
                    for doc, raw in zip(ids[a:b], encode(texts[a:b]), strict=True):
                        raw += end
                        for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                            cut = raw[at : at + 4 * capacity]
                            n = len(cut) // 4
                            rows.append((doc, piece, at // 4, n, zlib.crc32(cut), task, seen[n]))
                            seen[n] += 1
                yield record_batch(rows, _PIECES)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])


# --- the grouping genetic algorithm ---------------------------------------------------------------


def best_fit(bins: Bins, left: dict[int, int], capacity: int, order: list[int]) -> Bins:
    """Place the pieces ``left`` (count by length), each into the fullest bin that takes it."""
    free: dict[int, Bins] = defaultdict(dict)
    room = np.zeros(capacity + 1, bool)

    def put(r: int, pattern: Pattern, n: int) -> None:
        if n:
            free[r][pattern] = free[r].get(pattern, 0) + n
            room[r] = True

    def added(pattern: Pattern, length: int, k: int) -> Pattern:
        have = dict(pattern)
        have[length] = have.get(length, 0) + k
        return tuple(sorted(have.items()))

    for pattern, n in bins.items():
        put(capacity - sum(a * c for a, c in pattern), pattern, n)
    for length in order:
        n = left.get(length, 0)
        while n:
            found = np.flatnonzero(room[length:])
            if not len(found):
                k = min(n, capacity // length)
                put(capacity - k * length, ((length, k),), n // k)
                n %= k
                continue
            r = length + int(found[0])
            pattern, m = free[r].popitem()
            room[r] = bool(free[r])
            k = min(n, r // length)
            take = min(m, n // k)
            put(r - k * length, added(pattern, length, k), take)
            put(r, pattern, m - take)
            n -= k * take
    out: Bins = defaultdict(int)
    for some in free.values():
        for pattern, n in some.items():
            out[pattern] += n
    return dict(out)


def crossover(giver: Bins, taker: Bins, counts: dict[int, int], capacity: int, rng: random.Random) -> Bins:
    left = dict(counts)
    child: Bins = defaultdict(int)

    def inject(pattern: Pattern, n: int) -> None:
        n = min([n, *(left[a] // c for a, c in pattern)])
        if n > 0:
            child[pattern] += n
            for a, c in pattern:
                left[a] -= n * c

    filled = {p: sum(a * c for a, c in p) for p in (*giver, *taker)}
    well = sorted(giver, key=lambda p: (-filled[p], rng.random()))
    for p in well[: rng.randint(1, max(1, len(well) // 2))]:
        inject(p, rng.randint(1, giver[p]))
    for p in sorted(taker, key=lambda p: (-filled[p], rng.random())):  # bins with pieces placed already lose copies
        if filled[p] >= capacity - rng.choice((0, 0, 1, 4, 16)):
            inject(p, taker[p])
    order = sorted((a for a in left if left[a]), reverse=True)
    return best_fit(child, left, capacity, order)


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the mean squared fill)."""
    return sum(bins.values()), -sum(n * (sum(a * c for a, c in p) / capacity) ** 2 for p, n in bins.items())


def first_chromosomes(counts: dict[int, int], capacity: int, n: int, rng: random.Random) -> list[Bins]:
    """Best fit by falling length, then with lengths disordered more and more."""
    lengths = sorted(counts, reverse=True)
    out = [best_fit({}, counts, capacity, lengths)]
    for i in range(1, n):
        noise = 1 + capacity * i / (8 * n)
        out.append(best_fit({}, counts, capacity, sorted(lengths, key=lambda a: -a - rng.random() * noise)))
    return out


def evolve(population: list[Bins], counts: dict[int, int], capacity: int, generations: int, rng: random.Random) -> list[Bins]:
    bound = -(-sum(a * c for a, c in counts.items()) // capacity)
    population = sorted(population, key=lambda b: fitness(b, capacity))
    for _ in range(generations):
        if sum(population[0].values()) <= bound:
            break
        pick = lambda: population[min(rng.randrange(len(population)), rng.randrange(len(population)))]
        child = crossover(pick(), pick(), counts, capacity, rng)
        if child not in population:
            population = sorted([*population, child], key=lambda b: fitness(b, capacity))[:-1]
    return population


def pack_counts(
    spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = 4, size: int = 6, generations: int = 8, epochs: int = 2, elites: int = 2, seed: int = 7
) -> Bins:
    """The best chromosome for the counts of lengths. Stops at the lower bound of bins."""
    if not counts:
        return {}
    bound = -(-sum(a * c for a, c in counts.items()) // capacity)
    given = spark.sparkContext.broadcast(counts)

    def state(bins: list[Bins]) -> pd.DataFrame:
        return pd.DataFrame({"n": [sum(b.values()) for b in bins], "place": range(len(bins)), "bins": [pickle.dumps(b) for b in bins]})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        island = int(pdf["island"].iloc[0])
        rng = random.Random(seed * 1_000_003 + island)
        return state(evolve(first_chromosomes(given.value, capacity, size, rng), given.value, capacity, generations, rng)).assign(island=island)

    def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
        island, k = int(pdf["island"].iloc[0]), int(pdf["epoch"].iloc[0])
        rng = random.Random((seed + k) * 1_000_003 + island)
        there = sorted(map(pickle.loads, pdf["bins"]), key=lambda b: fitness(b, capacity))[:size]
        return state(evolve(there, given.value, capacity, generations, rng)).assign(island=island)

    schema = "n long, place int, bins binary, island long"
    now = staged(spark.range(0, islands, 1, islands).withColumnRenamed("id", "island").groupBy("island").applyInPandas(settle, schema))
    for k in range(1, epochs + 1):
        if now.agg(F.min("n")).first()[0] <= bound:
            break
        moved = now.where(F.col("place") < elites).withColumn("island", (F.col("island") + 1) % islands)
        now = staged(now.unionByName(moved).withColumn("epoch", F.lit(k)).groupBy("island").applyInPandas(epoch, schema))
    return pickle.loads(now.orderBy("n", "island", "place").first()["bins"])


# --- places ---------------------------------------------------------------------------------------


class Places:
    """Place of the r-th piece of a length, for all r, from a chromosome."""

    def __init__(self, bins: Bins, capacity: int) -> None:
        rows, used, sequence = defaultdict(list), Counter(), 0
        for pattern, n in sorted(bins.items(), reverse=True):
            offset = 0
            for length, c in pattern:
                rows[length].append((used[length], c, sequence, offset))
                used[length] += n * c
                offset += length * c
            sequence += n
        self.by_length = {a: np.array(x, np.int64) for a, x in rows.items()}

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.by_length[length]
        low, per_bin, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1].T
        return sequence + (rank - low) // per_bin, offset + (rank - low) % per_bin * length


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, **search) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as the search finds.

    ``docs`` needs doc_id and text; other columns are ignored. A document is its ids and an end id;
    longer ones are cut into pieces of ``capacity``. A null or empty text is its end id alone, rows
    with equal or null doc_id are packed one by one, an empty table gives no rows. Returns doc_id,
    piece, start, length, ids_crc32, sequence_id and offset.
    """
    spark = docs.sparkSession
    pieces = staged(tokenize(docs, capacity, tokenizer))
    tallies = staged(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {int(r["length"]): int(r["n"]) for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places(pack_counts(spark, counts, capacity, **search), capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = tallies.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = (pdf["first"] + pdf["nth"]).to_numpy()
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for length, at in pdf.groupby("length", sort=False).indices.items():
                sequence[at], offset[at] = places.value.of(int(length), rank[at])
            yield pdf.drop(columns=["first", "nth"]).assign(doc_id=pdf["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    ranked = pieces.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "first", "nth")
    return ranked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
