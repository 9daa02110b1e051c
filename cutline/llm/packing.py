"""Token sequences by cutting stock: a linear program over length-histogram patterns, priced by a knapsack."""

import json
import re
import zlib
from array import array
from base64 import b64decode
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import texts_of, written

GRAIN = 4             # tokens of one unit of the length histogram
GAP = 1e-3            # column generation ends when the bound proves the plan this close to the optimum
CACHE = 500_000       # pieces of text whose ids a worker remembers
CHUNK_ROWS = 8192

#: The split of a byte-level vocabulary before its merges (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to U+024F on whose classes all libraries agree, and the same split over them; other texts go to the tokenizer whole.
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa0-\u024f]*")
PIECE = re.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+""")
WORD_PIECE = re.compile(f" [{_LETTER}]+")


def added_tokens(path: str) -> dict[str, bytes]:
    """The tokens a vocabulary's JSON adds to its ranks, with their id: they are matched in the raw text before anything is split."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    odd = [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd:
        raise ValueError(f"added tokens with conditions are not supported: {odd}")
    return {t["content"]: array("I", [t["id"]]).tobytes() for t in added}


class Encoder:
    """Texts to the bytes of their ids (little-endian unsigned 32 bits), remembering the pieces met before.

    With the JSON of the vocabulary its added tokens get their own ids; without it their letters are text like any other.
    """

    def __init__(self, path: str, vocabulary: str | None = None):
        with open(path, "rb") as lines:
            ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._newline = ranks[b"\n"]
        self._known: dict[str, bytes] = {}
        self._added = added_tokens(vocabulary) if vocabulary else {}
        # the longest of several that begin at one place
        self._literal = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None

    def _ids(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; words with a space before them all at once, lines apart."""
        if len(self._known) > CACHE:
            self._known.clear()
        words = [p for p in pieces if WORD_PIECE.fullmatch(p)]
        ids = np.array(self._encode("\n".join(words)), "<u4")
        ends = np.append(np.nonzero(ids == self._newline)[0], ids.size)
        if len(ends) != len(words):
            words = []
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (ends * 4).tolist()):
            self._known[word] = data[at:end]
            at = end + 4
        for piece in pieces:
            if piece not in self._known:
                self._known[piece] = self._ids(piece)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self._literal is None or not any(map(self._literal.search, texts)):
            return self._plain(texts)
        cut = [self._literal.split(t) for t in texts]  # text and token in turn
        ids = iter(self._plain([part for parts in cut for part in parts[::2]]))
        return [b"".join(self._added[part] if k % 2 else next(ids) for k, part in enumerate(parts)) for parts in cut]

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [PIECE.findall(t) if PLAIN.fullmatch(t) else None for t in texts]
        new = list(set().union(*filter(None, split)).difference(self._known))
        if new:
            known = len(self._known)
            self._learn(new)
            if known > CACHE:  # the memory was cleared on the way
                return [self._ids(t) for t in texts]
        get = self._known.__getitem__
        return [self._ids(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split)]


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, vocabulary: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary; read once per process."""
    if (path, vocabulary) not in _encoders:
        _encoders[path, vocabulary] = Encoder(path, vocabulary)
    return _encoders[path, vocabulary]


def token_pieces(docs: DataFrame, ranks: str, length: int, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, doc_tokens, crcs): ids of each text and one id 0; crcs has the CRC-32 of every run of ``length`` ids."""
    def run(batches):
        encode = encoder(ranks, vocabulary)
        for batch in batches:
            counts, crcs = [], []
            for at in range(0, batch.num_rows, 64):
                for ids in encode([t.decode() if t else "" for t in batch.column(1).slice(at, 64).to_pylist()]):
                    ids += b"\0\0\0\0"
                    counts.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[i:i + 4 * length]) for i in range(0, len(ids), 4 * length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                                             names=["doc_id", "doc_tokens", "crcs"])
    schema = docs.select("doc_id", F.lit(None).cast("long").alias("doc_tokens"), F.lit(None).cast("array<long>").alias("crcs")).schema
    return texts_of(docs, "doc_id").mapInArrow(run, schema)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (unbounded knapsack)."""
    value, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        fits = np.searchsorted(sizes, room, "right")
        if fits:
            gains = value[room - sizes[:fits]] + worth[:fits]
            k = int(np.argmax(gains))
            if gains[k] > value[room] + 1e-12:
                value[room], chosen[room] = gains[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            pattern[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(value[capacity]), pattern


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often to cut them, of the relaxed cutting-stock program.

    Starts from one size per pattern. The duals of the current basis price all patterns at once by the knapsack; the best one
    enters, the ratio test says which leaves. current / best price bounds the optimum from below, which ends the search.
    """
    basis = np.diag((capacity // sizes).astype(float))  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse @ demand
    while True:
        price, pattern = best_pattern(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if price <= 1 + gap:
            return basis.T, amount
        step = inverse @ pattern
        limits = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(limits))
        amount = np.maximum(amount - limits[out] * step, 0)
        amount[out] = limits[out]
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((size, count), ...) with whole multiplicities that use every piece exactly once.

    Multiplicities of the relaxed plan are rounded down; the few pieces left over (at most one pattern's worth per size) are
    packed by first fit, largest first.
    """
    if not sizes.size:
        return []
    patterns, amount = plan_patterns(sizes, demand.astype(float), capacity)
    times = np.floor(amount + 1e-9).astype(np.int64)
    left = demand - np.rint(patterns.T @ times).astype(np.int64)
    for over in np.nonzero(left < 0)[0]:  # rounding noise: give the pattern back
        while left[over] < 0:
            p = int(np.nonzero((patterns[:, over] > 0) & (times > 0))[0][0])
            times[p] -= 1
            left += np.rint(patterns[p]).astype(np.int64)
    result = Counter()
    for p in np.nonzero(times)[0]:
        result[tuple((int(sizes[k]), int(patterns[p, k])) for k in np.nonzero(patterns[p])[0])] += int(times[p])
    rooms: list[list] = []
    for k in np.argsort(-sizes):
        for _ in range(int(left[k])):
            room = next((r for r in rooms if r[0] >= sizes[k]), None)
            if room is None:
                room = [capacity, Counter()]
                rooms.append(room)
            room[0] -= int(sizes[k])
            room[1][int(sizes[k])] += 1
    for _, held in rooms:
        result[tuple(sorted(held.items()))] += 1
    return sorted(result.items())


def _places(patterns: list, grains: int) -> tuple[np.ndarray, ...]:
    """For each size the ranks that go to each pattern: (size and first rank as one sorted key, first rank, pieces per sequence, first sequence)."""
    taken, rows, sequence = Counter(), [], 0
    for pattern, times in patterns:
        for size, count in pattern:
            rows.append((size, taken[size], count, sequence))
            taken[size] += count * times
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return (table[:, 0] << 40) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, ranks: str, length: int = 1024, grain: int = GRAIN, vocabulary: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens with little padding.

    ranks is the rank file; vocabulary, the JSON beside it, names the added tokens that are matched inside a text.
    A document's ids end with one id 0. Runs of ``length`` ids fill sequences of their own; the rest of each document is one
    piece. The histogram of these pieces, in units of ``grain`` tokens, is all the driver sees: at most length / grain counts.
    Its patterns go to the pieces by their rank within their size, which comes from counts per chunk and a
    window inside one chunk, so no size is ever ranked in one task.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (gapless from 0). Null and empty
    texts are the single id 0. Repeated rows are packed one by one; a null doc_id is an id like others. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = token_pieces(docs, ranks, length, vocabulary)
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "tokens")
    n = rows.count()
    unit = F.ceil(F.col("tail") / grain).cast("int")
    rows = (rows.withColumn("tail", F.col("doc_tokens") % length).withColumn("full", F.floor(F.col("doc_tokens") / length)).withColumn("unit", unit)
            .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(max(1, min(1 << 16, n // CHUNK_ROWS))))))
    counts = written(rows.groupBy("chunk", "unit").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "counts")
    histogram = {r["unit"]: r["n"] for r in counts.where("unit > 0").groupBy("unit").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(histogram), np.int64)
    patterns = whole_patterns(sizes, np.array([histogram[int(s)] for s in sizes], np.int64), -(-length // grain) if length % grain == 0 else length // grain)
    keys, first, per, sequence = _places(patterns, length // grain)
    packed = sum(times for _, times in patterns)

    ahead = lambda *by: W.partitionBy(*by).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    full = counts.groupBy("chunk").agg(F.sum("full").alias("full"))
    full = full.select("chunk", (F.coalesce(F.sum("full").over(ahead()), F.lit(0)) + packed).alias("full_from"))
    starts = counts.select("chunk", "unit", F.coalesce(F.sum("n").over(ahead("unit")), F.lit(0)).alias("rank_from")).join(full, "chunk")
    inside = W.partitionBy("chunk", "unit").orderBy("rid")
    within = W.partitionBy("chunk").orderBy("unit", "rid").rowsBetween(W.unboundedPreceding, -1)
    ranked = (rows.withColumn("rank", F.row_number().over(inside) - 1).withColumn("fulls", F.coalesce(F.sum("full").over(within), F.lit(0)))
              .join(starts, ["chunk", "unit"]).withColumn("rank", F.col("rank") + F.col("rank_from")).withColumn("full_from", F.col("full_from") + F.col("fulls")))

    names = ["sequence_id", "rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            at = np.searchsorted(keys, (size << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(sequence[at] + (rank - first[at]) // per[at]), *batch.columns[2:]], names=names)

    tails = (ranked.where("tail > 0").select("unit", "rank", "rid", "doc_id", (F.col("full") * length).alias("start"), F.col("tail").alias("length"),
                                             F.col("crcs")[F.col("full").cast("int")].alias("ids_crc32"), "doc_tokens"))
    kept = tails.drop("unit", "rank")
    put = tails.mapInArrow(place, kept.select(F.lit(None).cast("long").alias("sequence_id"), *kept.columns).schema)
    beside = W.partitionBy("sequence_id").orderBy(F.desc("length"), "rid").rowsBetween(W.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ends = put.withColumn("offset", F.coalesce(F.sum("length").over(beside), F.lit(0))).select(columns)
    cut = (ranked.where("full > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)))
           .select("doc_id", (F.col("k").cast("long") * length).alias("start"), F.lit(length).cast("long").alias("length"), F.col("crcs")[F.col("k")].alias("ids_crc32"),
                   "doc_tokens", (F.col("full_from") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return ends.unionByName(cut)
