"""Benchmark passages inside documents: a prefix-filtered set join of word shingles, verified on whole windows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import texts_of, written
from .hashing import grouped, run_hashes, word_hashes

WINDOW = 10       # words of an item's window; a shorter item is one window
SHINGLE = 4       # words of a shingle; a shorter window is one shingle
SLOTS = 1 << 23   # one byte each: the filter that tasks test shingles against, of this size whatever the benchmark
SALTS = 16        # a frequent shingle or window is spread over so many keys
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, words, length, shingles): every window of every item with the hashes of its shingles in order."""
    def run(batches):
        for batch in batches:
            out = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words_of(text)
                if not own:
                    continue
                length = min(window, len(own))
                k = min(SHINGLE, length)
                hashes = run_hashes(word_hashes(own), k).view(np.int64)
                for p in range(len(own) - length + 1):
                    for column, value in zip(out, (item, b" ".join(own[p:p + length]).decode(), length, hashes[p:p + length - k + 1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())))],
                                             names=["item", "words", "length", "shingles"])
    named = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return texts_of(named, "item").mapInArrow(run, "item string, words string, length int, shingles array<long>")


def filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A byte per slot, set where one of the hashes falls; at most SLOTS distinct slots reach the driver."""
    shift = 64 - SLOTS.bit_length() + 1
    slots = hashes.select(F.shiftrightunsigned(column, shift).cast("int").alias("slot")).distinct().toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[slots.column("slot").to_numpy()] = 1
    return out


def _hits(texts: list, sizes: list[int], wanted: np.ndarray):
    """(first text, words, text of each word, k, hashes, places) of the shingles that pass the filter, group by group."""
    for first, _, words, own in grouped(texts):
        hashed = word_hashes(words)
        for k in sizes:
            found = run_hashes(hashed, k)
            if not found.size:
                continue
            at = np.nonzero(wanted[_slot(found)])[0]
            at = at[own[at] == own[at + k - 1]]
            yield first, words, own, k, found[at], at


def shingle_counts(docs: DataFrame, wanted, sizes: list[int]) -> DataFrame:
    """(h, n): how often the benchmark's shingles occur in all documents, summed in each batch first."""
    def run(batches):
        for batch in batches:
            texts = [words_of(t) for t in batch.column(0).to_pylist()]
            parts = [x[4] for x in _hits(texts, sizes, wanted.value)]
            h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])
    return texts_of(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, wanted, sizes: list[int], window: int) -> DataFrame:
    """One row without h per document with its number of words, and one per prefix shingle met: its place and the words around it."""
    def run(batches):
        names = ["doc_id", "tid", "n_words", "h", "place", "before", "around"]
        for batch in batches:
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            rows, hs, places, befores, arounds = [], [], [], [], []
            for first, words, own, k, h, at in _hits(texts, sizes, wanted.value):
                begin = np.searchsorted(own, own[at])
                for text, b, p, x in zip(own[at].tolist(), begin.tolist(), at.tolist(), h.view(np.int64).tolist()):
                    low = max(b, p - window + k)
                    rows.append(text)
                    hs.append(x)
                    places.append(p - b)
                    befores.append(p - low)
                    arounds.append(b" ".join(words[low:min(b + len(texts[text]), p + window)]).decode())
            none = batch.num_rows
            take = pa.array(list(range(none)) + rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), batch.column(1).take(take),
                pa.array([len(t) for t in texts] + [None] * len(rows), pa.int64()), pa.array([None] * none + hs, pa.int64()),
                pa.array([None] * none + places, pa.int32()), pa.array([None] * none + befores, pa.int32()), pa.array([None] * none + arounds, pa.string())], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(rows, "doc_id", "tid").mapInArrow(run, f"doc_id {kind}, tid long, n_words long, h long, place int, before int, around string")


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def found_windows(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(headers, found): each document's number of words, and each place where a benchmark window stands in a document.

    A window is a set of shingles; containment in full leaves a prefix of one shingle that a document must have, and the rarest in the
    corpus is taken. A window one of whose shingles occurs nowhere is dropped at once. A document that has the prefix at
    place q can hold the window only from q - p, p being the shingle's place in the window, and only if the window's length fits between the
    document's ends; there its words are compared.
    """
    spark = docs.sparkSession
    sizes = sorted(r[0] for r in windows.select(F.least("length", F.lit(SHINGLE)).alias("k")).distinct().collect())
    shingles = written(windows.select("words", "length", F.posexplode("shingles").alias("p", "h")), "shingles")
    wanted = spark.sparkContext.broadcast(filter_of(shingles, "h"))
    counts = written(shingle_counts(docs, wanted, sizes), "counts")
    ranked = shingles.join(counts, "h", "left").groupBy("words", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "p")).alias("least"))
    prefix = written(ranked.where("least.n > 0").select("words", "length", "least.h", "least.p"), "prefix")
    rare = spark.sparkContext.broadcast(filter_of(prefix, "h"))
    met = written(occurrences(docs, rare, sizes, window), "occurrences")
    headers = met.where("h IS NULL").select("doc_id", "tid", "n_words")
    places = met.where("h IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc_id", "tid", "place"), F.lit(SALTS)).cast("int"))
    shapes = _salted(prefix.select("h", "p", "length").distinct())
    own = F.split("around", " ")
    placed = (places.join(shapes, ["h", "salt"]).where((F.col("before") >= F.col("p")) & (F.size(own) >= F.col("before") - F.col("p") + F.col("length")))
              .select("doc_id", "tid", "salt", "h", F.array_join(F.slice(own, F.col("before") - F.col("p") + 1, F.col("length")), " ").alias("words"),
                      (F.col("place") - F.col("p")).alias("b"), (F.col("place") - F.col("p") + F.col("length")).alias("e")))
    found = placed.join(_salted(prefix.select("words", "h")), ["words", "h", "salt"]).select("doc_id", "tid", "words", "b", "e").distinct()
    return headers, written(found, "found")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every document the word spans that benchmark items cover, and the items.

    Returns doc_id, n_words, spans (merged ranges [b, e) of words), n_hit (words in them), items (item_ids as strings, sorted) and
    contaminated, one row per row of ``docs``. Windows are ``window`` consecutive words of an item, or the whole item if it is shorter; an
    item without a word has none. Null and empty texts have no words. Rows with a null doc_id are judged like any other; repeated rows come
    back as often. An item with a null item_id marks words but is not named; repeated items count once. With an empty benchmark nothing is
    contaminated, an empty table gives an empty result. Long texts are hashed in slices; other columns are not read, so their
    names do not matter.
    """
    listed = written(item_windows(items, window), "item_windows")
    windows = written(listed.groupBy("words", "length").agg(F.first("shingles").alias("shingles")), "windows")
    headers, found = found_windows(docs, windows, window)
    key = ["doc_id", "tid"]
    row = W.partitionBy(*key).orderBy("b", "e")
    before = F.max("e").over(row.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("b") <= F.col("reach"), 0).otherwise(1)).over(row.rowsBetween(W.unboundedPreceding, 0))
    merged = (found.select(*key, "b", "e").distinct().withColumn("reach", before).withColumn("island", island)
              .groupBy(*key, "island").agg(F.min("b").alias("b"), F.max("e").alias("e")))
    spans = merged.groupBy(*key).agg(F.sum(F.col("e") - F.col("b")).cast("long").alias("n_hit"), F.sort_array(F.collect_list(F.struct("b", "e"))).alias("spans"))
    salt = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
    named = (found.select(*key, "words").distinct().withColumn("salt", salt)
             .join(_salted(listed.where("item IS NOT NULL").select("words", "item").distinct()), ["words", "salt"]))
    held = named.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = headers
    for part in (spans, held):
        own = part.withColumnsRenamed({"doc_id": "_doc", "tid": "_tid"})
        out = out.join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("tid").eqNullSafe(F.col("_tid")), "left").drop("_doc", "_tid")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<b:int,e:int>>")).alias("spans"),
                      F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


CONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}'), []) AS w FROM {documents}),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM {benchmark}),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dt AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
dw AS (SELECT r, p, l, s FROM (SELECT r, p, l, count(*) OVER f AS n, string_agg(t, ' ') OVER f AS s FROM dt, (SELECT DISTINCT l FROM iw)
       WINDOW f AS (PARTITION BY r, l ORDER BY p ROWS BETWEEN CURRENT ROW AND (l - 1) FOLLOWING)) WHERE n = l),
f AS (SELECT DISTINCT r, p, l, s FROM dw WHERE (s, l) IN (SELECT s, l FROM iw)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS x FROM f) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT f.r, iw.item FROM f JOIN iw USING (s, l) WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
""".replace("{word}", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
