"""Exact removal of repeated word windows by super-k-mers: runs of windows that share a minimiser travel as one packed string."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_written, slices, written

WINDOW = 50
SEED_WORDS = 8                     # words of a minimiser
RUN = 512                          # windows of one packed string at most; longer runs continue in the next string
HOT = 1 << 15                      # a minimiser of more windows in different runs is counted by window digests, spread by hash
TEXT_BYTES = 1 << 20               # bytes of texts held at once in a task
SORT_BYTES = 1 << 22               # bytes of packed strings whose windows are sorted at once; a group of HOT windows at most stays whole
_BASE = 0x9E3779B97F4A7C15         # odd, so that it has an inverse modulo 2**64
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int):
    global _POWERS, _INVERSES
    if _POWERS.size < n:
        size = 1 << n.bit_length()
        _POWERS, _INVERSES = (np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64) * np.uint64(pow(b, -1, 1 << 64))
                              for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS[:n], _INVERSES[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def offsets(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word in the words joined by one space."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def minimisers(joined: bytes, starts: np.ndarray, ends: np.ndarray, window: int, m: int) -> np.ndarray:
    """For every window the smallest hash among its runs of m words. Depends on the window's words alone, not on its place."""
    data = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = _powers(data.size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up, dtype=np.uint64)])
    words = _mix((total[ends] - total[starts]) * down[starts])
    n = words.size - m + 1
    grams = np.zeros(n, np.uint64)
    for j in range(m):
        grams = grams * np.uint64(_BASE) + words[j:j + n]
    best, have, width = _mix(grams), 1, window - m + 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best.view(np.int64)


def runs(values: np.ndarray):
    """(first window, past the last) of each maximal run of equal values, cut at RUN windows."""
    cuts = np.concatenate([[0], np.nonzero(values[1:] != values[:-1])[0] + 1, [values.size]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for s in range(a, b, RUN):
            yield s, min(s + RUN, b)


def _in_groups(texts: list, window: int, m: int, size: int = 1 << 18):
    """(number, joined words, starts, ends, minimisers) of each text of a window or more. Short texts are hashed together:
    windows across two texts are computed and left out."""
    def done(group):
        joined = b" ".join(x[1] for x in group)
        starts, ends = offsets(joined.split(b" "))
        values, word, byte = minimisers(joined, starts, ends, window, m), 0, 0
        for i, text, n in group:
            yield i, text, starts[word:word + n] - byte, ends[word:word + n] - byte, values[word:word + n - window + 1]
            word, byte = word + n, byte + len(text) + 1

    group, held = [], 0
    for i, text in enumerate(texts):
        tokens = text.split() if text else ()
        if len(tokens) >= window:
            group.append((i, b" ".join(tokens), len(tokens)))
            held += len(group[-1][1])
            if held > size:
                yield from done(group)
                group, held = [], 0
    if group:
        yield from done(group)


def _references(docs: DataFrame, window: int, m: int) -> DataFrame:
    """(minimiser, doc_id, tid, lo, hi): each minimiser of each document once; lo and hi digest its word sequence."""
    names = ["minimiser", "doc_id", "tid", "lo", "hi"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXT_BYTES, 2):
                rows, found, digests = [], [], []
                for i, joined, _, _, values in _in_groups(part.column(2).to_pylist(), window, m):
                    value = np.unique(values)
                    rows.append(np.full(value.size, i))
                    found.append(value)
                    digests.append(np.repeat(np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64)[None, :], value.size, axis=0))
                if rows:
                    at, digest = pa.array(np.concatenate(rows)), np.concatenate(digests)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(at), part.column(1).take(at),
                                                      pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], names=names)
    return docs.mapInArrow(run, "minimiser long, doc_id long, tid long, lo long, hi long")


_PACKED = "minimiser long, doc_id long, tid long, start int, windows int, lo long, hi long, packed binary"


def _packed(docs: DataFrame, window: int, m: int) -> DataFrame:
    """The runs of shared minimisers as packed strings; lo and hi digest the string."""
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[n.split()[1]] for n in _PACKED.split(", ")]
    names = [n.split()[0] for n in _PACKED.split(", ")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXT_BYTES, 2):
                out = [[] for _ in names]
                docs, tids, texts, wanted = (c.to_pylist() for c in part.columns)
                for i, joined, starts, ends, values in _in_groups(texts, window, m):
                    keep = set(wanted[i])
                    for a, b in runs(values):
                        if (key := int(values[a])) in keep:
                            packed = joined[starts[a]:ends[b + window - 2]]
                            lo, hi = np.frombuffer(xxhash.xxh3_128_digest(packed), np.int64).tolist()
                            for column, value in zip(out, (key, docs[i], tids[i], a, b - a, lo, hi, packed)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
    return docs.mapInArrow(run, _PACKED)


def _windows(strings: DataFrame, window: int) -> DataFrame:
    """(lo, hi, doc_id, tid, start): a digest of every window of the packed strings."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXT_BYTES // window, 3):
                rows, places, digests = [], [], []
                for i, (start, packed) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    starts, ends = offsets(packed.split(b" "))
                    n = starts.size - window + 1
                    rows.append(np.full(n, i))
                    places.append(np.arange(start, start + n))
                    digests += [xxhash.xxh3_128_digest(packed[a:b]) for a, b in zip(starts[:n].tolist(), ends[window - 1:].tolist())]
                at, digest = pa.array(np.concatenate(rows)), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), part.column(0).take(at), part.column(1).take(at),
                                                  pa.array(np.concatenate(places))], names=["lo", "hi", "doc_id", "tid", "start"])
    return strings.select("doc_id", "tid", "start", "packed").mapInArrow(run, "lo long, hi long, doc_id long, tid long, start long")


def window_ranks(joined: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte past each word and its space, a number for each window of words; equal numbers mean equal words).

    ``joined`` has a space after each word. Words are numbered, then runs of twice as many words from the numbers of two shorter
    runs, by sorting: exact, and in memory a few numbers a word.
    """
    ends = np.nonzero(np.frombuffer(joined, np.uint8) == 32)[0] + 1
    bounds = np.append(0, ends).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), ends.size, [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
    ranks, width = words.dictionary_encode().indices.to_numpy().astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        ranks = np.unique(ranks[:-step] * (ranks.size + 1) + ranks[step:], return_inverse=True)[1]
        width += step
    return ends, ranks


def _repeats(table: pa.Table, window: int):
    """Spans of the windows that also start in a smaller document, neighbours merged. Equal windows share a minimiser, so the table
    may hold any number of whole groups."""
    packed = table.column("packed").to_pylist()
    ends, ranks = window_ranks(b" ".join(packed) + b" ", window)
    past = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) + 1), "right")
    del packed
    n = np.diff(past, prepend=0)
    windows = n - window + 1
    row = np.repeat(np.arange(n.size, dtype=np.int32), windows)
    place = np.arange(row.size) - np.repeat(np.cumsum(windows) - windows, windows)
    ranks = ranks[place + np.repeat(past - n, windows)]
    docs = table.column("doc_id").to_numpy()[row]
    order = np.argsort(ranks, kind="stable")
    first = np.nonzero(np.diff(ranks[order], prepend=-1))[0]
    least = np.minimum.reduceat(docs[order], first)
    repeated = np.empty(row.size, bool)
    repeated[order] = docs[order] > np.repeat(least, np.diff(first, append=row.size))
    hit = np.nonzero(repeated)[0]
    if not hit.size:
        return None
    begins = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)])
    stops = np.concatenate([begins[1:], [True]])
    own = row[hit[begins]]
    start = table.column("start").to_numpy()[own].astype(np.int64)
    return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(pa.array(own)), table.column("tid").combine_chunks().take(pa.array(own)),
                                       pa.array(start + place[hit[begins]]), pa.array(start + place[hit[stops]] + window)], names=["doc_id", "tid", "b", "e"])


def _whole_groups(table: pa.Table):
    """Parts of a table of whole minimiser groups, with about SORT_BYTES of packed strings each."""
    if not table.num_rows:
        return
    keys = table.column("minimiser").to_numpy()
    cuts = np.append(np.nonzero(np.diff(keys))[0] + 1, keys.size)
    size = np.cumsum(pc.binary_length(table.column("packed")).to_numpy().astype(np.int64))[cuts - 1]
    at = done = 0
    while at < keys.size:
        k = max(int(np.searchsorted(cuts, at, "right")), int(np.searchsorted(size, done + SORT_BYTES, "right")) - 1)
        yield table.slice(at, int(cuts[k]) - at)
        at, done = int(cuts[k]), int(size[k])


def _spans_of_strings(strings: DataFrame, window: int) -> DataFrame:
    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            keys = table.column("minimiser").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            held = table.slice(cut)
            for part in _whole_groups(table.slice(0, cut)):
                if (out := _repeats(part, window)) is not None:
                    yield out
        for part in () if held is None else _whole_groups(held):
            if (out := _repeats(part, window)) is not None:
                yield out
    return (strings.select("minimiser", "doc_id", "tid", "start", "packed").repartition("minimiser").sortWithinPartitions("minimiser")
            .mapInArrow(run, "doc_id long, tid long, b long, e long"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tid, spans) of documents with words to remove; tid is the text's xxhash64, spans are word ranges [b, e).

    1. Every document names its minimisers. Later copies of a whole word sequence are covered from end to end and drop out.
    2. A window in two documents has the same minimiser in both, so only minimisers of two or more documents matter.
    3. Runs with such a minimiser are packed strings. Of equal runs only the smallest document's is looked into: the others are covered from end to end.
    4. What is left goes to the minimiser's bucket; its windows are sorted and the smallest doc_id of equal windows is known. A
       minimiser that still has more than HOT windows sends digests of 128 bits instead, grouped by hash.
    """
    m = min(SEED_WORDS, window)
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text"))
    refs = written(_references(keyed, window, m), "references")
    first = written(refs.groupBy("lo", "hi").agg(F.min("doc_id").alias("first")), "first")
    owner = first.select(F.col("first").alias("doc_id"), "lo", "hi")
    own = written(refs.join(owner, ["doc_id", "lo", "hi"]).select("minimiser", "doc_id", "tid"), "own")
    whole = written(refs.select("doc_id", "tid", "lo", "hi").distinct().join(first, ["lo", "hi"]).where("doc_id > first")
                    .select("doc_id", "tid", F.lit(0).cast("long").alias("b"), F.lit((1 << 62)).alias("e")), "whole")
    drop_written(refs, first)
    shared = own.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minimiser")
    wanted = written(own.join(shared, "minimiser").groupBy("doc_id", "tid").agg(F.collect_set("minimiser").alias("shared")), "wanted")
    drop_written(own)
    strings = written(_packed(keyed.join(wanted, ["doc_id", "tid"]).select("doc_id", "tid", "text", "shared"), window, m), "strings")
    drop_written(wanted)

    each = strings.groupBy("minimiser", "lo", "hi", "doc_id").agg(F.sum("windows").alias("windows"))
    least = written(each.groupBy("minimiser", "lo", "hi").agg(F.min("doc_id").alias("least"), F.min_by("windows", "doc_id").alias("windows")), "least")
    kinds = (least.groupBy("minimiser").agg(F.min("least").alias("a"), F.max("least").alias("b"), F.sum("windows").alias("n"))
             .where("a < b").select("minimiser", (F.col("n") > HOT).alias("hot")))
    heads = least.join(kinds, "minimiser").select("minimiser", "lo", "hi", F.col("least").alias("doc_id"), "hot")
    left = written(strings.join(heads, ["minimiser", "lo", "hi", "doc_id"]).select("minimiser", "doc_id", "tid", "start", "packed", "hot"), "left")
    past = (F.col("start") + F.col("windows") + (window - 1)).cast("long")
    equal = (strings.drop("packed").join(least.drop("windows"), ["minimiser", "lo", "hi"]).where("doc_id > least")
             .select("doc_id", "tid", F.col("start").cast("long").alias("b"), past.alias("e")))
    cold = _spans_of_strings(left.where("NOT hot"), window)
    hot = written(_windows(left.where("hot"), window), "windows")
    smallest = hot.groupBy("lo", "hi").agg(F.min("doc_id").alias("least"))
    warm = hot.join(smallest, ["lo", "hi"]).where("doc_id > least").select("doc_id", "tid", F.col("start").alias("b"), (F.col("start") + window).alias("e"))
    return merged(cold.unionByName(warm).unionByName(equal).unionByName(whole))


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, tid, spans): the ranges of each document, overlapping and adjacent ones made one before they meet in a cell."""
    row = W.partitionBy("doc_id", "tid").orderBy("b", "e")
    reach = F.max("e").over(row.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("b") <= F.col("reach"), 0).otherwise(1)).over(row.rowsBetween(W.unboundedPreceding, 0))
    islands = spans.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "tid", "island").agg(F.min("b").alias("b"), F.max("e").alias("e"))
    return islands.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("b", "e")).alias("spans"))


def _kept(tokens: list[bytes], cuts: list) -> list[bytes]:
    out = np.zeros(len(tokens), bool)
    for c in cuts or ():
        out[c["b"]:c["e"]] = True
    return [tokens[i] for i in np.nonzero(~out)[0].tolist()] if cuts else tokens


def _with_spans(docs: DataFrame, window: int, carry: tuple[str, ...], original: bool) -> DataFrame:
    """doc_id, n_words, n_removed, the kept words (with ``original`` the text itself where nothing is removed) and ``carry``."""
    spans = repeated_spans(docs, window)
    own = {f"_carry{i}": c for i, c in enumerate(carry)}
    rows = docs.select("doc_id", F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text"), *[F.col(c).alias(a) for a, c in own.items()])
    joined = rows.join(spans, ["doc_id", "tid"], "left").select("doc_id", "text", "spans", *own)

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXT_BYTES, 1):
                n_words, n_removed, kept = [], [], []
                for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tokens = (text or b"").split()
                    n_words.append(len(tokens))
                    tokens = _kept(tokens, cuts)
                    n_removed.append(n_words[-1] - len(tokens))
                    kept.append(text if original and not n_removed[-1] else b" ".join(tokens))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                                  pa.array(kept, pa.binary()).cast(pa.string()), *part.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", *own])

    schema = joined.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), *own).schema
    for field in schema.fields:
        field.nullable = True
    return joined.mapInArrow(run, schema).select("doc_id", "n_words", "n_removed", "kept", *[F.col(a).alias(c) for a, c in own.items()])


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept (the kept words joined by one space) and the ``carry`` columns. Windows are
    judged on the input. Null and empty texts have no words and keep the empty string; texts shorter than a window
    are kept. Repeats inside one document, and repeated rows of one doc_id, remove nothing. A row without doc_id is neither
    judged nor a source. An empty table gives an empty result. A very long text is read as a whole by one task, its windows are dealt by minimiser
    like any others. Columns not named in ``carry`` are not read, and their names do not matter.
    """
    return _with_spans(docs, window, carry, original=False)


def cut_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``remove_repeats``, but ``kept`` is the text itself, white space included, where nothing is removed (null stays null)."""
    return _with_spans(docs, window, carry, original=True)
