"""Spelling variants: words one edit apart, found with search schemes over bidirectional FM-indexes of the delimited vocabulary."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

RUN = "a-zÀ-ÿ"    # letters of a lower-cased run
BLOCK = 1 << 15             # words of one index; a bucket of more is cut into parts that each of its words visits
HELD = 300_000              # words a task counts before it hands them on
QUERIES = 1024              # words searched at once
STEP = 64                   # positions between the stored ranks of an index
SIGMA = 92                  # end of text, delimiter, a-z, U+00C0-U+00FF
END, MARK = 0, 1


def word_counts(docs: DataFrame, min_length: int, drop_every: int | None) -> DataFrame:
    """(word, n): runs of letters, only A-Z lower-cased. With ``drop_every`` a run whose CRC-32 (of ``doc_id:run``) it divides loses one letter."""
    runs = re.compile(f"[{RUN}]{{{min_length},}}")

    def words(doc, text):
        prefix = zlib.crc32(b"%s:" % (doc or "").encode())
        for run, n in Counter(runs.findall(text.lower().decode())).items():
            if drop_every and not (h := zlib.crc32(run.encode(), prefix)) % drop_every:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < min_length:
                    continue
            yield run, n

    def run(batches):
        held = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    for word, n in words(doc, text):
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts_of(named, "doc_id").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols(text: str) -> np.ndarray:
    """Letters as 2 to 91 in code-point order."""
    codes = np.frombuffer(text.encode("latin-1"), np.uint8).astype(np.int64)
    return np.where(codes >= 0xC0, codes - 0xC0 + 28, codes - 0x61 + 2)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of a text in order, by doubling; the first round ranks nine symbols."""
    n, width = text.size, 9
    padded = np.concatenate([text, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key * SIGMA + padded[j:j + n]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], (np.diff(key[order]) != 0).cumsum()])
        if new[-1] == n - 1:
            return order
        rank = np.zeros(n + width, np.int64)
        rank[order] = new + 1
        key = rank[:n] * (n + 1) + rank[width:]
        width *= 2


class Ranks:
    """The Burrows-Wheeler transform of a text and the ranks of all symbols in it."""

    def __init__(self, text: np.ndarray):
        bwt = text[suffix_order(text) - 1].astype(np.uint8)
        blocks = text.size // STEP + 1
        counts = np.bincount(np.arange(text.size) // STEP * SIGMA + bwt, minlength=blocks * SIGMA).reshape(blocks, SIGMA)
        self._before = (np.cumsum(counts, axis=0) - counts).astype(np.int32)
        self._bwt = np.concatenate([bwt, np.zeros(blocks * STEP - text.size, np.uint8)]).reshape(blocks, STEP)
        total = counts.sum(axis=0)
        self.first = np.cumsum(total) - total

    def upto(self, rows: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row."""
        block, rest = np.divmod(rows, STEP)
        state, place = np.nonzero(np.arange(STEP) < rest[:, None])
        inside = np.bincount(state * SIGMA + self._bwt[block[state], place], minlength=rows.size * SIGMA)
        return self._before[block] + inside.reshape(rows.size, SIGMA)

    def extend(self, own: np.ndarray, other: np.ndarray, size: np.ndarray):
        """The intervals, here and in the index of the reversed text, of every match with each symbol put before it."""
        low = self.upto(own)
        count = self.upto(own + size) - low
        return self.first + low, other[:, None] + np.cumsum(count, axis=1) - count, count


class VocabularyIndex:
    """Forward and reversed FM-index of a sorted vocabulary, each word between delimiters."""

    def __init__(self, words: list[str]):
        self.words = words
        own = [symbols(w) for w in words]
        text = np.concatenate([x for w in own for x in ([MARK], w)] + [[MARK]]).astype(np.int64)
        self.forward, self.backward = Ranks(np.append(text, END)), Ranks(np.append(text[::-1], END))
        self.rows = text.size + 1

    def near(self, queries: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs exactly one edit apart, the edit behind the query's exact left half or before its exact right half.

        The exact half is matched from the middle out to its delimiter, then the search turns round and extends over the other half. Intervals
        in both indexes are kept in step, so it can turn. ``own`` is the interval in the index that extends in the present direction.
        """
        cut = [(q[:len(q) // 2], q[len(q) // 2:]) for q in queries]
        # symbols in the order in which they are matched
        exact = [np.append(symbols(a if left else b)[::-1 if left else 1], MARK) for a, b in cut]
        other_half = [symbols(b if left else a)[::1 if left else -1] for a, b in cut]
        first, second = (self.forward, self.backward) if left else (self.backward, self.forward)
        own, other, size = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.full(len(queries), self.rows)
        for step in range(max(map(len, exact))):
            at = np.array([i for i, s in enumerate(exact) if step < len(s) and size[i]], np.int64)
            if at.size:
                symbol, row = np.array([exact[i][step] for i in at]), np.arange(at.size)
                own[at], other[at], size[at] = (x[row, symbol] for x in first.extend(own[at], other[at], size[at]))
        lengths = np.array(list(map(len, other_half)))
        wanted = np.full((len(queries), lengths.max() + 1), MARK)  # past its end a query wants the delimiter
        for i, s in enumerate(other_half):
            wanted[i, :len(s)] = s
        query = np.nonzero(size)[0]
        own, other, size, done, edits = other[query], own[query], size[query], np.zeros(query.size, np.int64), np.zeros(query.size, bool)
        found = []
        while query.size:
            a, b, n = second.extend(own, other, size)
            want, last = wanted[query, done], done == lengths[query]
            ended = last & edits
            hit = np.nonzero(ended)[0]
            hit = hit[n[hit, MARK] > 0]
            # rows of the forward index that begin with the delimiter follow the order of the words; the end's own rows come first
            found.append((query[hit], (b if left else a)[hit, MARK] - 2))
            matched = np.nonzero(~last & (n[np.arange(query.size), want] > 0))[0]
            letters = (n > 0) & ~edits[:, None]
            letters[:, :2] = False
            letters[np.arange(query.size), want] = False  # a repeated letter is inserted behind its run
            state, letter = np.nonzero(letters)
            inner = ~last[state]
            skip = np.nonzero(~edits & ~last)[0]
            grown = lambda x: np.concatenate([x[matched, want[matched]], x[state, letter], x[state[inner], letter[inner]]])
            source = np.concatenate([matched, state, state[inner], skip])
            own, other, size = (np.concatenate([grown(x), y[skip]]) for x, y in ((a, own), (b, other), (n, size)))
            done = np.concatenate([done[matched] + 1, done[state], done[state[inner]] + 1, done[skip] + 1])
            edits = np.concatenate([edits[matched], np.ones(state.size + int(inner.sum()) + skip.size, bool)])
            query = query[source]
        pairs = np.unique(np.concatenate([q * np.int64(len(self.words)) + w for q, w in found] or [np.zeros(0, np.int64)]))
        return pairs // len(self.words), pairs % len(self.words)


def _near_in_block(left: bool):
    """(word, near, near_n) of one block. What has the left half in front is left to the search from the left."""
    def run(table: pa.Table) -> pa.Table:
        held = table.filter(table.column("held"))
        words, counts = zip(*sorted(zip(held.column("word").to_pylist(), held.column("n").to_pylist()))) if held.num_rows else ((), ())
        out = [], [], []
        if words:
            index, asked = VocabularyIndex(list(words)), table.column("word").to_pylist()
            for at in range(0, len(asked), QUERIES):
                some = asked[at:at + QUERIES]
                for q, w in zip(*(x.tolist() for x in index.near(some, left))):
                    if left or not words[w].startswith(some[q][:len(some[q]) // 2]):
                        for column, value in zip(out, (some[q], words[w], counts[w])):
                            column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])
    return run


def near_words(vocabulary: DataFrame, min_length: int) -> DataFrame:
    """(word, near, near_n): all pairs of words one inserted, deleted or replaced code point apart, in both directions.

    One of the two halves of a word stands unchanged in its neighbour, at the same end. So words are dealt by their first letters for the search from the left
    and by their last letters for the one from the right, to blocks of about BLOCK words with an index each. A bucket of
    more words is dealt to several blocks by hash; its words are then searched in each of them.
    """
    size, blocks = min_length // 2, max(1, -(-vocabulary.count() // BLOCK))
    sides = []
    for left in (True, False):
        keyed = vocabulary.withColumn("key", F.substring("word", 1 if left else -size, size))
        held = keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        dealt = (keyed.join(held, "key").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("home", F.pmod(F.xxhash64("word"), "parts"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        rows = dealt.select("block", "part", "word", "n", (F.col("part") == F.col("home")).alias("held"))
        rows = rows.repartition(blocks, "block", "part")  # a block is small in bytes but not in work
        sides.append(rows.groupBy("block", "part").applyInArrow(_near_in_block(left), "word string, near string, near_n long"))
    return sides[0].unionByName(sides[1])


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, by doubling; counts grow fivefold with every step, so a few rounds do."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = written(now.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variant_groups(docs: DataFrame, min_length: int = 6, min_count: int = 5, factor: int = 5, drop_every: int | None = None) -> DataFrame:
    """Group the words of a corpus by the common spelling they are one edit away from.

    Words are runs of A-Z (lower-cased), a-z and U+00C0-U+00FF of at least ``min_length`` code points with at least ``min_count`` occurrences.
    Returns word, n (occurrences), n_near (words exactly one edit apart), form (the nearest by count, ties by code points, if it occurs at
    least ``factor`` times as often; else null), form_n and root (the last form on the way, the word itself without one).

    Null and empty texts have no words. A null doc_id counts as an empty one where ``drop_every`` needs it; repeated rows count as often as they come. An
    empty table gives an empty result. Counting holds HELD words at a time, whatever the length of a text. Other columns are not read, so their
    names do not matter.
    """
    if min_length < 2 or factor < 2:
        raise ValueError("min_length and factor must be at least 2")
    vocabulary = written(word_counts(docs, min_length, drop_every).where(F.col("n") >= min_count), "vocabulary")
    near = near_words(vocabulary, min_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    common = -F.col("best.n") >= factor * F.col("n")
    rows = written(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.form")).alias("form"),
                                                                F.when(common, -F.col("best.n")).alias("form_n")), "near")
    roots = last_forms(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
