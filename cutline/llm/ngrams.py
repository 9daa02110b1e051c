"""Language-model scores from an Elias-Fano n-gram trie in memory-mapped levels."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path, lower_ascii, make_dirs, new_path, texts_of, written
from .eliasfano import EliasFano, load, prefixed, save, sequence

END = b" "              # no word holds a space
DISCOUNT = 0.75
SHARD_WORDS = 1 << 20   # words of one vocabulary file, about
SHARD_TOKENS = 1 << 22  # training tokens behind one file of a higher level, about; also what a task counts before it hands on
KNOWN = 500_000         # words whose ids a worker remembers
STEP = 20 / 65534       # of the quantised negative log10
NONE = 65535


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) / STEP), 0, 65534).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.power(10.0, code * -STEP)


def _pack(a: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    kind = np.min_scalar_type(int(a.max()) if a.size else 0)
    a = a.astype(kind)
    return bytes([kind.itemsize]) + zlib.compress(a.view(np.uint8).reshape(-1, kind.itemsize).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64)


def summed_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None):
    """Distinct pairs (a, b) in order, and the sum of n (or the count) of each."""
    n = np.ones(a.size, np.int64) if n is None else n
    width = int(b.max()) + 1 if b.size else 1
    if a.size and (int(a.max()) + 1) * width < 1 << 63:
        key = a * width + b
        order = np.argsort(key, kind="stable")
    else:
        key, order = None, np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if a.size else np.zeros(0, bool)
    at = np.nonzero(first)[0]
    return a[at], b[at], np.add.reduceat(n, at) if at.size else n


def text_groups(batches, tokens: int):
    """Lists of (rows as arrays, token lists) with about so many tokens."""
    ids, lists, held = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = lower_ascii(text or b"").split()
            ids.append(row)
            lists.append(own)
            held += len(own) + 1
            if held >= tokens:
                yield ids, lists
                ids, lists, held = [], [], 0
    if ids:
        yield ids, lists


class Files:
    """The files of one level, opened on first use in each worker."""

    def __init__(self, root: str):
        self.root, self._open = root, {}

    def __getstate__(self):
        return self.root

    def __setstate__(self, root):
        self.root, self._open = root, {}

    def __call__(self, name: str) -> dict:
        if name not in self._open:
            arrays = load(f"{self.root}/{name}")
            for key in {k.split(".")[0] for k in arrays if "." in k}:
                arrays[key] = sequence(arrays, key)
            self._open[name] = arrays
        return self._open[name]


class Level:
    """Nodes of one order. Node ids run through the shards; ``starts`` has the first id of each."""

    def __init__(self, root: str, names: list[str], sizes: list[int]):
        self.files, self.names = Files(root), names
        self.starts = np.append(0, np.cumsum(np.array(sizes, np.int64)))
        self.index = {n: k for k, n in enumerate(names)}

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def by_shard(self, nodes: np.ndarray):
        """(shard, positions of its nodes in the input, their local numbers)."""
        shard = np.searchsorted(self.starts, nodes, "right") - 1
        order = np.argsort(shard, kind="stable")
        cuts = np.append(0, np.nonzero(np.diff(shard[order]))[0] + 1)
        for at in np.split(order, cuts[1:]) if order.size else ():
            k = int(shard[at[0]])
            yield k, at, nodes[at] - self.starts[k]

    def gather(self, what: str, nodes: np.ndarray, kind) -> np.ndarray:
        out = np.zeros(nodes.size, kind)
        for k, at, local in self.by_shard(nodes):
            name = self.names[k] + (".backoff" if what == "backoff" else "")
            out[at] = self.files(name)[what][local]
        return out


class Vocabulary(Level):
    """Order 1: words by their 64-bit hash, split by its first bits."""

    def __init__(self, root: str, bits: int, sizes: dict[int, int]):
        super().__init__(root, [str(s) for s in range(1 << bits)], [sizes.get(s, 0) for s in range(1 << bits)])
        self.bits, self._known = bits, {}

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def _find(self, words: list[bytes]) -> list[int]:
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        shard = (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(h.size, np.int64)
        rest = h & np.uint64((1 << (64 - self.bits)) - 1)
        out = np.full(h.size, -1, np.int64)
        for s in np.unique(shard).tolist():
            if self.starts[s + 1] > self.starts[s]:
                at = np.nonzero(shard == s)[0]
                found = self.files(self.names[s])["hash"].find(rest[at])
                out[at] = np.where(found >= 0, found + self.starts[s], -1)
        return out.tolist()

    def ids(self, lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Every text as END, its words, END; and where each text begins."""
        if len(self._known) > KNOWN:
            self._known.clear()
        new = list({END}.union(*lists).difference(self._known))
        self._known.update(zip(new, self._find(new)))
        get, end = self._known.__getitem__, self._known[END]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 2
        begin = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), end, np.int64)
        for b, own in zip(begin.tolist(), lists):
            out[b + 1:b + 1 + len(own)] = list(map(get, own))
        return out, begin


class Order(Level):
    """Order 2 and above: successors of every context. Contexts share files by ranges; one with more tokens than go into
    a file has files of its own, by ranges of the successor."""

    def __init__(self, root: str, names: list[str], sizes: list[int], rule: "ShardRule"):
        super().__init__(root, names, sizes)
        self.rule = rule

    def find(self, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of each (context, word) and its discounted probability; -1 and 0 where training never saw it."""
        node, p = np.full(context.size, -1, np.int64), np.zeros(context.size)
        for name, at in self.rule.split(context, word, count):
            if name not in self.index:
                continue
            held, k = self.files(name), self.index[name]
            own, inverse = np.unique(context[at], return_inverse=True)
            row = held["context"].find(own.astype(np.uint64))
            safe = np.maximum(row, 0)
            a, b = held["pointer"][safe].astype(np.int64), held["pointer"][safe + 1].astype(np.int64)
            base = np.where(a > 0, held["successor"][np.maximum(a - 1, 0)].astype(np.int64) + 1, 0)
            place = held["successor"].find((base[inverse] + word[at]).astype(np.uint64))
            hit = (row[inverse] >= 0) & (place >= a[inverse]) & (place < b[inverse])
            node[at[hit]] = place[hit] + self.starts[k]
            p[at[hit]] = probability(held["code"][place[hit]])
        return node, p


class ShardRule:
    def __init__(self, below: int, tokens: int, words: int, per_file: int = SHARD_TOKENS):
        self.width = -(-below // max(1, -(-tokens // per_file)))
        self.words, self.per_file = words, per_file

    def split(self, context: np.ndarray, word: np.ndarray, count: np.ndarray):
        """(file name, positions) of pairs; count is what training saw of the context."""
        parts = np.maximum(1, -(-count // self.per_file))
        hot = parts > 1
        part = np.where(hot, word // -(-self.words // parts), context // self.width)
        owner = np.where(hot, context, -1)
        order = np.lexsort((part, owner))
        if order.size:
            o, p = owner[order], part[order]
            cuts = np.nonzero((o[1:] != o[:-1]) | (p[1:] != p[:-1]))[0] + 1
            for at in np.split(order, cuts):
                yield f"{owner[at[0]]}_{part[at[0]]}".replace("-1_", "_"), at


class Trie:
    def __init__(self, vocabulary: Vocabulary, tokens: int, root: str):
        self.levels: list[Level] = [vocabulary]
        self.tokens, self.words, self.root = tokens, vocabulary.size, root

    def counts(self, n: int, nodes: np.ndarray) -> np.ndarray:
        return self.levels[n - 1].gather("count", nodes, np.int64)

    def contexts(self, lists: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context node of order n - 1, word, keep) for every position of the texts."""
        ids, begin = self.levels[0].ids(lists)
        node = ids
        for k in range(1, n):
            context = np.append(-1, node[:-1])
            context[begin] = -1
            if k == n - 1:
                return context, ids, (context >= 0) & (ids >= 0)
            node = np.full(ids.size, -1, np.int64)
            at = np.nonzero((context >= 0) & (ids >= 0))[0]
            own, inverse = np.unique(np.stack([context[at], ids[at]]), axis=1, return_inverse=True)
            node[at] = self.levels[k].find(own[0], own[1], self.counts(k, own[0]))[0][inverse.ravel()]
        raise ValueError(n)

    def score(self, lists: list[list[bytes]]) -> dict[str, np.ndarray]:
        """Tokens, known tokens, base score and log10 probability of each text."""
        ids, begin = self.levels[0].ids(lists)
        scored = np.ones(ids.size, bool)
        scored[begin] = False
        known = ids >= 0
        own, inverse = np.unique(ids, return_inverse=True)
        count = np.zeros(own.size, np.int64)
        count[own >= 0] = self.counts(1, own[own >= 0])
        p = ((count + 1) / (self.tokens + self.words + 1))[inverse]
        base, node = np.log10(p), ids
        for n in range(2, len(self.levels) + 1):
            context = np.append(-1, node[:-1])
            context[begin] = -1
            node = np.full(ids.size, -1, np.int64)
            at = np.nonzero(context >= 0)[0]
            c, inverse = np.unique(context[at], return_inverse=True)
            code = self.levels[n - 2].gather("backoff", c, np.uint16)
            p[at] *= np.where(code == NONE, 1.0, probability(code))[inverse]
            at = at[known[at]]
            width = self.words
            if (int(context.max(initial=0)) + 1) * width < 1 << 63:
                pair, inverse = np.unique(context[at] * width + ids[at], return_inverse=True)
                a, b = pair // width, pair % width
            else:
                pair, inverse = np.unique(np.stack([context[at], ids[at]]), axis=1, return_inverse=True)
                a, b, inverse = pair[0], pair[1], inverse.ravel()
            c, back = np.unique(a, return_inverse=True)
            found, own = self.levels[n - 1].find(a, b, self.counts(n - 1, c)[back])
            p[at] += own[inverse]
            node[at] = found[inverse]
        text = np.repeat(np.arange(len(lists)), np.diff(np.append(begin, ids.size)))
        total = lambda x: np.bincount(text[scored], x[scored], len(lists))
        return {"n_tokens": total(np.ones(ids.size)).astype(np.int64), "n_known": total(known).astype(np.int64), "base_score": total(base), "score": total(np.log10(p))}


def _count_words(docs: DataFrame) -> DataFrame:
    def run(batches):
        for _, lists in text_groups(batches, SHARD_TOKENS):
            counts = Counter({END: len(lists)})
            for own in lists:
                counts.update(own)
            h = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
            n = np.fromiter(counts.values(), np.int64, len(counts))
            for i in range(0, h.size, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i:i + 100_000]), pa.array(n[i:i + 100_000])], names=["h", "n"])
    return texts_of(docs, F.lit(0).alias("row")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _write_vocabulary(words: DataFrame, root: str, bits: int) -> Vocabulary:
    make_dirs(root)

    def build(key, table):
        h, n = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(h)
        rest = h[order] & np.uint64((1 << (64 - bits)) - 1)
        save(f"{root}/{key[0].as_py()}", {**prefixed("hash", EliasFano.encode(rest)), "count": n[order]})
        return pa.table({"shard": [key[0].as_py()], "n": [h.size]})

    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    built = words.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard long, n long").collect()
    return Vocabulary(root, bits, {r["shard"]: r["n"] for r in built})


def _add_order(trie: Trie, docs: DataFrame, counted: bool, per_file: int) -> None:
    """Count the next order and write its files, then the back-off mass of its contexts beside the order below."""
    n = len(trie.levels) + 1
    root = make_dirs(f"{trie.root}/order{n}")
    below = trie.levels[-1]
    rule = ShardRule(below.size, trie.tokens, trie.words, per_file)

    def pairs(batches):
        def handed(context, word, times):
            c, back = np.unique(context, return_inverse=True)
            rows = {"name": [], "context": [], "word": [], "times": []}
            for name, at in rule.split(context, word, trie.counts(n - 1, c)[back]):
                rows["name"].append(name)
                rows["context"].append(_pack(np.diff(context[at], prepend=0)))
                rows["word"].append(_pack(word[at]))
                rows["times"].append(_pack(times[at] - 1))
            return pa.RecordBatch.from_pydict(rows)

        held = []
        for _, lists in text_groups(batches, SHARD_TOKENS // 8):
            context, word, keep = trie.contexts(lists, n)
            held.append(summed_pairs(context[keep], word[keep]))
            if sum(x[0].size for x in held) >= SHARD_TOKENS // 2:
                yield handed(*summed_pairs(*(np.concatenate(x) for x in zip(*held))))
                held = []
        if held:
            yield handed(*summed_pairs(*(np.concatenate(x) for x in zip(*held))))

    def build(key, table):
        name = key[0].as_py()
        columns = [[_unpack(x) for x in table.column(c).to_pylist()] for c in ("context", "word", "times")]
        context, word, times = summed_pairs(np.concatenate([np.cumsum(x) for x in columns[0]]), np.concatenate(columns[1]), np.concatenate(columns[2]) + 1)
        first = np.append(0, np.nonzero(np.diff(context))[0] + 1)
        own, ends = context[first], np.append(first[1:], context.size)
        base = np.append(0, np.cumsum(word[ends - 1] + 1)[:-1])
        share = (times - DISCOUNT) / np.repeat(trie.counts(n - 1, own), ends - first)
        save(f"{root}/{name}", {**prefixed("context", EliasFano.encode(own)), **prefixed("pointer", EliasFano.encode(np.append(first, context.size))),
                                **prefixed("successor", EliasFano.encode(word + np.repeat(base, ends - first))), "code": quantise(share),
                                **({"count": times} if counted else {})})
        return pa.table({"name": [name], "n": [context.size], "context": [_pack(np.diff(own, prepend=0))], "types": [_pack(ends - first)]})

    blobs = texts_of(docs, F.lit(0).alias("row")).mapInArrow(pairs, "name string, context binary, word binary, times binary")
    built = written(blobs.groupBy("name").applyInArrow(build, "name string, n long, context binary, types binary"), "built")
    sizes = {r["name"]: r["n"] for r in built.select("name", "n").collect()}

    def masses(batches):
        for batch in batches:
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                context, types = np.cumsum(_unpack(c)), _unpack(t)
                for k, at, local in below.by_shard(context):
                    yield pa.RecordBatch.from_pydict({"shard": [k], "local": [_pack(local)], "types": [_pack(types[at])]})

    def mass(key, table):
        k = key[0].as_py()
        types = np.zeros(int(below.starts[k + 1] - below.starts[k]), np.int64)
        for local, t in zip(table.column("local").to_pylist(), table.column("types").to_pylist()):
            np.add.at(types, _unpack(local), _unpack(t))
        count = below.files(below.names[k])["count"]
        save(f"{below.files.root}/{below.names[k]}.backoff", {"backoff": np.where(types > 0, quantise(DISCOUNT * types / count), NONE).astype(np.uint16)})
        return pa.table({"shard": [k]})

    done = {r["shard"] for r in built.select("context", "types").mapInArrow(masses, "shard long, local binary, types binary").groupBy("shard").applyInArrow(mass, "shard long").collect()}
    for k, size in enumerate(np.diff(below.starts).tolist()):
        if size and k not in done:  # a file whose nodes never are a context
            save(f"{below.files.root}/{below.names[k]}.backoff", {"backoff": np.full(size, NONE, np.uint16)})
    names = sorted(sizes)
    trie.levels.append(Order(root, names, [sizes[x] for x in names], rule))


def train(docs: DataFrame, order: int = 2, per_file: int = SHARD_TOKENS) -> Trie:
    """Count the words and n-grams of all given documents into a trie below the shared folder.

    Every document is its lower-cased words and one end. Order 1 is the vocabulary with exact counts. Higher orders keep
    log10 of the discounted share (n - 0.75) / count(context) of every n-gram seen, in 16 bits, and with each context the back-off
    mass 0.75 * types / count. Tasks count by parts before they shuffle; a file is built from about ``per_file``
    tokens however large the corpus is, and a frequent context is split over several. The files need a shared
    folder that is mounted on every machine.
    """
    root = make_dirs(local_path(new_path(docs.sparkSession, "trie")))
    words = written(_count_words(docs), "words")
    size, tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (max(size, 1) - 1) // SHARD_WORDS).bit_length()
    trie = Trie(_write_vocabulary(words, f"{root}/order1", bits), tokens, root)
    for n in range(2, order + 1):
        if not tokens:
            break
        _add_order(trie, docs, n < order, per_file)
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Per document doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probability of the whole text).

    The probability of a token is its discounted share after the longest context plus the back-off mass times the probability
    after the shorter one; order 1 is (count + 1) / (tokens + words + 1), which also serves unknown words. Null and empty texts are the
    end alone. Repeated rows are scored one by one; a null doc_id is kept. An empty table gives an empty result, an
    untrained trie the score 0 per token. Other columns are not read.
    """
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for batch in batches:
            for ids, lists in text_groups([batch], SHARD_TOKENS // 8):
                out = trie.score(lists)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out["n_tokens"]), pa.array(out["n_known"]),
                                                  pa.array(np.full(len(ids), trie.tokens)), pa.array(out["base_score"]), pa.array(out["score"])], names=names)

    kinds = {"n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double"}
    return texts_of(docs, "doc_id").mapInArrow(run, docs.select("doc_id", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).schema)
