"""Two tokenizers aligned over a corpus: each distinct text is tokenised once, pair counts are weighted by its number of copies."""

import hashlib
import json
import os
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CHUNK = 16 << 20      # bytes of text whose pairs are counted together
CACHE = 250_000       # segments whose alignment a worker remembers
GROUP = 64            # texts whose new segments are tokenised together
#: A space between two characters that are not white space: both tokenizers begin a token there, whatever stands around.
CUT = re.compile(r"(?<=\S) (?=\S)")
UNCLEAN = -1          # a piece that begins or ends with white space: its text is cut by CUT


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Texts to segments, segments to their tokens in both vocabularies, their groups and links."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        with open(byte_level, encoding="utf-8") as file:  # a prefix space of its own, or a normaliser, would move the offsets
            told = json.load(file)
        if told.get("normalizer") or told["pre_tokenizer"].get("type") != "ByteLevel" or told["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without normaliser and prefix space is expected")
        self._a = Tokenizer.from_file(byte_level)
        self._a.encode_special_tokens = True
        letters = byte_letters()
        self._a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self._a.get_vocab().items()}
        self._b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self._a_length = np.zeros(max(self._a_bytes) + 1, np.int64)
        self._a_length[list(self._a_bytes)] = list(map(len, self._a_bytes.values()))
        self._b_length = np.array(list(map(len, self._b_bytes)))
        #: Pieces that hold a space after something else would cross cuts; then texts stay whole.
        self._cuts = not any(re.search("[^▁]▁", p) for p in names)
        self._blank = self._b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self._known: dict[str, int] = {}
        self.sizes: list[tuple[int, int, int]] = []  # tokens in A, in B, groups; -1 groups: the tokens do not give the text back
        self.groups: list[str] = []
        self.links: list[bytes] = []

    def _align(self, texts: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> None:
        """Remember the alignment of each text. The byte offsets of all texts form one line: a stretch between two neighbouring token ends is a
        link, one between two shared ends a group."""
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        end_a, end_b, end = (np.cumsum(n) for n in (self._a_length[a], self._b_length[b], np.fromiter(map(len, texts), np.int64, len(texts))))
        past_a, past_b = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (ids_a, ids_b))
        ends = np.union1d(end_a, end_b)
        links = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        past_links = np.searchsorted(ends, end, "right")
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        past_groups = np.searchsorted(shared, end, "right")
        # the tokens in the order in which they are written: of each group first those in A, then those in B
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        place_a = np.arange(a.size) + np.searchsorted(group_b, group_a)
        place_b = np.arange(b.size) + np.searchsorted(group_a, group_b, "right")
        order, mark = np.empty(a.size + b.size, np.int64), np.zeros(a.size + b.size, np.int64)
        order[place_a], order[place_b] = a, b
        mark[place_a] = np.isin(end_a, shared, assume_unique=True)          # the group's last token in A
        mark[place_b] = 2 * np.isin(end_b, shared, assume_unique=True)
        mark[place_b[past_b - 1]] = 3
        said = "".join(chain.from_iterable(zip(map(str, order.tolist()), map(",|;\n".__getitem__, mark.tolist())))).split("\n")
        sizes = zip(np.diff(past_a, prepend=0).tolist(), np.diff(past_b, prepend=0).tolist(), np.diff(past_groups, prepend=0).tolist())
        bounds = [0, *past_links.tolist()]
        self.sizes.extend(sizes)
        self.groups.extend(said[:-1])
        self.links.extend(links[x:y].tobytes() for x, y in zip(bounds, bounds[1:]))

    def _give_back(self, texts: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether the bytes of a text's tokens are the text, in both vocabularies. All texts are compared as one first: with equal bytes and equal lengths each is."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = b"".join(texts)
        for ids, of, length in ((ids_a, self._a_bytes, self._a_length), (ids_b, self._b_bytes, self._b_length)):
            flat = list(chain.from_iterable(ids))
            past = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            size = np.append(0, np.cumsum(length[flat]))[past] if flat else past
            if not np.array_equal(size, np.cumsum(lengths)) or b"".join(map(of.__getitem__, flat)) != whole:
                break
        else:
            return [True] * len(texts)
        return [b"".join(map(self._a_bytes.__getitem__, a)) == t == b"".join(map(self._b_bytes.__getitem__, b)) for t, a, b in zip(texts, ids_a, ids_b)]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 1024):
            names = new[at:at + 1024]
            ids_a = [e.ids for e in self._a.encode_batch_fast([" " + t for t in names], add_special_tokens=False)]
            ids_b = [b if t else [self._blank] for t, b in zip(names, self._b.encode(names, num_threads=1))]
            texts = [b" " + t.encode() for t in names]
            good = self._give_back(texts, ids_a, ids_b)
            first = len(self.sizes)
            if any(good):
                self._align(*(list(compress(x, good)) for x in (texts, ids_a, ids_b)))
            lost = [i for i, ok in enumerate(good) if not ok]
            self.sizes.extend([(0, 0, -1)] * len(lost))
            self.groups.extend([""] * len(lost))
            self.links.extend([b""] * len(lost))
            self._known.update(zip([*compress(names, good), *[names[i] for i in lost]], range(first, len(self.sizes))))

    def segments(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's segments; a text is the segments with a space before each."""
        cut = [t.split(" ") for t in texts] if self._cuts else [[t] for t in texts]
        known = self._known
        new = list(set().union(*cut).difference(known))
        if self._cuts:
            odd = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
            known.update(dict.fromkeys(odd, UNCLEAN))
            new = [p for p in new if p not in known]
        self._learn(new)
        out = [np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces)) for pieces in cut]
        for i, numbers in enumerate(out):
            if self._cuts and numbers.min() < 0:
                pieces = CUT.split(texts[i])
                self._learn(list({p for p in pieces if known.get(p, UNCLEAN) < 0}))
                out[i] = np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """The worker's aligner; vocabularies are read once per process."""
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


_ROW = "chunk long, h1 long, h2 long, n_a long, n_b long, n_groups long, n_links long, groups string, segments binary"
_HEAD = "pairs array<long>, weights array<long>, bounds binary, places binary"
_ROW_TYPES = [*[pa.int64()] * 7, pa.string(), pa.binary()]
_HEAD_TYPES = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _chunk(own: Aligner, number: int, h1, h2, texts: list[bytes], copies: np.ndarray, digest: bool) -> pa.RecordBatch:
    """A row per text and one for the chunk: its distinct pairs, how often they are linked, and which pairs each segment links."""
    measures, written_groups, cut = [], [], []
    for at in range(0, len(texts), GROUP):
        if len(own.sizes) > CACHE and not cut:
            own.clear()
        for segments in own.segments([t.decode() for t in texts[at:at + GROUP]]):
            listed = segments.tolist()
            sizes = list(zip(*map(own.sizes.__getitem__, listed)))
            good = min(sizes[2]) >= 0
            a, b, groups = map(sum, sizes) if good else (0, 0, 0)
            measures.append((a, b, groups, a + b - groups))
            text = ";".join([own.groups[s] for s in listed]) if good else ""
            written_groups.append(hashlib.sha256(text.encode()).hexdigest() if good and digest else text)
            cut.append(segments if good else segments[:0])
    used, place = np.unique(np.concatenate(cut), return_inverse=True)
    links = [np.frombuffer(own.links[s], np.int64) for s in used.tolist()]
    each = np.array([x.size for x in links], np.int64)
    pairs, places = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True)
    times = np.bincount(place, np.repeat(copies, [c.size for c in cut]), used.size)
    weights = np.bincount(places, np.repeat(times, each), pairs.size).astype(np.int64)
    ends = np.cumsum([c.size for c in cut]).tolist()
    place = place.astype(np.int32)
    n = len(texts)
    rows = [pa.array([number] * n + [number], pa.int64()), pa.array(h1 + [None], pa.int64()), pa.array(h2 + [None], pa.int64()),
            *[pa.array([m[k] for m in measures] + [None], pa.int64()) for k in range(4)], pa.array(written_groups + [None], pa.string()),
            pa.array([place[b:e].tobytes() for b, e in zip([0, *ends], ends)] + [None], pa.binary())]
    head = [pairs, weights, np.append(0, np.cumsum(each)).astype(np.int64).tobytes(), places.astype(np.int32).tobytes()]
    return pa.RecordBatch.from_arrays(rows + [pa.array([None] * n + [x], t) for x, t in zip(head, _HEAD_TYPES)], names=_names(_ROW) + _names(_HEAD))


def aligned_texts(docs: DataFrame, byte_level: str, pieces: str, digest: bool) -> DataFrame:
    """The chunks of the distinct texts, each tokenised and aligned once."""
    def run(batches):
        own, number = aligner(byte_level, pieces), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, copies = batch.column(0), batch.column(1).to_numpy()
            size = np.cumsum(pc.binary_length(texts).to_numpy())
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                part = batch.slice(at, end - at)
                yield _chunk(own, number, part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(0).to_pylist(), copies[at:end], digest)
                number, at = number + 1, end

    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = texts.select(F.col("text").cast("binary").alias("bytes"), "copies", *text_keys())
    return keyed.mapInArrow(run, f"{_ROW}, {_HEAD}")


def text_keys() -> list:
    """Two independent 64-bit hashes that name a text."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def pair_counts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, counts): the distinct pairs of each chunk by number, and each pair's count with whether its B id has no higher one."""
    asked = chunks.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "weights")).alias("place", "x")).select("chunk", "place", "x.pairs", "x.weights")
    asked = asked.toDF("chunk", "place", "pair", "n")
    counts = written(asked.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return asked, counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _measure(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each text's sums over its links, from the counts of its chunk's pairs."""
    heads = left.filter(pc.is_valid(left.column("bounds")))
    rows = left.filter(pc.is_valid(left.column("h1")))
    bounds, places = (np.frombuffer(heads.column(c)[0].as_py(), t) for c, t in (("bounds", np.int64), ("places", np.int32)))
    segments = rows.column("segments").to_pylist()
    place = np.frombuffer(b"".join(segments), np.int32)
    ends = np.cumsum([len(s) // 4 for s in segments])
    at = right.column("place").to_numpy()
    out = [rows.column(c) for c in _names(_ROW)[1:-1]]
    for name in ("best", "count"):
        value = np.zeros(at.size, np.int64)
        value[at] = right.column(name).to_numpy()
        total = np.append(0, np.cumsum(value[places]))
        own = np.append(0, np.cumsum((total[bounds[1:]] - total[bounds[:-1]])[place]))
        out.append(pa.array(own[ends] - own[np.append(0, ends[:-1])]))
    return pa.table(out, names=[*_names(_ROW)[1:-1], "n_best", "count_sum"])


def align(docs: DataFrame, byte_level: str, pieces: str, digest: bool = False) -> DataFrame:
    """How the tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) overlap in every text.

    A encodes a space and the text, B the text, before which it puts a space; special tokens' names are plain text. Returns doc_id, n_a
    and n_b (tokens), n_groups (stretches between byte offsets where both end a token), n_links (overlapping pairs of tokens), n_best (links whose
    id pair is linked most often among all of its B id, ties included), count_sum (the corpus-wide counts of all links), groups
    (``a1,a2|b1;a3|b2``, or its SHA-256 with ``digest``), one row per row of ``docs``.

    1. Texts are shuffled by their whole content; each distinct one is tokenised and aligned once, in chunks of CHUNK bytes. Texts are cut at
       single spaces, where both tokenizers begin a token, and the segments' alignments are remembered.
    2. A chunk's distinct pairs, weighted by the copies of their texts, are summed over the corpus, and each chunk asks for those it has.
    3. The measures of a text are joined to the doc_ids of its copies by two 64-bit hashes.

    Null and empty texts, and texts that the tokens do not give back (U+2581), have no tokens: zeros and ''. Rows with a null doc_id and repeated
    rows come back like any other and count as often. An empty table gives an empty result. A very long text is a chunk of its own. Other columns are
    not read, so their names do not matter.
    """
    chunks = written(aligned_texts(docs.select("text"), byte_level, pieces, digest), "aligned")
    asked, counts = pair_counts(chunks.select("chunk", "pairs", "weights"))
    told = asked.join(counts, "pair").select("chunk", "place", "best", "count")
    left = chunks.select(*_names(_ROW), "bounds", "places")
    measured = left.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _measure, ", ".join([*_ROW.split(", ")[1:-1], "n_best long", "count_sum long"]))
    keyed = docs.select("doc_id", *text_keys())
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return keyed.join(measured, ["h1", "h2"], "left").select("doc_id", *zero, F.coalesce("groups", F.lit("")).alias("groups"))
