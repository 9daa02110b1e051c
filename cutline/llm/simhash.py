"""SimHash fingerprints and a hierarchical index in Gray order that links those at a small Hamming distance."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lower_ascii, merge_labels, texts_of, written

BLOCK = 4096        # fingerprints of one leaf block; a memory bound, not a cap on the data
FAN = 8             # children of a node inside a block
SHINGLES = 1 << 15  # shingles whose bits are counted at once
PAIRS = 1 << 16     # node pairs expanded at once


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without a word."""
    tokens = lower_ascii(text or b"").split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends, n = ends[words - 1:].tolist(), len(tokens) - words + 1
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, SHINGLES):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[i:min(i + SHINGLES, n)], ends[i:i + SHINGLES])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.uint32)
    chosen = np.packbits((votes * 2 > n).astype(np.uint8), bitorder="little")
    return int(chosen.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint's 64 bits as a long."""
    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])
    return texts_of(docs, "doc_id").mapInArrow(run, docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def gray_rank(column):
    """The place of a bit pattern in the Gray code, as a signed long in the same order."""
    rank = column
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _shared(ones, any_):
    """The mask of bits that all members of a node have in common, from their AND and OR."""
    return ~(ones ^ any_)


def _blocks(classes: DataFrame, parts: int) -> DataFrame:
    """Sorted runs of at most BLOCK fingerprints as packed rows with their shared pattern."""
    def run(batches):
        part = None
        held, k = [], 0

        def packed(table, k):
            fp = table.column("fp").to_numpy()
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int64()), "block": pa.array([(part << 24) + k], pa.int64()), "n": pa.array([len(fp)], pa.int64()),
                "ones": pa.array([np.bitwise_and.reduce(fp)], pa.int64()), "any": pa.array([np.bitwise_or.reduce(fp)], pa.int64()),
                "fps": pa.array([fp.tobytes()], pa.binary()), "reps": pa.array([table.column("rep").to_numpy().tobytes()], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
                held.append(batch)
                table = pa.Table.from_batches(held)
                while table.num_rows >= BLOCK:
                    yield packed(table.slice(0, BLOCK), k)
                    table, k = table.slice(BLOCK), k + 1
                held = table.to_batches()
        if held and sum(b.num_rows for b in held):
            yield packed(pa.Table.from_batches(held), k)

    ordered = classes.repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("fp", "rep", F.spark_partition_id().cast("long").alias("part"))
    return ordered.mapInArrow(run, "part long, block long, n long, ones long, any long, fps binary, reps binary")


def _near_blocks(blocks: DataFrame, distance: int) -> DataFrame:
    """Pairs of blocks (a <= b) that may hold fingerprints within the distance.

    Nodes above the blocks carry the bits their members share. Pairs descend level by level; a pair whose
    shared bits already differ too often is dropped with everything below it.
    """
    levels = [blocks.select(F.col("block").alias("id"), F.col("part").alias("up"), "ones", "any")]
    top = levels[0].agg(F.max("up")).first()[0]
    while True:
        below = levels[-1]
        levels.append(below.groupBy(F.col("up").alias("id")).agg(F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any"))
                      .select("id", F.shiftright("id", 6).alias("up"), "ones", "any"))
        if top == 0:
            break
        top >>= 6
    levels = [written(x, "nodes") for x in levels]
    pairs = levels[-1].select(F.col("id").alias("a"), F.col("id").alias("b"))
    for nodes in reversed(levels[:-1]):
        left = nodes.select(F.col("up").alias("a"), F.col("id").alias("a2"), F.col("ones").alias("oa"), F.col("any").alias("ya"))
        right = nodes.select(F.col("up").alias("b"), F.col("id").alias("b2"), F.col("ones").alias("ob"), F.col("any").alias("yb"))
        apart = F.expr("bit_count((oa ^ ob) & ~(oa ^ ya) & ~(ob ^ yb))")
        pairs = written(pairs.join(left, "a").join(right, "b").where((F.col("a2") <= F.col("b2")) & (apart <= distance))
                        .select(F.col("a2").alias("a"), F.col("b2").alias("b")), "pairs")
    return pairs


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ones, any) of every node, from the single fingerprints up to at most FAN nodes."""
    levels = [(fp, fp)]
    while levels[-1][0].size > FAN:
        ones, any_ = levels[-1]
        at = np.arange(0, ones.size, FAN)
        levels.append((np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at)))
    return levels


def link_blocks(fa: np.ndarray, fb: np.ndarray, same: bool, distance: int) -> np.ndarray:
    """Labels over fa followed by fb: linked entries share the smallest index of their class."""
    la, lb = _levels(fa), (None if same else _levels(fb))
    lb = la if same else lb
    while len(la) < len(lb):
        la.append(la[-1])
    while len(lb) < len(la):
        lb.append(lb[-1])
    # a repeated top level has itself as its only child
    steps = lambda ls, k, i: (i[:, None] if ls[k] is ls[k - 1] else i[:, None] * FAN + np.arange(FAN))
    label = np.arange(fa.size + (0 if same else fb.size))
    shift = 0 if same else fa.size

    def close(k, i, j):
        (oa, ya), (ob, yb) = la[k], lb[k]
        differ = (oa[i] ^ ob[j]) & _shared(oa[i], ya[i]) & _shared(ob[j], yb[j])
        return np.bitwise_count(differ.view(np.uint64)) <= distance

    top = len(la) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(la[top][0].size), np.arange(lb[top][0].size), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        k, i, j = stack.pop()
        keep = (i <= j) if same and k else (i < j) if same else slice(None)
        i, j = i[keep], j[keep]
        near = close(k, i, j)
        i, j = i[near], j[near]
        if not k:
            merge_labels(label, i, j + shift)
            continue
        for s in range(0, i.size, PAIRS):
            ci, cj = steps(la, k, i[s:s + PAIRS]), steps(lb, k, j[s:s + PAIRS])
            ci, cj = np.repeat(ci, cj.shape[1], axis=1).ravel(), np.tile(cj, (1, ci.shape[1])).ravel()
            inside = (ci < la[k - 1][0].size) & (cj < lb[k - 1][0].size)
            stack.append((k - 1, ci[inside], cj[inside]))
    return label


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3) -> DataFrame:
    """Fingerprint every document and link fingerprints that differ in at most ``distance`` bits.

    Returns doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links
    lead to. Distinct fingerprints are sorted by Gray rank and cut into blocks; node patterns prune block pairs,
    and the same descent runs inside each remaining pair. From a pair only a spanning forest
    leaves the task, so groups of copies of any size stay small.

    Null and empty texts have the fingerprint zero and link like any other. A null doc_id links with nothing and has a
    null component. Repeated rows are returned as often as they come. An empty table gives an empty result. Other columns are not read.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    classes = written(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("rank", gray_rank(F.col("fp"))), "classes")
    n = classes.count()
    out = lambda comp: comp.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    if not n:
        return out(fps.withColumn("component_id", F.col("doc_id")))
    blocks = written(_blocks(classes, -(-n // BLOCK)), "blocks")
    pairs = _near_blocks(blocks, distance)
    sides = (pairs.select(F.struct("a", "b").alias("pair"), F.col("a").alias("block"))
             .unionByName(pairs.where("a < b").select(F.struct("a", "b").alias("pair"), F.col("b").alias("block"))))
    packed = sides.join(blocks.select("block", "fps", "reps"), "block")

    def link(key, table):
        table = table.sort_by("block")
        fp = [np.frombuffer(x, np.int64) for x in table.column("fps").to_pylist()]
        reps = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("reps").to_pylist()])
        label = link_blocks(fp[0], fp[-1], len(fp) == 1, distance)
        moved = np.nonzero(label != np.arange(label.size))[0]
        return pa.table({"u": reps[moved], "v": reps[label[moved]]})

    linked = components(packed.groupBy("pair").applyInArrow(link, "u long, v long"))
    named = classes.join(linked, classes.rep == linked.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = fps.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out(joined)
