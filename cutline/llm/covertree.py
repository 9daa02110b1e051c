"""Exact cosine threshold links by dual traversal of cover trees."""

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, merge_labels, written

BLOCK = 4096      # vectors whose tree is built in one task, about
CENTRES = 1024    # cells of the top tree at most: a bounded sample, assigned to by every row
LEAF = 64         # vectors of a node that is not divided further
DENSE = 8         # members from which a child stands alone although most children are single vectors
SLACK = 1e-6      # of distances that come from rounded cosines; only clear bounds decide without comparing


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision, safe for very large and very small components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net: members farther than ``radius`` from one another, and each row's member within it."""
    owner, members, open_ = np.full(len(x), -1), [], np.arange(len(x))
    while open_.size:
        c = open_[0]
        near = distance(x[open_] @ x[c]) <= radius
        near[0] = True
        owner[open_[near]] = len(members)
        members.append(c)
        open_ = open_[~near]
    return np.array(members, np.int64), owner


@dataclass
class Tree:
    """Nodes in arrays; a node's vectors are ``order[start:end]``, its children are nodes below with half its radius."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    children: list

    @staticmethod
    def build(x: np.ndarray, leaf: int = LEAF) -> "Tree":
        order, rows = [], []

        def node(at, centre, level):
            cover = float(distance(x[at] @ x[centre]).max())
            k, begin = len(rows), len(order)
            rows.append([begin, begin, centre, cover, []])
            kids = []
            if len(at) > leaf and cover > SLACK:
                r = level
                while r >= cover:
                    r /= 2
                members, owner = net(x[at], r)
                sizes = np.bincount(owner)
                alone = sizes >= DENSE if len(members) > len(at) // 2 else np.ones(len(members), bool)
                if len(members) > 1 and (alone.any() and not alone.all() or alone.all()):
                    kids = [(at[owner == m], at[members[m]], r) for m in np.nonzero(alone)[0]]
                    rest = at[~alone[owner]]
                    if rest.size:  # single vectors far from each other stay one node
                        middle = rest[int(np.argmax(x[rest] @ x[rest].sum(0)))]
                        kids.append((rest, middle, None))
            if not kids:
                order.extend(at.tolist())
            for own, c, r in kids:
                rows[k][4].append(leaf_node(own, c) if r is None else node(own, c, r))
            rows[k][1] = len(order)
            return k

        def leaf_node(at, centre):
            rows.append([len(order), len(order) + len(at), centre, float(distance(x[at] @ x[centre]).max()), []])
            order.extend(at.tolist())
            return len(rows) - 1

        middle = int(np.argmax(x @ x.sum(0)))
        node(np.arange(len(x)), middle, 2.0)
        return Tree(np.array(order), np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), x[[r[2] for r in rows]],
                    np.array([r[3] for r in rows]), [r[4] for r in rows])


def links(a: Tree, xa: np.ndarray, wa: np.ndarray, b: Tree, xb: np.ndarray, wb: np.ndarray, same: bool, cosine: float):
    """Dual traversal. Vectors and weights stand in tree order.

    Returns for a's and b's vectors the weight linked to each, and labels over a followed by b. A node pair is dropped when
    even its closest members are too far, and counted whole when even the farthest are near enough; only leaves compare vectors.
    """
    limit = float(distance(np.array(cosine)))
    shift = 0 if same else len(xa)
    na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    label = np.arange(shift + len(xb))

    def whole(i, j):
        s, t = slice(a.start[i], a.end[i]), slice(b.start[j], b.end[j])
        if same and i == j:
            na[s] += wa[s].sum() - wa[s]
        else:
            na[s] += wb[t].sum()
            (na if same else nb)[t] += wa[s].sum()
        rows = np.concatenate([np.arange(s.start, s.stop), np.arange(t.start, t.stop) + shift])
        merge_labels(label, np.full(rows.size - 1, rows[0]), rows[1:])

    def compare(i, j):
        t = np.arange(b.start[j], b.end[j])
        for s0 in range(a.start[i], a.end[i], 1024):
            s = np.arange(s0, min(s0 + 1024, a.end[i]))
            hit = xa[s] @ xb[t].T >= cosine
            if same and i == j:
                hit &= s[:, None] < t
            p, q = np.nonzero(hit)
            u, v = s[p], t[q]
            np.add.at(na, u, wb[v])
            np.add.at(na if same else nb, v, wa[u])
            merge_labels(label, u, v + shift)

    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        if same and i == j:
            if 2 * a.radius[i] + SLACK <= limit:
                whole(i, i)
            elif a.children[i]:
                kids = a.children[i]
                stack += [(k, m) for n, k in enumerate(kids) for m in kids[n:]]
            else:
                compare(i, i)
            continue
        d = float(distance(a.centre[i] @ b.centre[j]))
        if d - a.radius[i] - b.radius[j] > limit + SLACK:
            continue
        if d + a.radius[i] + b.radius[j] + SLACK <= limit:
            whole(i, j)
        elif a.children[i] and (a.radius[i] >= b.radius[j] or not b.children[j]):
            stack += [(k, j) for k in a.children[i]]
        elif b.children[j]:
            stack += [(i, k) for k in b.children[j]]
        else:
            compare(i, j)
    return na, nb, label


def cells(sample: np.ndarray) -> np.ndarray:
    """Centres of the top tree over a bounded sample: nets nested in one another, radii halving until no two sampled vectors share one
    or the cells are as small as a quarter of any link could need."""
    kept, radius = np.zeros(1, np.int64), 2.0
    while radius > 1 / 64 and len(kept) < len(sample):
        radius /= 2
        order = np.concatenate([kept, np.setdiff1d(np.arange(len(sample)), kept)])
        members, _ = net(sample[order], radius)
        kept = order[members]
    return sample[kept]


def _link_dimension(classes: DataFrame, size: int, kind: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(rep, links) and edges (u, v) among classes of one dimension."""
    n = classes.count()
    wanted = min(CENTRES, -(-n // BLOCK))
    matrix = lambda column, d: column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    sample = classes.select("embedding", "rep").orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("embedding").toArrow().column(0).combine_chunks()
    centres = cells(unit(matrix(sample, size)))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                near = unit(matrix(batch.column(2), size)) @ centres.T
                cell = near.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(distance(near[np.arange(len(cell)), cell])), batch.column(2)],
                                                 names=["rep", "w", "cell", "far", "embedding"])

    rows = written(classes.select("rep", "w", "embedding").mapInArrow(assign, f"rep long, w long, cell long, far double, embedding {kind}"), "cells")
    found = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.sum("w").alias("w"), F.min("rep").alias("rep")).collect()}
    own = np.array(sorted(found), np.int64)
    cover = np.array([found[c]["far"] for c in own.tolist()])
    parts = np.array([-(-found[c]["n"] // BLOCK) for c in own.tolist()])
    limit = float(distance(np.array(cosine)))
    apart = distance(centres[own] @ centres[own].T)
    np.fill_diagonal(apart, 0.0)
    both = cover[:, None] + cover
    i, j = np.nonzero(np.triu(apart - both <= limit + SLACK))
    all_ = (apart + both + SLACK <= limit)[i, j]

    # pairs of cells whose members all link need no vectors: weights and one edge per row
    spark = classes.sparkSession
    add, edges = np.zeros(len(own), np.int64), []
    for a, b in zip(i[all_].tolist(), j[all_].tolist()):
        x, y = found[int(own[a])], found[int(own[b])]
        add[a] += y["w"]
        if a != b:
            add[b] += x["w"]
            edges.append((x["rep"], y["rep"]))
    inner = np.zeros(len(own), bool)
    inner[i[all_ & (i == j)]] = True
    cell_table = spark.createDataFrame(pa.table({"cell": own, "add": add, "whole": inner, "first": np.array([found[c]["rep"] for c in own.tolist()], np.int64)}))
    in_cells = rows.join(F.broadcast(cell_table), "cell").where("add > 0")
    sums = in_cells.select("rep", (F.col("add") - F.when(F.col("whole"), F.col("w")).otherwise(0)).alias("links"))
    joined = in_cells.where("whole").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    # a cell that links whole with another but not with itself still forms one component through that other cell
    other = {}
    for a, b in zip(i[all_].tolist(), j[all_].tolist()):
        if a != b:
            other.setdefault(int(own[a]), found[int(own[b])]["rep"])
            other.setdefault(int(own[b]), found[int(own[a])]["rep"])
    if other:
        across = spark.createDataFrame(pa.table({"cell": np.array(list(other), np.int64), "v": np.array(list(other.values()), np.int64)}))
        joined = joined.unionByName(rows.join(F.broadcast(across), "cell").select(F.col("rep").alias("u"), "v"))

    def build(key, table):
        raw = matrix(table.column("embedding").combine_chunks(), size)
        tree = Tree.build(unit(raw))
        held = {"tree": tree, "x": raw[tree.order], "rep": table.column("rep").to_numpy()[tree.order], "w": table.column("w").to_numpy()[tree.order]}
        return pa.table({"cell": [key[0].as_py()], "part": [key[1].as_py()], "block": [pickle.dumps(held, 5)]})

    parts_of = spark.createDataFrame(pa.table({"cell": own, "parts": parts}))
    cut = rows.join(F.broadcast(parts_of), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    blocks = written(cut.groupBy("cell", "part").applyInArrow(build, "cell long, part long, block binary"), "blocks")
    rest = ~all_
    table = spark.createDataFrame(pa.table({"a": own[i[rest]], "b": own[j[rest]], "pa": parts[i[rest]], "pb": parts[j[rest]]}))
    pairs = (table.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pa") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)))
             .where("a < b OR i <= j").select(F.struct("a", "i", "b", "j").alias("pair"), "a", "i", "b", "j"))
    sides = (pairs.select("pair", F.col("a").alias("cell"), F.col("i").alias("part"), F.lit(0).alias("side"))
             .unionByName(pairs.where("a < b OR i < j").select("pair", F.col("b").alias("cell"), F.col("j").alias("part"), F.lit(1).alias("side"))))

    def traverse(key, table):
        held = [pickle.loads(x) for x in table.sort_by("side").column("block").to_pylist()]
        a, b = held[0], held[-1]
        same = len(held) == 1
        xa = unit(a["x"])
        na, nb, label = links(a["tree"], xa, a["w"], b["tree"], xa if same else unit(b["x"]), b["w"], same, cosine)
        reps = a["rep"] if same else np.concatenate([a["rep"], b["rep"]])
        count = na if same else np.concatenate([na, nb])
        at = np.nonzero((count > 0) | (label != np.arange(label.size)))[0]
        return pa.table({"rep": reps[at], "links": count[at], "root": reps[label[at]]})

    near = written(sides.join(blocks, ["cell", "part"]).groupBy("pair").applyInArrow(traverse, "rep long, links long, root long"), "near")
    all_edges = near.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(joined)
    if edges:
        all_edges = all_edges.unionByName(spark.createDataFrame(edges, "u long, v long"))
    return near.select("rep", "links").unionByName(sums), all_edges


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Every vector's links at the cosine or above, over all rows: vec_id, n_links, component_id, kept.

    Equal vectors are one class with a weight. Classes go to the nearest centre of a top tree over a bounded sample; a cell's
    covering radius is what its rows need. Cell pairs are pruned, or counted whole, by their radii; the others meet in blocks of about
    BLOCK vectors, each with its own tree, and a task traverses two trees at once. Only counts and a spanning forest leave a
    task. Uniform vectors in many dimensions leave nothing to prune: then all block pairs are compared, as exactness asks.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    length do not link. A null vec_id links with nothing and has null results. Repeated rows count as vectors. An empty
    table gives an empty result. Other columns are not read.
    """
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    classes = written(rows.where(good).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")), "classes")
    links_, edges = None, None
    for size in sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect()):
        own = _link_dimension(classes.where(F.size("embedding") == size), size, kind, cosine)
        links_, edges = own if links_ is None else (links_.unionByName(own[0]), edges.unionByName(own[1]))
    if links_ is None:
        return rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.lit(0).cast("long")).alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept")).withColumn("kept", F.when(F.col("vec_id").isNotNull(), F.col("kept")))
    total = links_.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(edges)
    result = (classes.join(total, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
              .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    keyed = rows.select("vec_id", F.when(good, F.col("embedding")).alias("embedding"))
    lone = F.col("vec_id").isNotNull()
    return (keyed.join(result, "embedding", "left")
            .select("vec_id", F.when(lone, F.coalesce("n_links", F.lit(0))).alias("n_links"), F.when(lone, F.coalesce("component_id", "vec_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
