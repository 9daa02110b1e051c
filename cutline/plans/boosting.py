"""Boosted trees on binned features, many units at once: one round grows the next tree of every unit and class.

Features are cut at shared quantiles into bins; bin 0 holds the missing values and goes to the side that fits it better, so nothing is imputed. Rows stay in
blocks of numpy arrays on the executors. A level of all trees is one sum of (unit, class, node, feature, bin) statistics, added up and searched
unit by unit there; only the new splits and leaf values reach the driver, whatever the number of rows. Scores are kept beside the bins, persisted, and cut in the shared folder every CUT rounds.
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import finite
from ..operators.ranks import quantiles
from ..session import checkpoint_folder, cut_lineage

BINS = 64            # of values, beside the one for missing values
RESIDUAL_BINS = 2048  # of a leaf's residuals, whose median the absolute loss takes
BLOCK_ROWS = 1 << 15
CUT = 25             # rounds after which the scores' lineage is cut
DEFAULTS = {"maxIter": 150, "stepSize": 0.05, "maxDepth": 4, "minInstancesPerNode": 40}


@dataclass
class Blocks:
    """Rows of one block: unit number, bins of every feature, target, score of every class."""
    unit: np.ndarray
    bins: np.ndarray
    y: np.ndarray
    score: np.ndarray


@dataclass
class Trees:
    """One round's complete trees by (unit, class): feature (-1: no split), last bin that goes left, side of missing values, leaf values."""
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    leaf: np.ndarray

    def place(self, unit: np.ndarray, bins: np.ndarray, k: int, depth: int) -> np.ndarray:
        """Node numbers at a depth, of all rows in the trees of class k."""
        at = np.zeros(unit.size, np.int64)
        for level in range(depth):
            node = at + (1 << level) - 1
            f = self.feature[unit, k, node]
            value = bins[np.arange(unit.size), np.maximum(f, 0)]
            left = np.where(value == 0, self.missing_left[unit, k, node], value <= self.cut[unit, k, node]) | (f < 0)
            at = 2 * at + ~left
        return at


class Loss:
    """Gradient, curvature and value per row and class; ``size`` classes."""

    def __init__(self, name: str, size: int = 1):
        if name not in ("absolute", "logistic", "softmax"):
            raise ValueError(f"loss '{name}' unknown")
        self.name, self.size = name, size

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        if self.name == "logistic":
            return 1 / (1 + np.exp(-score))
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def parts(self, b: Blocks):
        """(gradient, curvature, loss) of the rows."""
        if self.name == "absolute":
            d = b.score[:, 0] - b.y
            return np.sign(d)[:, None], np.ones((d.size, 1)), np.abs(d)
        p = self.probabilities(b.score)
        if self.name == "logistic":
            q = np.where(b.y > 0, p[:, 0], 1 - p[:, 0])
            return p - (b.y > 0)[:, None], np.maximum(p * (1 - p), 1e-12), -np.log(np.maximum(q, 1e-300))
        own = np.arange(b.y.size), b.y.astype(np.int64)
        g = p.copy()
        g[own] -= 1
        return g, np.maximum(p * (1 - p), 1e-12), -np.log(np.maximum(p[own], 1e-300))


def _level(b: Blocks, trees: Trees, loss: Loss, level: int, units: int) -> list[np.ndarray]:
    """[statistics (unit, class, node, feature, bin, 3), loss and rows (unit, 2)] of a block. The three are gradient, curvature and count."""
    g, h, value = loss.parts(b)
    nodes, features = 1 << level, b.bins.shape[1]
    stats = np.zeros((units, loss.size, nodes, features, BINS + 1, 3))
    for k in range(loss.size):
        cell = (b.unit * nodes + trees.place(b.unit, b.bins, k, level)) * (BINS + 1)
        for f in range(features):
            key = cell + b.bins[:, f]
            for s, w in enumerate((g[:, k], h[:, k], None)):
                stats[:, k, :, f, :, s] += np.bincount(key, w, units * nodes * (BINS + 1)).reshape(units, nodes, BINS + 1)
    return [stats, np.stack([np.bincount(b.unit, value, units), np.bincount(b.unit, minlength=units)], axis=1)]


def _splits(stats: np.ndarray, allowed: np.ndarray, least: int):
    """Best (feature, cut, side of missing values) of every unit, class and node, and the statistics of both sides."""
    total = stats.sum(axis=4, keepdims=True)
    right = np.cumsum(stats[..., 1:, :], axis=4)               # values up to each bin
    found = []
    for missing_left in (True, False):
        low = right[..., :-1, :] + (stats[..., :1, :] if missing_left else 0)
        high = total - low
        ok = (low[..., 2] >= least) & (high[..., 2] >= least) & allowed[:, None, None, :, None]
        worth = low[..., 0] ** 2 / np.maximum(low[..., 1], 1e-12) + high[..., 0] ** 2 / np.maximum(high[..., 1], 1e-12)
        found.append(np.where(ok, worth, -np.inf))
    worth = np.stack(found, axis=-1)                           # unit, class, node, feature, bin, side
    flat = worth.reshape(*worth.shape[:3], -1)
    best = np.round(flat, 9).argmax(axis=-1)
    f, rest = np.divmod(best, worth.shape[4] * 2)
    cut, side = np.divmod(rest, 2)
    whole = total[..., 0, 0, :]
    gain = np.take_along_axis(flat, best[..., None], -1)[..., 0] - whole[..., 0] ** 2 / np.maximum(whole[..., 1], 1e-12)
    split = gain > 1e-9
    u, c, n = np.indices(best.shape)
    left = right[u, c, n, f, cut] + np.where((side == 0)[..., None], stats[u, c, n, f, 0], 0)
    left = np.where(split[..., None], left, whole)
    return np.where(split, f, -1), cut + 1, side == 0, left, whole - left


def _residuals(b: Blocks, trees: Trees, depth: int, units: int, reach: float) -> list[np.ndarray]:
    """[counts of residuals by (unit, leaf, bin), rows by unit] of a block."""
    leaf = trees.place(b.unit, b.bins, 0, depth)
    r = np.clip((b.y - b.score[:, 0] + reach) / (2 * reach) * RESIDUAL_BINS, 0, RESIDUAL_BINS - 1).astype(np.int64)
    leaves = 1 << depth
    counts = np.bincount((b.unit * leaves + leaf) * RESIDUAL_BINS + r, minlength=units * leaves * RESIDUAL_BINS)
    return [counts.reshape(units, leaves, RESIDUAL_BINS), np.bincount(b.unit, minlength=units)]


def _medians(counts: np.ndarray, reach: float) -> np.ndarray:
    """The middle of each leaf's residuals, interpolated inside its bin; 0 for an empty leaf."""
    total = counts.sum(axis=-1, keepdims=True)
    upto = np.cumsum(counts, axis=-1)
    at = (upto >= total / 2).argmax(axis=-1)[..., None]
    inside = np.take_along_axis(counts, at, -1)
    share = (total / 2 - (np.take_along_axis(upto, at, -1) - inside)) / np.maximum(inside, 1)
    return np.where(total > 0, ((at + share) / RESIDUAL_BINS * 2 - 1) * reach, 0.0)[..., 0]


def _moved(b: Blocks, trees: Trees, depth: int) -> Blocks:
    """The block after a round."""
    step = np.stack([trees.leaf[b.unit, k, trees.place(b.unit, b.bins, k, depth)] for k in range(b.score.shape[1])], axis=1)
    return Blocks(b.unit, b.bins, b.y, b.score + step)


def bin_edges(df: DataFrame, features) -> np.ndarray:
    """(features, BINS - 1) ascending quantiles of each feature's values; unused places are infinite."""
    x = df.select(*[finite(F.col(f).cast("double")).alias(f) for f in features]).unpivot([], list(features), "feature", "value").where("value IS NOT NULL")
    probs = {f"q{i}": i / BINS for i in range(1, BINS)}
    out = np.full((len(features), BINS - 1), np.inf)
    for row in quantiles(x, ["feature"], "value", probs).collect():
        own = np.unique([v for v in row[1:] if v is not None])
        out[list(features).index(row["feature"]), :own.size] = own
    return out


def _binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of (rows, features) values: 0 if missing, else 1 and the number of edges not above the value."""
    out = np.zeros(values.shape, np.uint8)
    for f in range(values.shape[1]):
        have = np.isfinite(values[:, f])
        out[have, f] = 1 + np.searchsorted(edges[f], values[have, f], "right")
    return out


class Boosted:
    """Trees of all units. ``fit`` takes the rows with columns unit (0..units-1), y and the features; ``allowed`` says which features a unit may use."""

    def __init__(self, features, loss: str, classes: int = 1, **params):
        self.features, self.loss, self.params = list(features), Loss(loss, classes), {**DEFAULTS, **params}
        self.rounds: list[Trees] = []
        self.curve: list[np.ndarray] = []

    def fit(self, df: DataFrame, units: int = 1, allowed: np.ndarray | None = None, edges: np.ndarray | None = None):
        spark, depth = df.sparkSession, int(self.params["maxDepth"])
        allowed = np.ones((units, len(self.features)), bool) if allowed is None else np.asarray(allowed, bool)
        x = df.select(F.col("unit").cast("int").alias("unit"), F.col("y").cast("double").alias("y"), *[finite(F.col(f).cast("double")).alias(f"x{i}") for i, f in enumerate(self.features)])
        x = cut_lineage(x.where("y IS NOT NULL"))
        self.edges = bin_edges(df, self.features) if edges is None else edges
        self.base, reach = self._base(x, units)
        edges, base = self.edges, self.base

        def blocks(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    unit, y, *values = (c.to_numpy(zero_copy_only=False) for c in part.columns)
                    bins = _binned(np.stack(values, axis=1).astype(float), edges)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Blocks(unit.astype(np.int64), bins, y, base[unit]))], pa.binary())], names=["block"])

        tasks = -(-x.count() // BLOCK_ROWS)  # the sums of a level are quick; more tasks than blocks would only wait for each other
        held = [x.coalesce(max(1, tasks)).mapInArrow(blocks, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)]
        checkpoint_folder(spark)
        for number in range(int(self.params["maxIter"]) + 1):
            node = (units, self.loss.size, (1 << depth) - 1)
            trees = Trees(np.full(node, -1, np.int64), np.zeros(node, np.int64), np.zeros(node, bool), np.zeros((units, self.loss.size, 1 << depth)))
            sums = self._grow(held[-1], trees, units, allowed, last=number == int(self.params["maxIter"]))
            for old in held[:-1]:
                old.unpersist()
            held = held[-1:]
            if sums is None:
                break
            trees.leaf[:] = self._leaves(held[-1], trees, sums, units, reach)
            self.rounds.append(trees)
            nxt = held[-1].map(lambda b, t=trees: _moved(b, t, depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % CUT == CUT - 1:
                nxt.checkpoint()
            held.append(nxt)
        held[-1].unpersist()
        return self

    def _base(self, x: DataFrame, units: int) -> tuple[np.ndarray, float]:
        """First scores by unit (median, log odds or log shares) and how far residuals reach."""
        k = self.loss.size
        if self.loss.name == "absolute":
            rows = quantiles(x, ["unit"], "y", {"m": 0.5}).collect()
            out = np.zeros((units, 1))
            for r in rows:
                out[r["unit"], 0] = r["m"]
            low, high = x.agg(F.min("y"), F.max("y")).first()
            return out, max(1e-9, float((high or 0) - (low or 0)))
        counts = np.ones((units, 2 if k == 1 else k))  # each class once more: none has a probability of zero
        for r in x.groupBy("unit", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["unit"], r["y"]] += r["n"]
        share = np.log(counts / counts.sum(axis=1, keepdims=True))
        return (share[:, 1:] - share[:, :1] if k == 1 else share), 0.0

    def _grow(self, rows, trees: Trees, units: int, allowed, last: bool):
        """Fill the splits level by level; the statistics of the leaves, or None after the last round, when only the loss is wanted."""
        depth, loss, least = int(self.params["maxDepth"]), self.loss, int(self.params["minInstancesPerNode"])
        sums = np.zeros((units, loss.size, 1 << depth, 3))
        for level in range(depth):
            now = Trees(trees.feature.copy(), trees.cut.copy(), trees.missing_left.copy(), trees.leaf)
            found = _by_unit(rows, lambda b, t=now, v=level: _level(b, t, loss, v, units))
            found = found.map(lambda e: (e[0], e[1][1], *_splits(e[1][0][None], allowed[e[0]:e[0] + 1], least))).collect()
            if not found and not self.rounds:
                return None
            if level == 0:
                value = np.zeros(units)
                for u, (total, n), *_ in found:
                    value[u] = total / n
                self.curve.append(value)
                if last:
                    return None
            here = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            for u, _, feature, cut, missing_left, left, right in found:
                trees.feature[u, :, here], trees.cut[u, :, here], trees.missing_left[u, :, here] = feature[0], cut[0], missing_left[0]
                if level == depth - 1:
                    sums[u] = np.stack([left, right], axis=3).reshape(loss.size, 1 << depth, 3)
        return sums

    def _leaves(self, rows, trees: Trees, sums: np.ndarray, units: int, reach: float) -> np.ndarray:
        """Leaf values times the step: the median residual, or a Newton step on the leaf's sums."""
        depth, step = int(self.params["maxDepth"]), float(self.params["stepSize"])
        if self.loss.name == "absolute":
            out = np.zeros((units, 1, 1 << depth))
            for u, middle in _by_unit(rows, lambda b: _residuals(b, trees, depth, units, reach)).mapValues(lambda v: _medians(v[0], reach)).collect():
                out[u, 0] = step * middle
            return out
        shrink = (self.loss.size - 1) / self.loss.size if self.loss.size > 1 else 1.0
        return -step * shrink * sums[..., 0] / np.maximum(sums[..., 1], 1e-12)

    def falls(self, unit: int, tolerance: float = 1e-3) -> bool:
        """Whether the unit's training loss fell and never rose (a model without any row has none); a leaf's median is known to one of RESIDUAL_BINS, hence the tolerance."""
        curve = [c[unit] for c in self.curve]
        return not curve or bool(curve[-1] <= curve[0]) and all(b <= a + tolerance * max(1.0, a) for a, b in zip(curve, curve[1:]))

    def scores(self, values: np.ndarray, unit: np.ndarray) -> np.ndarray:
        bins, depth = _binned(values, self.edges), int(self.params["maxDepth"])
        b = Blocks(unit, bins, np.zeros(unit.size), self.base[unit])
        for trees in self.rounds:
            b = _moved(b, trees, depth)
        return b.score

    def transform(self, df: DataFrame, out: str, unit: str | None = None) -> DataFrame:
        """Scores (absolute loss) or probabilities of all classes as an array column."""
        from pyspark.sql.functions import pandas_udf
        model = df.sparkSession.sparkContext.broadcast(self)

        @pandas_udf("array<double>")
        def score(unit, *columns):
            import pandas as pd
            own = model.value
            s = own.scores(np.stack([c.to_numpy(float) for c in columns], axis=1), unit.to_numpy(np.int64))
            if own.loss.name == "logistic":
                p = own.loss.probabilities(s)
                s = np.concatenate([1 - p, p], axis=1)
            elif own.loss.name == "softmax":
                s = own.loss.probabilities(s)
            return pd.Series(list(s))

        cols = [finite(F.col(f).cast("double")) for f in self.features]
        return df.withColumn(out, score(F.lit(0) if unit is None else F.col(unit), *cols))

    def state(self) -> dict:
        """Numbers that restore the model."""
        return {"features": self.features, "loss": self.loss.name, "classes": self.loss.size, "params": self.params, "edges": self.edges.tolist(), "base": self.base.tolist(),
                "rounds": [[t.feature.tolist(), t.cut.tolist(), t.missing_left.astype(int).tolist(), t.leaf.tolist()] for t in self.rounds]}

    @classmethod
    def from_state(cls, st: dict) -> "Boosted":
        out = cls(st["features"], st["loss"], st["classes"], **st["params"])
        out.edges, out.base = np.array(st["edges"], float).reshape(len(st["features"]), -1), np.array(st["base"], float)
        out.rounds = [Trees(np.array(f, np.int64), np.array(c, np.int64), np.array(m, bool), np.array(v, float)) for f, c, m, v in st["rounds"]]
        return out


def _by_unit(rows, table):
    """(unit, tables) of all blocks, added up unit by unit in the tasks. The last of a block's tables counts its rows; units without any are left out."""
    add = lambda a, b: [u + v for u, v in zip(a, b)]

    def summed(part):
        total = None
        for b in part:
            total = table(b) if total is None else add(total, table(b))
        if total is not None:
            n = total[-1] if total[-1].ndim == 1 else total[-1][:, -1]
            yield from ((int(u), [t[u] for t in total]) for u in np.flatnonzero(n))

    own = rows.mapPartitions(summed)
    return own if rows.getNumPartitions() == 1 else own.reduceByKey(add)
