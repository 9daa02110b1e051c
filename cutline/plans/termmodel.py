"""Class-balanced logistic regression over (row, term) counts, with the terms dealt over the tasks.

Every vector of the search is a combination of the rows' term vectors, so it is held as one number per row, and products of two are products
of such numbers with margins. A step needs the margins of one combination, one job over blocks of whole terms; the step length needs none.
The driver holds some forty numbers per row and none per term.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

BLOCK = 1 << 16  # counts of one block, or those of one term if it has more
LONGEST = 60     # doublings and halvings of a step's length
BLOCKS = "terms array<string>, df binary, rows binary, tf binary"


def _limits(min_df, max_df, n: int):
    """Counts of rows when int, shares of them when float."""
    return tuple(v if isinstance(v, int) else v * n for v in (min_df, max_df))


def term_blocks(counts: DataFrame, keys, rows: DataFrame, low: float, high: float) -> DataFrame:
    """Counts of the rows (keys, _row), packed term by term; terms outside the limits on their rows are left out."""
    def packed(terms, df, rows, tf):
        return pa.RecordBatch.from_pydict({
            "terms": pa.array([terms.to_pylist()], pa.list_(pa.string())), "df": pa.array([df.astype("<i8").tobytes()], pa.binary()),
            "rows": pa.array([rows.astype("<i4").tobytes()], pa.binary()), "tf": pa.array([tf.tobytes()], pa.binary())})

    def whole(table):
        """Blocks of the terms of a sorted table."""
        codes = pc.run_end_encode(pa.concat_arrays(table.column("term").chunks), run_end_type=pa.int64())
        ends = codes.run_ends.to_numpy()
        df = np.diff(ends, prepend=0)
        keep = (df >= low) & (df <= high)
        row, tf = table.column("_row").to_numpy(), table.column("tf").to_numpy()
        held = np.repeat(keep, df)
        row, tf, terms, df = row[held], tf[held], codes.values.filter(pa.array(keep)), df[keep]
        at, cut = 0, np.cumsum(df)
        while at < len(df):
            end = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + BLOCK, "right")))
            part = slice(cut[at - 1] if at else 0, cut[end - 1])
            yield packed(terms[at:end], df[at:end], row[part], tf[part])
            at = end

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < 16 * BLOCK:
                continue
            table = pa.Table.from_batches(held)
            # the last term may go on in the next batch
            first = pc.index(table.column("term"), table.column("term")[-1]).as_py()
            if first:
                yield from whole(table.slice(0, first))
            held = table.slice(first).combine_chunks().to_batches()
            n = table.num_rows - first
        if held:
            yield from whole(pa.Table.from_batches(held))

    x = counts.join(rows, list(keys)).select("term", "_row", "tf").repartition("term").sortWithinPartitions("term", "_row")
    return cut_lineage(x.mapInArrow(run, BLOCKS))


def _weighted(df: bytes, tf: bytes, sublinear: bool, n: int):
    """Rows of each term, its inverse frequency, and the weights of its counts before they are scaled to length 1."""
    df, tf = np.frombuffer(df, "<i8"), np.frombuffer(tf)
    if not sublinear:
        return df, np.ones(len(df)), tf
    idf = np.log((1 + n) / (1 + df)) + 1
    return df, idf, (1 + np.log(tf)) * np.repeat(idf, df)


def _over_blocks(blocks: DataFrame, each, n: int) -> np.ndarray:
    """Sum over the blocks of a number per row."""
    def run(batches):
        total = np.zeros(n)
        for batch in batches:
            for df, rows, tf in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = np.frombuffer(rows, "<i4")
                total += np.bincount(rows, each(df, rows, tf), n)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"_row": pa.array(some.astype("int32")), "v": pa.array(total[some])})

    got = blocks.select("df", "rows", "tf").mapInArrow(run, "_row int, v double").groupBy("_row").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n)
    out[got.column("_row").to_numpy()] = got.column("v").to_numpy()
    return out


def balanced_weights(y: np.ndarray) -> np.ndarray:
    n, pos = len(y), max(y.sum(), 1.0)
    return np.where(y == 1, n / (2 * pos), n / (2 * max(n - pos, 1.0)))


def logistic_path(margins, y: np.ndarray, share: np.ndarray, penalty: float, max_iter: int, tol: float = 1e-6, memory: int = 10):
    """(combination of the rows, intercept) of the least weighted log loss plus penalty / 2 times the squared length, by L-BFGS.

    ``margins`` gives those of a combination; ``share`` are row weights of sum one. A vector is (combination, margins, intercept) end to end."""
    n, sign = len(y), 2 * y - 1
    dot = lambda u, v: u[:n] @ v[n:2 * n] + u[-1] * v[-1]
    score = lambda v: v[n:2 * n] + v[-1]
    length = lambda u, v: u[:n] @ v[n:2 * n]
    rest = lambda z: share * -sign / (1 + np.exp(np.clip(sign * z, -700, 700)))

    def loss(v):
        return share @ np.logaddexp(0, -sign * score(v)) + penalty / 2 * length(v, v)

    def gradient(v):
        r = rest(score(v))
        return np.concatenate([r + penalty * v[:n], margins(r) + penalty * v[n:2 * n], [r.sum()]])

    def step(v, d):
        """The length at which the loss along d has its slope zero; the loss is convex."""
        z, zd, vd, dd = score(v), score(d), length(v, d), length(d, d)
        slope = lambda t: rest(z + t * zd) @ zd + penalty * (vd + t * dd)
        lo, hi = 0.0, 1.0
        for _ in range(LONGEST):
            if slope(hi) >= 0:
                break
            lo, hi = hi, 2 * hi
        for _ in range(LONGEST):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if slope(mid) < 0 else (lo, mid)
        return hi

    v, past = np.zeros(2 * n + 1), []
    g, now = gradient(v), loss(v)
    for _ in range(max_iter):
        d, used = -g, []
        for s, yv, rho in reversed(past):
            a = rho * dot(s, d)
            used.append(a)
            d = d - a * yv
        if past:
            s, yv, _ = past[-1]
            d = d * (dot(s, yv) / dot(yv, yv))
        for (s, yv, rho), a in zip(past, reversed(used)):
            d = d + (a - rho * dot(yv, d)) * s
        if not dot(g, d) < 0:
            break
        new = v + step(v, d) * d
        g2, then = gradient(new), loss(new)
        s, yv = new - v, g2 - g
        if dot(s, yv) > 0:
            past = [*past, (s, yv, 1 / dot(s, yv))][-memory:]
        small = now - then <= tol * max(abs(now), tol)
        v, g, now = new, g2, then
        if small:
            break
    return v[:n], float(v[-1])


def fit_terms(terms, labels: DataFrame, limits, sublinear: bool, unit: bool, C: float, max_iter: int):
    """(terms with their inverse frequency and coefficient, intercept) from counted terms and the labels (keys, _y) of the rows to learn from."""
    spark, keys = labels.sparkSession, terms.keys
    known = labels.join(terms.held, keys, "left_semi").where("_y IS NOT NULL").orderBy(*keys).toArrow()
    n, y = known.num_rows, known.column("_y").to_numpy().astype(float)
    rows = spark.createDataFrame(known.select(keys).append_column("_row", pa.array(np.arange(n, dtype="int32"))))
    blocks = term_blocks(terms.counts, keys, rows, *_limits(*limits, n))
    scale = np.ones(n)
    if unit:
        square = _over_blocks(blocks, lambda df, rows, tf: _weighted(df, tf, sublinear, n)[2] ** 2, n)
        scale = 1 / np.sqrt(np.where(square > 0, square, 1.0))

    def margins(u):
        u = u * scale

        def each(df, rows, tf):
            df, _, x = _weighted(df, tf, sublinear, n)
            return x * np.repeat(np.add.reduceat(x * u[rows], np.cumsum(df) - df), df)

        return scale * _over_blocks(blocks, each, n)

    if len(set(y)) < 2:  # nothing to tell apart
        mix, intercept = np.zeros(n), float(np.inf if n and y[0] else -np.inf)
    else:
        weight = balanced_weights(y)
        mix, intercept = logistic_path(margins, y, weight / weight.sum(), 1.0 / (C * max(n, 1)), max_iter)
    u = mix * scale

    def coefficients(batches):
        for batch in batches:
            for names, df, rows, tf in zip(*(batch.column(i).to_pylist() for i in range(4))):
                df, idf, x = _weighted(df, tf, sublinear, n)
                w = np.add.reduceat(x * u[np.frombuffer(rows, "<i4")], np.cumsum(df) - df)
                yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "idf": pa.array(idf), "coef": pa.array(w)})

    return cut_lineage(blocks.mapInArrow(coefficients, "term string, idf double, coef double")), intercept


def term_vectors(terms, model: DataFrame, sublinear: bool, unit: bool) -> DataFrame:
    """(keys, term, weight, coef) of the model's terms."""
    raw = (1 + F.ln("tf")) * F.col("idf") if sublinear else F.col("tf")
    x = terms.counts.join(model, "term").withColumn("weight", raw)
    if unit:
        norm = x.groupBy(*terms.keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
        x = x.join(norm, terms.keys).withColumn("weight", F.col("weight") / F.col("_norm"))
    return x.select(*terms.keys, "term", "weight", "coef")


def term_margins(terms, model: DataFrame, sublinear: bool, unit: bool) -> DataFrame:
    """(keys, margin) of all texts that are not empty, without the intercept."""
    raw = (1 + F.ln("tf")) * F.col("idf") if sublinear else F.col("tf")
    x = terms.counts.join(model, "term").select(*terms.keys, "coef", raw.alias("_x"))
    size = F.sqrt(F.sum(F.col("_x") * F.col("_x"))) if unit else F.lit(1.0)
    z = x.groupBy(*terms.keys).agg((F.sum(F.col("_x") * F.col("coef")) / size).alias("margin"))
    return terms.held.join(z, terms.keys, "left").select(*terms.keys, F.coalesce("margin", F.lit(0.0)).alias("margin"))
