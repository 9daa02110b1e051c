"""Mix sources to target weights by weighted fair queueing, in DataFrame operations only."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

EPOCHS = 3
BUCKET_ROWS = 4096  # rows of one bucket of the shuffled order, about


def cycle_weights(rank: Column) -> Column:
    """Weights 1, 2, 3 repeating over the rank of the source (from 0)."""
    return (rank % 3 + 1).cast("double")


def source_targets(sizes: DataFrame, weight=cycle_weights, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """(sid, source, source_size, weight, target): what each source may give of ``share`` of all sizes.

    Sources stand by code point, null last. A target stops at ``epochs`` times its source's size; the excess goes to the
    others by weight until none is above. In virtual time t a source has given least(weight * t, epochs * size); the
    sources in order of the time they run dry give the t at which all of them together reach the budget.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = per_source.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", weight(F.col("sid")))
    dry = (ranked.withColumn("full", (F.col("source_size") * epochs).cast("double")).withColumn("dry_at", F.col("full") / F.col("weight")))
    order = W.orderBy("dry_at", "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    since = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    timed = (dry.withColumn("budget", F.floor(F.sum("source_size").over(everything) * F.lit(share)))
             .withColumn("t", (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(since))
             .withColumn("t", F.min(F.when(F.col("t") <= F.col("dry_at"), F.struct("dry_at", "sid", "t"))).over(everything)["t"]))
    return timed.select("sid", "source", "source_size", "weight", "budget",
                        F.least(F.col("weight") * F.coalesce("t", "dry_at"), F.col("full")).alias("target"))


def _running(rows: DataFrame, by: list[str], order: list[str], value: str, bucket: str, name: str) -> DataFrame:
    """Running sum of ``value`` within ``by``, in the given order whose coarse form is ``bucket``: sums per bucket first,
    then their prefix, then a window inside one bucket, so that no key is ever sorted in one task."""
    sums = rows.groupBy(*by, bucket).agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, bucket, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(starts, [*by, bucket]).withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_before")


def mix(docs: DataFrame, weight=cycle_weights, epochs: int = EPOCHS, share: float = 1.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """How many of its words the mix takes from every document: doc_id, source, size, source_size, target, repeats, taken.

    Documents of a source are shuffled by the MD5 of their doc_id and stream ``epochs`` times. A document's virtual
    finish time is its source's words so far divided by the source's weight. Over all sources the finish times are
    brought in order by ranges and cut at the budget (``share`` of all words); what would pass it is left out.

    Null texts have size 0 and like empty ones are never taken (repeats 0). A null source is a source, the last in order; a null
    doc_id is shuffled like an empty one. Repeated rows count one by one. Reruns agree. An empty table gives an empty
    result. Other columns are not read.
    """
    sizes = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("rid"))
    sizes = written(sizes, "sizes")
    targets = written(source_targets(sizes, weight, epochs, share), "targets")
    totals = targets.agg(F.max("budget").alias("budget"), F.max(F.col("source_size") * epochs / F.col("weight")).alias("last")).first()
    out = lambda rows: rows.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    named = targets.select("sid", F.col("source").alias("_source"), "source_size", "weight", "target")
    keyed = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    if not totals.budget:
        return out(keyed.withColumn("repeats", F.lit(0).cast("long")))
    buckets = max(1, sizes.count() // bucket_rows)
    spread = keyed.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) * buckets))
    finish = [(F.col("upto") + F.col("source_size") * e) / F.col("weight") for e in range(epochs)]
    ranges = min(buckets, 1 << 16)
    place = lambda f: F.floor(f / F.lit(totals["last"]) * ranges)
    run = written(_running(spread, ["sid"], ["h", "size", "rid"], "size", "bucket", "upto").withColumn("finish", F.array(*finish)), "running")
    passes = run.where("size > 0").select("rid", "sid", "h", "size", F.explode("finish").alias("finish")).withColumn("range", place(F.col("finish")))
    # at most 65,536 sums; the range in which the budget ends is the only one whose rows are sorted
    sums = passes.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(W.orderBy("range")))
    cut = sums.where(F.col("upto") > totals.budget).agg(F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("c")).first()["c"]
    last, before = (cut["range"], cut["before"]) if cut else (ranges + 1, 0)
    edge = (passes.where(F.col("range") == last).withColumn("upto", F.sum("size").over(W.orderBy("finish", "sid", "h", "size", "rid").rowsBetween(W.unboundedPreceding, 0)))
            .where(F.col("upto") + before <= totals.budget).groupBy("rid").agg(F.count("*").alias("more")))
    whole = sum((F.when((F.col("size") > 0) & (place(F.col("finish")[e]) < last), 1).otherwise(0) for e in range(epochs)), F.lit(0).cast("long"))
    return out(run.join(edge, "rid", "left").withColumn("repeats", whole + F.coalesce("more", F.lit(0))))


#: The same mix in DuckDB over ``documents``.
MIX_SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {documents}),
r AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM s GROUP BY source),
w AS (SELECT *, CAST(sid % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS full_size, source_size * 3 / CAST(sid % 3 + 1 AS DOUBLE) AS dry_at FROM r),
b AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
    (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(full_size) OVER (ORDER BY dry_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY dry_at, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM w),
g AS (SELECT b.*, least(weight * coalesce((SELECT arg_min(x.t, x.dry_at * 1e6 + x.sid) FROM b x WHERE x.t <= x.dry_at), dry_at), full_size) AS target FROM b),
k AS (SELECT s.*, g.sid, g.source_size, g.weight, g.target, g.budget,
    CAST(sum(size) OVER (PARTITION BY g.sid ORDER BY h, size, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
p AS (SELECT k.*, (upto + source_size * e.e) / weight AS finish FROM k, (VALUES (0), (1), (2)) e(e) WHERE size > 0),
o AS (SELECT doc_id, CAST(sum(size) OVER (ORDER BY finish, sid, h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) <= budget AS taken FROM p),
n AS (SELECT doc_id, count(*) FILTER (taken) AS repeats FROM o GROUP BY doc_id)
SELECT k.doc_id, k.size, k.source_size, k.target, CAST(k.size * coalesce(n.repeats, 0) AS BIGINT) AS taken, k.source
FROM k LEFT JOIN n USING (doc_id)
"""
