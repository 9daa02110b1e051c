"""Shared helpers: written intermediates, batched text access, local union, components over tables."""

import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = 1 << 18  # links whose spanning forest a task makes at once
WORD = r"[^\x20\x09-\x0D]+"
_private: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Only a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _private:
        _private[app] = tempfile.mkdtemp(prefix="cutline-llm-")
    return _private[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


#: Shuffle files go when their query has ended, not when the driver's garbage collector meets them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, keeps column pruning, survives lost executors. The shuffles
    that made them are removed with the query."""
    path = new_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what was made from them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.written_at).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def local_path(uri: str) -> str:
    """A path that open() takes, for a folder mounted on every machine."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parts.path


def make_dirs(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns and the text as UTF-8 bytes, so that other columns never clash."""
    return docs.select(*columns, F.col("text").cast("binary").alias("text"))


def slices(batch: pa.RecordBatch, size: int, *columns: int):
    """Parts of a batch whose named binary columns hold about ``size`` bytes together; one row at least."""
    held = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        held += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy()
    held, at = np.cumsum(held), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def lower_ascii(data: bytes) -> bytes:
    return data.lower()  # bytes.lower() changes A-Z only


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Union the pairs (u, v) in place: every entry ends at the smallest index of its class."""
    while u.size:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def forest(links: DataFrame) -> DataFrame:
    """Links (u, v) with the same components: of each EDGES links of a task only a spanning forest stays."""
    def run(batches):
        held, n = [], 0

        def done():
            u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = np.arange(nodes.size)
            merge_labels(label, at[:u.size], at[u.size:])
            moved = np.nonzero(label != np.arange(label.size))[0]
            return pa.RecordBatch.from_arrays([pa.array(nodes[label[moved]]), pa.array(nodes[moved])], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > EDGES:
                yield done()
                held, n = [], 0
        if n:
            yield done()
    return links.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of an edge list as rows (node, component), component being the smallest node.

    Labels travel along edges and are then followed to their own labels, so chains shorten by half
    each round. Each round is a few equality joins on written tables, which the planner may split
    where a node has very many edges. Nodes without edges are not returned.
    """
    links = forest(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v"))
    links = written(links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*").distinct(), "links")
    labels = written(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        before = labels
        heard = (links.join(labels.select("u", "label"), "u").groupBy("v").agg(F.min("label").alias("heard"))
                 .withColumnRenamed("v", "u"))
        hooked = written(labels.select("u", "label").join(heard, "u").select("u", F.col("label").alias("was"), F.least("label", "heard").alias("label")), "hooked")
        target = hooked.select(F.col("u").alias("label"), F.col("label").alias("beyond"))
        labels = written(hooked.join(target, "label").select("u", F.least("label", "beyond").alias("label"),
                                                            (F.least("label", "beyond") < F.col("was")).alias("moved")), "labels")
        drop_written(before, hooked)
        if not labels.where("moved").limit(1).count():
            drop_written(links)
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
