"""Session settings and the lineage cut used by iterative jobs."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_private: dict[str, str] = {}


def get_spark(app: str = "cutline", cpus: str = "*") -> SparkSession:
    """A session with the settings the library expects. Partition counts and memory are set for local masters only; on a cluster
    they are the cluster's."""
    master = os.environ.get("CUTLINE_MASTER", f"local[{cpus}]")
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master.startswith("local"):
        builder = (builder.config("spark.sql.shuffle.partitions", "8")
                   .config("spark.driver.memory", os.environ.get("CUTLINE_DRIVER_MEMORY", "8g")))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir``. Only a local session that names none (tests) gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _private:
        _private[app] = tempfile.mkdtemp(prefix="cutline-shared-")
    return _private[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cutline-{spark.sparkContext.applicationId}"


#: Shuffle files go when their query has ended, not when the driver's garbage collector meets them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder, and read from there: computed once, lost executors cost nothing, later
    reads take only the columns they need, and the planner knows the size from the files. The shuffles that made them are removed with the query."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_folder(spark: SparkSession) -> None:
    """Let iterative learners cut their lineage in the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_own_folder(spark))


def drop_intermediates(spark: SparkSession) -> None:
    """Remove what ``cut_lineage`` wrote in this application; call it when no returned DataFrame is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, columns: dict) -> DataFrame:
    """A caller's small dictionary or list as a local relation of known size."""
    import pyarrow as pa
    return spark.createDataFrame(pa.table(columns))
