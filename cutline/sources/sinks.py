"""Writers, reuse of heavy intermediates, saved fitted rules."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_parquet(df: DataFrame, path: str, by=()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Report tables only; ``single_file`` is for results of report size."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def reuse(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """Build once to parquet, read it afterwards."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if rebuild or not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_rule(spark: SparkSession, state: dict, path: str) -> None:
    """Learned numbers and the spec as a one-row table; no classes."""
    spark.createDataFrame([(1, json.dumps(state, sort_keys=True))], "format int, state string") \
        .write.mode("overwrite").parquet(path)


def load_rule(spark: SparkSession, path: str) -> dict:
    row = spark.read.parquet(path).where(F.col("format") == 1).first()
    if row is None:
        raise ValueError(f"{path}: unknown format")
    return json.loads(row["state"])
