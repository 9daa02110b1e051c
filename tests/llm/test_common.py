"""Written tables and components."""

import os

from pyspark.sql import functions as F

import cutline.llm.common as C


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, kept = shuffle_files(spark), spark.conf.get(C.CLEANUP, None)
    out = C.written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert shuffle_files(spark) <= before and out.where("count = 100").count() == 100
    assert spark.conf.get(C.CLEANUP, None) == kept


def test_a_dense_group_is_a_few_links(spark, monkeypatch):
    rows, real = {}, C.written

    def counted(df, name):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(C, "written", counted)
    pairs = [(a, b) for a in range(300) for b in range(a + 1, 300)] + [(400, 401), (402, 401), (500, 500)]
    got = C.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(300), 0), 400: 400, 401: 400, 402: 400}
    assert rows["links"] < 20 * 300, rows  # of 44,850 pairs
