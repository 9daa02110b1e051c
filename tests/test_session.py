"""The folder for intermediates."""

import os

from pyspark.sql import functions as F

from cutline.operators.textblock import novelty
from cutline.session import CLEANUP, cut_lineage, drop_written, shared_dir


def test_intermediates_go_to_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert named is None or folder == named.rstrip("/")
    x = cut_lineage(spark.range(10).selectExpr("id", "id * 2 AS twice"))
    assert x.agg({"twice": "sum"}).first()[0] == 90 and all(folder.removeprefix("file:") in f for f in x.inputFiles())


def test_a_cut_leaves_no_shuffle_files_and_can_be_dropped(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before, kept = files(), spark.conf.get(CLEANUP, None)
    out = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    assert files() <= before and out.where("count = 100").count() == 100
    assert spark.conf.get(CLEANUP, None) == kept
    drop_written(out)
    assert not os.path.exists(out.written_at.removeprefix("file:"))


def test_novelty_leaves_one_table(spark):
    """The vectors and the rounds' bounds are gone when the result is there."""
    rows = [("A", w, f"k{w}-{i}", f"word{'abcdefgh'[i]} day{'abcdefgh'[w]}") for w in range(6) for i in range(6)]
    reps = spark.createDataFrame(rows, "symbol string, widx int, ckey string, title string")
    folder = os.path.dirname(cut_lineage(spark.range(1)).written_at.removeprefix("file:"))
    before = set(os.listdir(folder))
    out = novelty(reps, window=3)
    assert set(os.listdir(folder)) - before == {os.path.basename(out.written_at)} and out.count() == 6
