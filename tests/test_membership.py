"""The in-row filter never loses a word of its table."""

from pyspark.sql import functions as F

from cutline.operators.membership import BITS, may_be_in, word_filter


def test_words_of_the_table_pass_and_most_others_do_not(spark):
    table = spark.createDataFrame([(f"w{i}",) for i in range(3000)] + [(None,), ("",), ("é",)], "word string")
    asked = spark.createDataFrame([(f"w{i}",) for i in range(6000)] + [("",), ("é",)], "word string").repartition(3)
    got = asked.withColumn("held", word_filter(table, "word")).select("word", may_be_in(F.col("word"), F.col("held")).alias("in"), F.size("held").alias("n")).collect()
    known = {f"w{i}" for i in range(3000)} | {"", "é"}
    assert all(r["in"] for r in got if r.word in known) and {r.n for r in got} == {BITS // 64}
    assert sum(r["in"] for r in got if r.word not in known) < 300


def test_an_empty_table_lets_nothing_pass(spark):
    x = spark.createDataFrame([("a",)], "word string")
    assert not x.withColumn("held", word_filter(x.where("false"), "word")).select(may_be_in(F.col("word"), F.col("held"))).first()[0]
