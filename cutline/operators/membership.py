"""A membership test inside the row: which words of an array may be in a word table, before anything is exploded."""

from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 16  # the filter has this size whatever the table; more words only let more others pass


def _slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BITS - 1))


def word_filter(words: DataFrame, col: str) -> Column:
    """The filter of a table's words as a scalar column: BITS / 64 longs, from one aggregate with map-side combine."""
    slot = words.select(_slot(F.col(col)).alias("s")).where("s IS NOT NULL")
    cells = slot.groupBy(F.floor(F.col("s") / 64).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s % 64 AS INT))")).alias("bits"))
    known = F.map_from_entries(F.collect_list(F.struct("cell", "bits")))
    return cells.agg(F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0).cast("long"))).alias("filter")).scalar()


def may_be_in(word: Column, held: Column) -> Column:
    """False only for words that are not in the filter's table."""
    slot = _slot(word)
    return F.getbit(F.get(held, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1
