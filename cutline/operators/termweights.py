"""Text vectorisers as (id, term, weight) rows: no vocabulary on the driver."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..fixed import NEGATORS, STOPWORDS
from ..functions.scalars import hash_int
from ..functions.text import padded_words, vector_tokens, word_ngrams

HASH_SPACE = 1 << 18
NAMES = ("count_uni", "tfidf_uni", "tfidf_bi", "tfidf_char", "tfidf_stop", "tfidf_df", "lm_vocab", "hashing")


def with_pairs(toks, before=None):
    """The tokens and each pair of neighbours; ``before`` is the token that comes ahead of the first, if any."""
    row = toks if before is None else F.concat(F.when(before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<string>")), toks)
    pairs = F.zip_with(row, F.slice(row, F.lit(2), F.size(row)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(toks, F.filter(pairs, lambda p: p.isNotNull()))


def term_list(text: str, name: str):
    """The terms of a text for the named vectoriser, repeats included."""
    toks = vector_tokens(text)
    if name == "tfidf_stop":
        stop = [w for w in STOPWORDS if w not in NEGATORS]
        toks = F.filter(toks, lambda t: ~t.isin(*stop))
    return with_pairs(toks) if name == "tfidf_bi" else toks


@dataclass
class Terms:
    """Counted terms of keyed texts: ``held`` has the keys of the texts that are not empty, ``counts`` (keys, term, tf) their terms."""
    keys: list
    held: DataFrame
    counts: DataFrame


def _counted(lists: DataFrame, keys, name: str, vocabulary=None) -> DataFrame:
    """(keys, term, tf) of ``_t``, the words of a text for tfidf_char and its terms otherwise; the rows of a key lie in one partition."""
    keys = list(keys)
    each = lists.select(*keys, F.explode("_t").alias("_w"))
    if name == "tfidf_char":
        # count words first: their n-grams are then made once per distinct word of the text
        words = each.groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_c"))
        return (words.select(*keys, "_c", F.explode(word_ngrams(F.col("_w"))).alias("term"))
                .groupBy(*keys, "term").agg(F.sum("_c").cast("double").alias("tf")))
    tf = each.groupBy(*keys, F.col("_w").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("tf"))
    if name == "hashing":
        return tf.groupBy(*keys, F.pmod(hash_int("term"), F.lit(HASH_SPACE)).cast("string").alias("term")).agg(F.sum("tf").alias("tf"))
    if name == "lm_vocab":
        words = vocabulary.select(F.lower("word").alias("term")).distinct()
        return tf.join(words, "term", "left_semi").select(*keys, "term", "tf")
    return tf


def text_terms(docs: DataFrame, keys, text: str, name: str, vocabulary: DataFrame | None = None) -> Terms:
    """The terms of one text a row."""
    keys = list(keys)
    # texts travel once, to the task of their key: counting their terms and adding up their weights then needs no shuffle of terms by key
    docs = docs.select(*keys, text).repartition(*[F.col(k) for k in keys])
    lists = docs.withColumn("_t", padded_words(text) if name == "tfidf_char" else term_list(text, name))
    return Terms(keys, docs.where(F.length(text) > 0).select(*keys), _counted(lists, keys, name, vocabulary))


def title_terms(reps: DataFrame, name: str, vocabulary: DataFrame | None = None, keys=("symbol", "target"), order=("known_at", "ckey"), title: str = "title") -> Terms:
    """The terms of each key's titles, as its ``joined_titles`` have them, without joining: a separator counts as a word of tfidf_char, and
    the last token of a title makes a pair with the first one after it."""
    keys = list(keys)
    t = reps.select(*keys, *order, title).repartition(*[F.col(k) for k in keys])
    w = W.partitionBy(*keys).orderBy(*order, title)
    if name == "tfidf_char":
        bar = F.when(F.row_number().over(w) > 1, F.array(F.lit(" || "))).otherwise(F.array().cast("array<string>"))
        lists = t.withColumn("_bar", bar).withColumn("_t", F.concat("_bar", padded_words(title)))
    elif name == "tfidf_bi":
        lists = t.withColumn("_w", vector_tokens(title)).withColumn("_end", F.try_element_at("_w", F.lit(-1)))
        lists = lists.withColumn("_before", F.last("_end", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
        lists = lists.withColumn("_t", with_pairs(F.col("_w"), F.col("_before")))
    else:
        lists = t.withColumn("_t", term_list(title, name))
    held = reps.groupBy(*keys).agg((F.sum(F.length(title)) + F.count(F.lit(1)) - 1).alias("_n")).where("_n > 0").select(*keys)
    return Terms(keys, held, _counted(lists, keys, name, vocabulary))


def document_limits(name: str, min_df, max_df):
    """The narrower limits of tfidf_df take the place of the general defaults."""
    if name != "tfidf_df":
        return min_df, max_df
    return (20 if min_df == 5 else min_df), (0.5 if max_df == 1.0 else max_df)


def term_weights(docs: DataFrame, id_col: str, text: str, name: str, min_df=5, max_df=1.0,
                 vocabulary: DataFrame | None = None) -> DataFrame:
    """Weights of the named vectoriser. min_df/max_df are counts when int, shares when float."""
    if name not in NAMES:
        raise ValueError(f"vectoriser '{name}' unknown; choose from {NAMES}")
    min_df, max_df = document_limits(name, min_df, max_df)
    tf = text_terms(docs, [id_col], text, name, vocabulary).counts
    if name == "hashing":
        return _unit_length(tf.withColumn("weight", F.col("tf")), id_col)
    if name == "lm_vocab":
        return tf.select(id_col, "term", F.col("tf").alias("weight"))
    n = docs.agg(F.count(F.lit(1))).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("_n", n)
    low = F.lit(min_df) if isinstance(min_df, int) else F.lit(min_df) * F.col("_n")
    top = F.lit(max_df) if isinstance(max_df, int) else F.lit(max_df) * F.col("_n")
    df = df.where((F.col("df") >= low) & (F.col("df") <= top))
    # the kept terms are few beside the counts: each task hashes its share of them and leaves its counts unsorted. Counts travel back to
    # their text, not weights, which hardly compress.
    x = tf.join(df.hint("shuffle_hash"), "term").repartition(F.col(id_col))
    if name == "count_uni":
        return x.select(id_col, "term", F.col("tf").alias("weight"))
    idf = F.ln((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    return _unit_length(x.withColumn("weight", (1 + F.ln("tf")) * idf), id_col)


def _unit_length(x: DataFrame, id_col: str) -> DataFrame:
    """Weights scaled by the length of their text's vector; a frame over the text, so that the weights are worked once."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy(id_col)))
    return x.select(id_col, "term", (F.col("weight") / norm).alias("weight"))
