"""The thin queries of the operators and, where SQL can express them, their DuckDB twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contamination import CONTAMINATION_SQL, contamination
from .mixing import MIX_SQL, mix

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op7_simhash")
def op7(spark, sf_dir):
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10(spark, sf_dir):
    from .substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_mixing", MIX_SQL.format(documents="documents"))
def op6(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op5_sharding")
def op5(spark, sf_dir):
    from .sharding import shard
    return shard(table(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                                               F.lit(None).cast("int").alias("grown_shard"))


@query("op4_packing")
def op4(spark, sf_dir):
    import public_tokenizers

    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), vocabulary=public_tokenizers.path("byte_bpe_50k.json"))


def fold(modulus: int):
    """crc32 of doc_id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op3_language_id")
def op3(spark, sf_dir):
    from .langid import fit_languages, identify
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(fold(3) != 1))
    return (identify(docs.select("doc_id", "text"), model)
            .select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")))


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    from .ngrams import score, train
    docs = table(spark, sf_dir, "documents")
    trie = train(docs.where(fold(7) != 2))
    return score(docs, trie).select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op8_audio_features")
def op8(spark, sf_dir):
    from .audio import features, store
    rows = features(store(table(spark, sf_dir, "documents")))
    voiced = F.aggregate("spans", F.lit(0.0), lambda s, x: s + x["end"] - x["begin"])
    mean = F.concat_ws(",", F.transform("mel_mean", lambda v: F.format_number(v, 2)))
    tensor = F.md5(F.concat_ws(",", F.transform(F.flatten("tensors"), lambda v: F.round(v.cast("double"), 2).cast("string"))))
    digest = F.concat_ws(";", F.concat(F.lit("frames="), "frames"), F.concat(F.lit("spans="), F.size("spans")), F.concat(F.lit("voiced="), F.format_number(voiced, 3)),
                         F.concat(F.lit("mel="), mean), F.concat(F.lit("tensors="), tensor))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", digest.alias("feature"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    from .toxicity import fit_toxicity, score_toxicity
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(fold(4) != 2))
    return score_toxicity(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_embedding_dedup")
def op1(spark, sf_dir):
    from .covertree import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_benchmark_decontamination", CONTAMINATION_SQL.format(documents="documents", benchmark="benchmark"))
def op12(spark, sf_dir):
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op13_token_alignment")
def op13(spark, sf_dir):
    import public_tokenizers

    from .alignment import align
    rows = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    from .variants import variant_groups
    return variant_groups(table(spark, sf_dir, "documents"), drop_every=199)
