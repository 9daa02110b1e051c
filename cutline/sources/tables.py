"""Point-in-time scans and catalog helpers."""

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..fixed import RET_CUTS
from ..functions.scalars import grade, hash_int

DAILY_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("date_et", T.TimestampNTZType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "prev_close", "ret")],
    T.StructField("known_at", T.TimestampNTZType())])
NEWS_LIGHT = ["known_at", "symbols", "source", "url", "title", "tone", "positive", "negative"]


def symbol_filter(df: DataFrame, symbols) -> DataFrame:
    """Keep wanted symbols; on comma-joined tags keep the row if any tag is wanted."""
    if symbols is None:
        return df
    if isinstance(symbols, DataFrame):
        want = symbols.select(F.col(symbols.columns[0]).alias("_want")).distinct()
        if "symbol" in df.columns:
            return df.join(want, df["symbol"] == want["_want"], "left_semi")
        # every distinct tag list is judged once; rows then meet the lists that name a wanted symbol
        lists = df.select("symbols").distinct()
        hit = lists.select("symbols", F.explode(F.split(F.coalesce("symbols", F.lit("")), ",")).alias("_tag"))
        hit = hit.join(want, hit["_tag"] == want["_want"], "left_semi").select("symbols").distinct()
        return df.join(hit, "symbols", "left_semi").select(df.columns)
    symbols = [symbols] if isinstance(symbols, str) else sorted(symbols)
    if "symbol" in df.columns:
        return df.where(F.col("symbol").isin(*symbols))
    return df.where(F.arrays_overlap(F.split(F.coalesce("symbols", F.lit("")), ","),
                                     F.array(*[F.lit(s) for s in symbols])))


def asof(df: DataFrame, since=None, until=None, symbols=None, columns=None, clock: str = "known_at") -> DataFrame:
    """Rows knowable in [since, until). Bounds are TIMESTAMP_NTZ so the filter reaches parquet."""
    t = F.col(clock)
    if since is not None:
        df = df.where(t >= (since if not isinstance(since, str) else F.lit(since).cast("timestamp_ntz")))
    if until is not None:
        df = df.where(t < (until if not isinstance(until, str) else F.lit(until).cast("timestamp_ntz")))
    df = symbol_filter(df, symbols)
    if columns is not None:
        tag = [c for c in ("symbols", "symbol") if symbols is not None and c in df.columns]
        df = df.select(*dict.fromkeys([c for c in [*columns, clock, *tag] if c in df.columns]))
    return df


def news_view(df: DataFrame, since=None, until=None, symbols=None, with_text=False, columns=None) -> DataFrame:
    cols = columns or (None if with_text else [c for c in NEWS_LIGHT if c in df.columns])
    return asof(df, since, until, symbols, cols)


def day_bundle(tables: dict, base, cutoff, since, symbols=None, with_text=False, forums=None) -> dict:
    """Every table cut for one decision moment, defined lazily."""
    out = {}
    for name, df in tables.items():
        if name == "news":
            out[name] = news_view(df, since, cutoff, symbols, with_text)
        elif name == "forum":
            for sub in forums or []:
                out[f"forum:{sub}"] = asof(df.where(F.col("sub") == sub), since, cutoff, clock="created_et")
        else:
            out[name] = asof(df, since, cutoff, symbols)
    return out


def forum_scan(spark: SparkSession, folder: str, kind: str = "comments", since=None, until=None) -> DataFrame:
    """``<folder>/<sub>.<kind>.parquet`` files as one table with sub and kind columns.

    Only text and creation time are read; later-known columns such as scores stay out.
    """
    def one(k):
        df = spark.read.parquet(os.path.join(folder, f"*.{k}.parquet"))
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.(posts|comments)\.parquet", 1)
        cols = [c for c in ("created_et", "title", "body") if c in df.columns]
        return df.select(*cols, name.alias("sub"), F.lit(k).alias("kind"))

    df = one(kind) if kind != "both" else one("posts").unionByName(one("comments"), allowMissingColumns=True)
    return asof(df, since, until, clock="created_et")


def forum_names(spark: SparkSession, folder: str) -> DataFrame:
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    return paths.select(F.regexp_extract("path", r"([^/]+?)\.[^/]*$", 1).alias("sub")).distinct()


def universe(spark: SparkSession, labels: DataFrame, explicit=None, json_path: str | None = None) -> DataFrame:
    """Symbols: explicit list, else a JSON file (list or map of lists), else the data's own."""
    if explicit is not None:
        return spark.createDataFrame([(s,) for s in sorted(explicit)], "symbol string")
    if json_path is not None:
        text = spark.read.text(json_path, wholetext=True)
        lists = F.coalesce(F.from_json("value", "array<string>"),
                           F.flatten(F.map_values(F.from_json("value", "map<string,array<string>>"))))
        return text.select(F.explode(lists).alias("symbol")).distinct()
    return labels.select("symbol").distinct()


def label_table(daily: DataFrame, cuts=RET_CUTS, since=None, until=None) -> DataFrame:
    out = (daily.where(F.col("ret").isNotNull())
           .select("symbol", F.col("date_et").alias("date"), "prev_close", "close",
                   (F.col("ret") * 100).alias("ret_pct"))
           .withColumn("label", grade("ret_pct", cuts)))
    if since is not None:
        out = out.where(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        out = out.where(F.col("date") < F.lit(until).cast("date"))
    return out


def lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Word list CSV -> (category, WORD); a word is in a category when its column is > 0."""
    df = spark.read.csv(path, header=True)
    low = {c.lower(): c for c in df.columns}
    cats = [c for c in ("positive", "negative", "uncertainty") if c in low]
    word = F.upper(F.trim(F.col(low["word"])))
    return (df.select(word.alias("word"), *[F.col(low[c]).cast("double").alias(c) for c in cats])
            .unpivot(["word"], cats, "category", "value").where(F.col("value") > 0)
            .select("category", "word"))


def alias_json(spark: SparkSession, path: str) -> DataFrame:
    """{"TICKER": ["name", ...]} -> (symbol, name); keys starting with _ are notes."""
    text = spark.read.text(path, wholetext=True)
    return (text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("symbol", "names"))
            .where(~F.col("symbol").startswith("_"))
            .select("symbol", F.explode("names").alias("name")))


def check_scores(df: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """External scores contract as data: rows, rows whose probabilities do not sum to one."""
    need = {"title_id", "p_pos", "p_neg", "p_neu"} - set(df.columns)
    if need:
        raise ValueError(f"scores lack columns {sorted(need)}")
    off = F.abs(F.col("p_pos") + F.col("p_neg") + F.col("p_neu") - 1)
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(off).alias("max_off"),
                  F.count_if(off > tolerance).alias("violations"))


def representative_titles(reps: DataFrame) -> DataFrame:
    """Distinct (title_id, title) to be scored elsewhere."""
    return reps.groupBy("title_id").agg(F.min("title").alias("title"))


def pending_inputs(wanted: DataFrame, done: DataFrame, cols) -> DataFrame:
    """Inputs without a cached result, keyed by the hash of their JSON form."""
    key = lambda df: df.withColumn("input_key", F.sha2(F.to_json(F.struct(*cols)), 256))
    return key(wanted).join(key(done).select("input_key").distinct(), "input_key", "left_anti")


def hash_sample(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """n rows in hash order: a seeded random subset that does not depend on partitioning."""
    return df.orderBy(hash_int(seed, key), key).limit(n)
