"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

SAMPLE = 20_000        # labelled rows that the model is fitted on, at most
LEXICON = 300          # words learned from them, at most
SUPPORT = 4            # labelled texts that a learned word must occur in
NEAR = 5               # words between an insult and a second person
BINS = 10_000          # the trees' probability in so many steps, for the calibration

#: Insults known beforehand and second persons (fixed values).
INSULTS = ("idiot idiots stupid dumb moron morons imbecile loser losers scum trash garbage filth worthless pathetic disgusting vile clown fool jerk "
           "bastard bitch whore slut asshole dick prick cunt shit crap fuck fucking fucker motherfucker damn hate kill die shut ugly "
           "arschloch scheisse scheiße dumm idioten trottel depp hure wichser abschaum dreck "
           "connard connasse salope merde putain con imbécile ordure crétin débile "
           "imbécil estúpido estúpida idiota puta puto mierda basura cabrón gilipollas pendejo").split()
SECOND_PERSON = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

NAMES = ("words hits hit_rate distinct_hits weight weight_rate top_weight near_second second_rate insult_rate caps_rate caps_words exclaims questions "
         "punctuation digits symbols obfuscated leet_hits spelled_out letters mean_word").split()
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[A-Za-z]+[0-9@$!|*#]+[A-Za-z]+")
_SPELLED = re.compile(r"(?:\b[A-Za-z][ .\-*]){3,}[A-Za-z]\b")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The values of NAMES for one whole text. ``lexicon`` has the weight of every learned word."""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = len(words) or 1
    at = [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in at]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON] if at else []
    near = 0
    if second:
        s = np.array(second)
        for i in at:
            k = int(np.searchsorted(s, i))
            near += min(abs(int(s[j]) - i) for j in (k - 1, k) if 0 <= j < len(s)) <= NEAR
    kinds = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(int(kinds.sum()), 1)
    upper, letters = int(kinds[65:91].sum()), int(kinds[65:91].sum() + kinds[97:123].sum())
    mixed = _MIXED.findall(text)
    leet = sum(m.lower().translate(LEET) in lexicon for m in mixed)
    marks = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    total = sum(weights)
    return [float(np.log1p(len(words))), float(len(at)), len(at) / n, float(len(set(words[i] for i in at))), total, total / n, max(weights, default=0.0),
            near / max(len(at), 1), len(second) / n, sum(w in _INSULTS for w in words) / n, upper / max(letters, 1), len(_CAPS.findall(text)) / n,
            int(kinds[33]) / size, int(kinds[63]) / size, marks / size, int(kinds[48:58].sum()) / size,
            int(kinds[35:39].sum() + kinds[42] + kinds[64]) / size, len(mixed) / n, float(leet), len(_SPELLED.findall(text)) / n, letters / size, len(lower) / n]


_INSULTS = frozenset(INSULTS)


def feature_table(docs: DataFrame, lexicon: dict[str, float], *columns: str) -> DataFrame:
    """The named columns and ``x``, the features as an array."""
    def run(batches):
        for batch in batches:
            rows = [features(t.decode() if t else "", lexicon) for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*columns, "x"])
    return texts_of(docs, *columns).mapInArrow(run, docs.select(*columns, F.lit(None).cast("array<double>").alias("x")).schema)


@dataclass
class ToxicityModel:
    """Trees and calibration, or where training saw one class only its constant score."""

    lexicon: dict[str, float]
    constant: float | None = None
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None


def learn_lexicon(sample: DataFrame, most: int = LEXICON, support: int = SUPPORT) -> dict[str, float]:
    """Words that occur in labelled texts of label 1 more often than chance, with their log odds; the known insults weigh 1 at least."""
    words = (sample.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))).alias("word"))
             .groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("n")))
    bad, n = sample.agg(F.sum("label"), F.count("*")).first()
    rest, toxic = max(n - bad, 1), max(bad, 1)
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (rest + 1))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    found = words.where(F.col("bad") >= support).withColumn("odds", odds).withColumn("z", odds / spread).where((F.col("z") > 4) & (F.col("odds") > 1))
    learned = {r["word"]: float(r["odds"]) for r in found.orderBy(F.desc("z"), "word").limit(most).collect()}
    return {**{w: 1.0 for w in INSULTS}, **learned}


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 17) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents, those whose doc_id has the smallest hash.

    ``labels`` has doc_id and toxic; a doc_id labelled more than once counts by its mean, rows without doc_id or label are left
    out. Two thirds of the sample grow the lexicon and the trees, one third calibrates them.
    """
    once = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    chosen = once.withColumn("h", F.xxhash64("doc_id", F.lit("toxicity"))).orderBy("h", "doc_id").limit(sample)
    rows = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("grow", F.pmod("h", F.lit(3)) != 0), "labelled")
    seen = {r["label"]: r["n"] for r in rows.where("grow").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return ToxicityModel({w: 1.0 for w in INSULTS}, float(next(iter(seen), 0)))
    lexicon = learn_lexicon(rows.where("grow"))
    table = written(feature_table(rows, lexicon, "doc_id", "label", "grow").select("label", "grow", array_to_vector("x").alias("features")).repartition(4), "features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, seed=seed).fit(table.where("grow"))
    raw = _raw(trees.transform(table.where("NOT grow"))).select("raw", F.col("label").cast("double").alias("label"))
    if raw.agg(F.countDistinct("label")).first()[0] < 2:
        return ToxicityModel(lexicon, None, trees)
    return ToxicityModel(lexicon, None, trees, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw))


def _raw(scored: DataFrame) -> DataFrame:
    return scored.withColumn("raw", F.round(vector_to_array("probability")[1] * BINS) / BINS)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score): calibrated probability of label 1 for every whole text, from the text alone.

    Null and empty texts have the features of the empty text. Repeated rows stay; a null doc_id is kept; an empty table gives an
    empty result. Other columns are not read.
    """
    if model.constant is not None:
        return docs.select("doc_id", F.lit(model.constant).alias("score"))
    scored = _raw(model.trees.transform(feature_table(docs, model.lexicon, "doc_id").select("doc_id", array_to_vector("x").alias("features")))).select("doc_id", "raw")
    if model.curve is None:
        return scored.select("doc_id", F.col("raw").alias("score"))
    return model.curve.setPredictionCol("score").transform(scored).select("doc_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
