"""Dense vector columns: group means and centred projections."""

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F


def mean_vector(df: DataFrame, keys, array: str) -> DataFrame:
    x = df.withColumn("_v", array_to_vector(F.transform(array, lambda e: e.cast("double"))))
    return x.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean"), F.count(F.lit(1)).alias("n"))


def fit_projection(train: DataFrame, array: str, k: int):
    """Principal components of the training rows. The scaler only centres: the projection of a row is
    taken after subtracting the training mean."""
    x = train.select(array_to_vector(F.transform(array, lambda e: e.cast("double"))).alias("_v"))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(x)
    return scaler, PCA(k=k, inputCol="_c", outputCol="_p").fit(scaler.transform(x))


def project(df: DataFrame, array: str, model, out: str) -> DataFrame:
    scaler, pca = model
    x = df.withColumn("_v", array_to_vector(F.transform(array, lambda e: e.cast("double"))))
    return pca.transform(scaler.transform(x)).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")
