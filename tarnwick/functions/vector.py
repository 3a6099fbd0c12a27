"""Vector functions as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either vector has no length, null where sizes differ."""
    length = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(length == 0, 0.0).otherwise(dot(a, b) / length)


def scaled(a: Column, weights: Column) -> Column:
    """A diagonal metric applied and the result brought to length 1."""
    v = F.zip_with(a, weights, lambda x, w: x.cast("double") * w)
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """label, support and centroid: the mean of each component, put together again in order."""
    parts = vectors.select(label, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("support"))
    return means.groupBy(label).agg(F.max("support").alias("support"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def signed_features(tokens: DataFrame, key: str, token: str, width: int) -> DataFrame:
    """key, idx, value of hashed features: index and sign from sha256 of the token, weight 1 + ln(tf), length 1 for each key.

    Tokens that are dealt out by key are counted, summed and scaled where they are, without another shuffle.
    """
    tf = tokens.groupBy(key, token).agg(F.count("*").alias("tf"))
    digest = F.sha2(token, 256)
    index = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % width
    odd = F.conv(F.substring(digest, 17, 2), 16, 10).cast("int") % 2 == 1
    weight = F.lit(1.0) + F.log(F.col("tf").cast("double"))
    value = tf.select(key, index.cast("int").alias("idx"), F.when(odd, weight).otherwise(-weight).alias("w")).groupBy(key, "idx").agg(F.sum("w").alias("value"))
    own = value.withColumn("length", F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key))))
    return own.select(key, "idx", F.when(F.col("length") == 0, 0.0).otherwise(F.col("value") / F.col("length")).alias("value"))


def sparse_features(tokens: DataFrame, key: str, token: str, width: int) -> DataFrame:
    """key and vector, an array of idx and value, of hashed features; rows of a key that stand in one partition are not shuffled again."""
    return signed_features(tokens, key, token, width).groupBy(key).agg(F.collect_list(F.struct("idx", "value")).alias("vector"))


def dense_features(tokens: DataFrame, key: str, token: str, width: int) -> DataFrame:
    """key and vector, an array of width, of hashed features."""
    parts = signed_features(tokens, key, token, width).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    return parts.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))
