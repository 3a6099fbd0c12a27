"""Record merging, upserts and dataset building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.runtime import materialize


def merge_by_priority(rows: DataFrame, key: str, priority: Column, tie: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the first non-empty value by priority, then tie, and whether sources conflict on it (missing, present or conflicted)."""
    aggregates = []
    for f in fields:
        filled = F.col(f).isNotNull() & (F.col(f).cast("string") != "")
        distinct = F.countDistinct(F.when(filled, F.col(f)))
        aggregates += [F.min(F.when(filled, F.struct(priority.alias("p"), F.col(tie).alias("t"), F.col(f).alias("v")))).alias(f), F.when(distinct == 0, "missing").when(distinct == 1, "present").otherwise("conflicted").alias(f"{f}_state")]
    merged = rows.groupBy(key).agg(*aggregates, F.count("*").alias("sources"))
    return merged.select(key, *[F.col(f"{f}.v").alias(f) for f in fields], *[f"{f}_state" for f in fields], "sources")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order]))).filter("rn = 1").drop("rn")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, stamp: str, digest: str) -> DataFrame:
    """incoming with outcome: stale if it lacks a timestamp that the stored row has or is older, unchanged if the digest is equal, else changed."""
    s = stored.select(F.col(key).alias("k"), F.col(stamp).alias("old_stamp"), F.col(digest).alias("old_digest"))
    stale = F.col("old_stamp").isNotNull() & (F.col(stamp).isNull() | (F.col(stamp) < F.col("old_stamp")))
    outcome = F.when(F.col("k").isNull(), "changed").when(stale, "stale").when(F.col(digest) == F.col("old_digest"), "unchanged").otherwise("changed")
    return incoming.join(s, F.col(key) == F.col("k"), "left").withColumn("outcome", outcome).drop("k", "old_stamp", "old_digest")


def cyclic_pick(rows: DataFrame, candidates: DataFrame, bucket: str, key: str, family: str, start: Column, also: list[str] | None = None, row: str | None = None) -> DataFrame:
    """For each row of rows, named by row (key, if not given), the first candidate of its bucket, from place start on and around, of another family.

    Candidates are numbered by key in their bucket, and neighbours of one family form a run. The answer is the candidate at the place itself, else the
    start of the next run, else, after the bucket's end, the first candidate or that of the second run: four lookups, whatever the sizes. A null family is one of its own.
    """
    name = row or key
    fam = F.coalesce(F.concat(F.lit("="), F.col(family).cast("string")), F.lit(""))
    c = candidates.select(F.col(bucket).alias("b"), F.col(key).alias("k"), fam.alias("f")).withColumnRenamed("k", "picked")
    by = W.partitionBy("b").orderBy("picked")
    c = c.withColumn("p", F.row_number().over(by) - 1).withColumn("new", F.coalesce((F.lag("f").over(by) != F.col("f")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by))
    heads = c.filter("new = 1").select("b", "run", "picked", "f")
    following = heads.select("b", (F.col("run") - 1).alias("run"), F.col("picked").alias("next"))
    turn = heads.filter("run <= 2").groupBy("b").agg(F.max(F.when(F.col("run") == 1, F.struct("picked", "f"))).alias("r1"), F.max(F.when(F.col("run") == 2, F.struct("picked", "f"))).alias("r2"))
    sizes = c.groupBy("b").agg(F.count("*").alias("size"))
    around = sizes.join(turn, "b")
    r = rows.select(*dict.fromkeys([name, *(also or [])]), F.col(bucket).alias("b"), fam.alias("own"), start.alias("start")).join(around, "b").withColumn("p", F.pmod("start", F.col("size")))
    at = r.join(c.select("b", "p", "picked", "f", "run"), ["b", "p"]).join(following, ["b", "run"], "left")
    wrapped = F.when(F.col("r1.f") != F.col("own"), F.col("r1.picked")).otherwise(F.col("r2.picked"))
    found = F.when(F.col("f") != F.col("own"), F.col("picked")).otherwise(F.coalesce("next", wrapped))
    return at.select(*dict.fromkeys([name, *(also or [])]), found.alias("picked")).filter("picked is not null")


def missing_plan(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and the fields that it lacks, comma-joined in order; only rows that lack some."""
    lacking = F.filter(F.array(*[F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return rows.select(key, F.array_join(lacking, ",").alias("missing")).filter("missing <> ''")


def nth_rows(rows: DataFrame, key: str, places: list[int]) -> list:
    """The rows at some places in order of key: ranges are sorted apart, and only their sizes and the rows asked for reach the driver."""
    ordered = materialize(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("tw_range", F.spark_partition_id()), "ordered")
    sizes = sorted((r.tw_range, r["count"]) for r in ordered.groupBy("tw_range").count().collect())
    wanted, before = [], 0
    for part, size in sizes:
        wanted += [(part, at - before) for at in places if before <= at < before + size]
        before += size
    asked = rows.sparkSession.createDataFrame(wanted, "tw_range int, tw_place long")
    numbered = ordered.join(F.broadcast(asked.select("tw_range").distinct()), "tw_range").withColumn("tw_place", (F.row_number().over(W.partitionBy("tw_range").orderBy(key)) - 1).cast("long"))
    found = numbered.join(F.broadcast(asked), ["tw_range", "tw_place"]).orderBy("tw_range", "tw_place").drop("tw_range", "tw_place")
    return found.collect()


def spherical_kmeans(vectors: DataFrame, key: str, vector: str, k: int, rounds: int = 25) -> DataFrame:
    """key and cluster by deterministic spherical k-means; the k centroids, whose number bounds them, are all that the driver holds.

    Starts from the vectors at places i * n // k by key; ties go to the lowest cluster; an empty cluster keeps its centroid.
    """
    import numpy as np

    spark = vectors.sparkSession
    unit = F.transform(vector, lambda x: x.cast("double"))
    n = vectors.count()
    k = min(k, n)
    if not k:
        return spark.createDataFrame([], "key long, cluster int")
    places = sorted({i * n // k for i in range(k)})
    centres = np.array([v for _, v in nth_rows(vectors.select(F.col(key).alias("key"), unit.alias("v")), "key", places)])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    data = vectors.select(F.col(key).alias("key"), unit.alias("v"))

    def assign(c: np.ndarray) -> DataFrame:
        def run(parts):
            for part in parts:
                m = np.array(part.v.tolist()).reshape(len(part), -1)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                part["cluster"] = (m @ c.T).argmax(axis=1)
                part["v"] = list(m)
                yield part

        return data.mapInPandas(run, "key long, v array<double>, cluster int")

    before = None
    for _ in range(rounds):
        sums = assign(centres).select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s")).collect()
        new = np.zeros_like(centres)
        for r in sums:
            new[r.cluster, r.i] = r.s
        length = np.linalg.norm(new, axis=1, keepdims=True)
        centres = np.where(length > 0, new / np.maximum(length, 1e-300), centres)
        if before is not None and np.allclose(before, centres, atol=1e-12):
            break
        before = centres
    return assign(centres).select("key", "cluster")
