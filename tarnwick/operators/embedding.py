"""Vectors of texts: encoders, metric adapters, training pairs, and an index that keeps up with its records."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.canonical import digest
from tarnwick.functions.vector import cosine

from .graph import pairs_of_disjoint_labels


class Encoder(Protocol):
    """What makes vectors: its manifest names model and dimension, encode takes texts and gives one row of finite numbers for each."""

    manifest: dict

    def encode(self, texts: list[str]) -> np.ndarray: ...


def model_id(encoder: Encoder) -> str:
    return digest(encoder.manifest)


def encoded(rows: DataFrame, text: str, make: Callable[[], Encoder], dimension: int) -> DataFrame:
    """rows with vector: texts go through the encoder in batches, which each worker makes once. A vector of another size or with odd numbers is an error."""
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for part in parts:
            m = np.asarray(encoder.encode([t or "" for t in part[text]]), dtype=float).reshape(len(part), -1)
            if len(part) and (m.shape[1] != dimension or not np.isfinite(m).all()):
                raise ValueError("vectors must have the stated size and finite numbers")
            yield part.assign(vector=list(m))[[*names, "vector"]]

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return rows.mapInPandas(run, StructType([*rows.schema.fields]).add("vector", ArrayType(DoubleType())))


def outdated(records: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Active records (vuln_id, revision) that the index lacks for a model, or has in another revision."""
    have = index.filter(F.col("model_id") == model).select("vuln_id", "revision").distinct()
    return records.filter("status = 'active'").join(have, ["vuln_id", "revision"], "left_anti")


def refreshed(index: DataFrame, fresh: DataFrame, records: DataFrame) -> DataFrame:
    """The index after a build: rows whose record has another revision by now go, and fresh rows take the place of those of their key, model and view."""
    live = index.join(records.select("vuln_id", "revision"), ["vuln_id", "revision"], "left_semi")
    same = ["model_id", "vuln_id", "revision", "view"]
    return live.join(fresh.select(*same), same, "left_anti").unionByName(fresh)


def index_status(records: DataFrame, index: DataFrame, views: DataFrame, model: str) -> DataFrame:
    """One row: active records, indexed, missing, stale (indexed in another revision, or with views that differ from the record's), and vectors of the model.

    Each condition is counted per record first and then joined, which says the same as an OR of EXISTS.
    """
    own = index.filter(F.col("model_id") == model)
    active = records.filter("status = 'active'").select("vuln_id", "revision")
    have = own.groupBy("vuln_id").agg(F.collect_set("revision").alias("revisions"), F.count("*").alias("vectors"))
    made = own.select("vuln_id", "revision", "view").distinct().groupBy("vuln_id", "revision").agg(F.count("*").alias("made"))
    need = views.select("vuln_id", "view").distinct().groupBy("vuln_id").agg(F.count("*").alias("need"))
    x = active.join(have, "vuln_id", "left").join(made, ["vuln_id", "revision"], "left").join(need, "vuln_id", "left")
    current = F.coalesce(F.array_contains("revisions", F.col("revision")), F.lit(False))
    whole = F.coalesce("made", F.lit(0)) == F.coalesce("need", F.lit(0))
    return x.agg(F.count("*").alias("active"), F.count_if(current & whole).alias("indexed"), F.count_if(F.col("revisions").isNull()).alias("missing"), F.count_if(F.col("revisions").isNotNull() & ~(current & whole)).alias("stale"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors"))


def positive_pairs(views: DataFrame) -> DataFrame:
    """left, right, label 1, relation and vuln_id: a record's description, or else its aggregate, with each of its poc, patch, component and metadata views."""
    v = views.filter(F.col("view").isin("description", "aggregate", "poc", "patch", "component", "metadata"))
    anchor = v.groupBy("vuln_id").agg(F.coalesce(F.max(F.when(F.col("view") == "description", F.col("text"))), F.max(F.when(F.col("view") == "aggregate", F.col("text")))).alias("left")).filter("left is not null")
    other = v.filter(~F.col("view").isin("description", "aggregate"))
    return anchor.join(other, "vuln_id").select("left", F.col("text").alias("right"), F.lit(1).alias("label"), F.concat(F.lit("description_to_"), "view").alias("relation"), "vuln_id")


def positives(views: Column) -> Column:
    """The positive pairs of one record, as structs of left, right and relation, from its array of views (view, text)."""
    of = lambda name: F.get(F.filter(views, lambda x: x["view"] == name), F.lit(0))["text"]
    left = F.coalesce(of("description"), of("aggregate"))
    other = F.filter(views, lambda x: x["view"].isin("poc", "patch", "component", "metadata"))
    made = F.transform(other, lambda x: F.struct(left.alias("left"), x["text"].alias("right"), F.concat(F.lit("description_to_"), x["view"]).alias("relation")))
    return F.filter(made, lambda x: x["left"].isNotNull())


def negative_pairs(records: DataFrame, views: DataFrame, most: int = 10_000) -> DataFrame:
    """left, right, label 0 and relation of the first pairs, in order of keys, of active records whose weaknesses are both filled and disjoint; most bounds them."""
    text = views.groupBy("vuln_id").agg(F.coalesce(F.max(F.when(F.col("view") == "description", F.col("text"))), F.max(F.when(F.col("view") == "aggregate", F.col("text")))).alias("text")).filter("text is not null")
    usable = records.filter("status = 'active'").join(text.select("vuln_id"), "vuln_id", "left_semi")
    pairs = pairs_of_disjoint_labels(usable, "vuln_id", "weaknesses", most)
    a, b = text.select(F.col("vuln_id").alias("l"), F.col("text").alias("left_text")), text.select(F.col("vuln_id").alias("r"), F.col("text").alias("right_text"))
    return pairs.join(a, F.col("left") == F.col("l")).join(b, F.col("right") == F.col("r")).select(F.col("left_text").alias("left"), F.col("right_text").alias("right"), F.lit(0).alias("label"), F.lit("different_weakness").alias("relation"))


def read_pairs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (line, left, right, label, relation) of lines (line, value) of JSON, and findings on lines that are none."""
    from .reports import findings

    p = lines.select("line", "value", F.from_json("value", "left string, right string, label string, relation string").alias("p"))
    label = F.when(F.lower("p.label").isin("1", "true"), 1).when(F.lower("p.label").isin("0", "false"), 0)
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    broken = F.expr("try_parse_json(value)").isNull()
    found = findings(p, ["line"], {"invalid_json": broken, "missing_text": ~broken & (empty("p.left") | empty("p.right")), "invalid_label": ~broken & label.isNull()})
    good = p.filter(~broken & ~empty("p.left") & ~empty("p.right") & label.isNotNull())
    return good.select("line", "p.left", "p.right", label.alias("label"), F.coalesce(F.nullif("p.relation", F.lit("")), F.lit("unspecified")).alias("relation")), found


def fit_adapter(left: np.ndarray, right: np.ndarray, labels: np.ndarray, epochs: int = 8, rate: float = 0.2, margin: float = 0.2) -> tuple[np.ndarray, list[float]]:
    """Weights of a diagonal metric that brings pairs of label 1 together and those of label 0 under a margin, and the mean loss of each epoch.

    Steps follow the pairs in order, so the result hangs on it; the pairs are a bounded sample that the driver holds. Logarithms of squared weights stay in -4..4.
    """
    if not 1 <= epochs <= 1000 or not 0 < rate <= 2 or not -1 <= margin <= 1:
        raise ValueError("epochs must lie in 1..1000, rate in 0..2 and margin in -1..1")
    if set(np.unique(labels)) != {0, 1}:
        raise ValueError("pairs of both labels are needed")
    logs, history = np.zeros(left.shape[1]), []
    for _ in range(epochs):
        losses = []
        for a, b, y in zip(left, right, labels, strict=True):
            q = np.exp(logs)
            aa, bb = float(q @ (a * a)), float(q @ (b * b))
            length = math.sqrt(aa * bb)
            if not length:
                continue
            near = float(q @ (a * b)) / length
            losses.append(1 - near if y else max(0.0, near - margin))
            if y or near > margin:
                slope = q * (a * b / length - 0.5 * near * (a * a / aa + b * b / bb))
                logs = np.clip(logs + (rate if y else -rate) * slope, -4.0, 4.0)
        history.append(float(np.mean(losses)) if losses else 0.0)
    return np.exp(logs / 2), history


def classify(vectors: DataFrame, labelled: DataFrame, key: str, vector: str, label: str, k: int = 5, examples: int = 5) -> DataFrame:
    """key, label, score, support, examples and rank: the k labels whose centroids are closest to each vector, with how many rows made the centroid and the first of them.

    Labels are a dimension; their centroids are broadcast.
    """
    from pyspark.sql.window import Window as W

    from tarnwick.functions.vector import centroids

    c = centroids(labelled, label, vector)
    firsts = labelled.select(label, F.col(key).alias("e")).withColumn("rn", F.row_number().over(W.partitionBy(label).orderBy("e"))).filter(F.col("rn") <= examples)
    named = c.join(firsts.groupBy(label).agg(F.array_sort(F.collect_list("e")).alias("examples")), label, "left")
    s = vectors.select(key, F.col(vector).alias("v")).crossJoin(F.broadcast(named)).withColumn("score", F.round(cosine(F.col("v"), F.col("centroid")), 6))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), label))).filter(F.col("rank") <= k).select(key, label, "score", "support", "examples", "rank")
