"""Telling rows of one key apart."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PART = "tw_part"


def shielded(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """run, with columns of its table whose names begin like those of the operators renamed meanwhile."""

    @wraps(run)
    def wrapped(docs: DataFrame, *more, **named) -> DataFrame:
        own = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.startswith("tw_")}
        if not own:
            return run(docs, *more, **named)
        return run(docs.withColumnsRenamed(own), *more, **named).withColumnsRenamed({v: k for k, v in own.items()})

    return wrapped


def with_part(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs and PART: 0, but for rows that share a key, which it numbers in the order of their texts' hashes. Only where keys repeat are rows sorted at all."""
    if docs.groupBy(key).count().filter("count > 1").limit(1).count() == 0:
        return docs.withColumn(PART, F.lit(0))
    order = W.partitionBy(key).orderBy(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), F.col(text).isNull())
    return docs.withColumn(PART, F.row_number().over(order) - 1)
