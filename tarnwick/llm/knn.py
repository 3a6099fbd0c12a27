"""Exact top-k inner-product search as a Voronoi join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.runtime import materialize, ship, table

SCALE = 1024
#: Pivots are drawn from this many rows at most, those with the least hash of their key; more cells than this are never made.
SAMPLE, MOST_CELLS = 4096, 256
#: Rows of a cell that one task matches at once, and queries likewise.
BLOCK, QUERIES = 8192, 1024


def whole_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v: floor(1024 x) of every component as double. Rows with a null key or vector, or null or non-finite components, stay out."""
    v = F.col(vector)
    usable = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e300))
    return vectors.select(F.col(key).cast("long").alias("id"), F.when(usable, F.transform(v, lambda x: F.floor(x.cast("double") * float(SCALE)).cast("long"))).alias("v")).filter("id is not null and v is not null")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: doubles where they cannot round, Python integers beyond."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * max(1, a.shape[1]) >= 2**53:
        return a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    return a @ b.T


def pivots_of(data: DataFrame) -> np.ndarray:
    """Cell centres: a bounded sample, thinned by farthest-first choice to about the square root of the sample, all of the dimension that most rows have, the larger of equally many."""
    common = data.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).filter("width > 0").orderBy(F.desc("n"), F.desc("width")).first()
    if not common:
        return np.zeros((0, 0))
    rows = data.filter(F.size("v") == common.width).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    sample = np.array([r.v for r in rows], dtype=np.float64)
    count = min(MOST_CELLS, max(1, int(2 * len(sample) ** 0.5)))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def voronoi_top_k(vectors: DataFrame, k: int = 10, queries: str = "id % 100 = 0", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of each query with every row but its own.

    Every row goes to the cell of its nearest pivot (Euclid); a cell's summary is its size and radius. For a query q and
    a cell with pivot p and radius r no score passes q.p + |q| r, and none is below q.p - |q| r. The second bound over the
    cells' sizes gives each group of queries (those of one cell) a first threshold, and the k best of its own cell and of the most
    promising ones give each query an exact one. A query then visits the cells whose upper bound reaches it, as blocks.
    Cells are cut into blocks of rows, so a cell of any size, as of copies of one vector, spreads over tasks.

    Ties go to the smaller key. Rows that repeat a key are candidates each, and a query's own key is never its neighbour; a repeated query answers
    once. Vectors of another dimension than most rows have, null vectors and those with null or non-finite components
    take no part. An empty table gives no rows.
    """
    data = materialize(whole_vectors(vectors, key, vector), "knn-vectors")
    pivots = pivots_of(data)
    cells, width = pivots.shape
    spark = data.sparkSession
    shape = "query_id long, rank int, vec_id long, score long"
    if not cells:
        return spark.createDataFrame([], shape)
    half = (pivots**2).sum(axis=1) / 2

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part[part.v.map(len) == width]
            if len(part):
                v = _matrix(part.v)
                cell = (v @ pivots.T - half).argmax(axis=1)
                yield part.assign(cell=cell, distance=np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1)))

    data = materialize(data.mapInPandas(assign, "id long, v array<long>, cell long, distance double"), "knn-cells")
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"))
    found = {r.cell: r for r in summary.collect()}  # one row per cell, MOST_CELLS at most
    size = np.array([found[c].n if c in found else 0 for c in range(cells)])
    radius = np.array([found[c].radius if c in found else 0.0 for c in range(cells)]) * (1 + 1e-9) + 1e-6
    # own: how many rows have the query's key, which are among the cells' sizes but never its neighbours
    asked = data.filter(queries).groupBy(F.col("id").alias("query_id")).agg(F.first(F.struct("v", "cell")).alias("q"), F.count("*").alias("own")).select("query_id", "q.v", "q.cell", "own")

    def bounds(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre, reach = v @ pivots.T, np.sqrt((v**2).sum(axis=1))[:, None] * radius
        return centre - reach, np.where(size > 0, centre + reach, -np.inf)

    def first_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Own cell and the most promising ones, until they hold more than k rows of other keys."""
        for part in parts:
            _, high = bounds(_matrix(part.v))
            order = np.argsort(-high, axis=1, kind="stable")
            enough = np.cumsum(size[order], axis=1) > k + part.own.to_numpy()[:, None]
            take = np.maximum(enough.argmax(axis=1) + 1, 3)
            lists = [sorted({int(c), *map(int, o[:n])}) for c, o, n in zip(part.cell, order, take, strict=True)]
            yield pd.DataFrame({"query_id": part.query_id, "v": part.v, "own": part.own, "cells": lists})

    def next_cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            low, high = bounds(_matrix(part.v))
            order = np.argsort(-low, axis=1, kind="stable")
            held = np.cumsum(size[order], axis=1) >= k + part.own.to_numpy()[:, None]
            at = np.where(held.any(axis=1), held.argmax(axis=1), cells - 1)
            sure = np.where(held.any(axis=1), np.take_along_axis(low, order, 1)[np.arange(len(part)), at], -np.inf)
            least = np.maximum(sure, part.threshold.astype(float).fillna(-np.inf).to_numpy())
            lists = [[int(c) for c in np.flatnonzero((h >= t - 1e-6 * (1 + abs(t))) & (size > 0)) if c not in set(seen)] for h, t, seen in zip(high, least, part.cells, strict=True)]
            yield pd.DataFrame({"query_id": part.query_id, "v": part.v, "cells": lists})

    blocks = {c: int(-(-size[c] // BLOCK)) for c in range(cells) if size[c]}
    count = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    rows = data.select("id", F.col("v"), "cell", F.pmod(F.xxhash64("id"), count[F.col("cell").cast("int")]).cast("long").alias("block"))

    def solve(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(left) or not len(right):
            return empty
        ids, data_v, out = left.id.to_numpy(), _matrix(left.v), []
        for at in range(0, len(right), 128):
            part = right.iloc[at : at + 128]
            scores = _exact(_matrix(part.v), data_v)
            for q, s in zip(part.query_id.to_numpy(), scores, strict=True):
                ok = ids != q
                i, sc = ids[ok], s[ok]
                best = np.lexsort((i, -sc))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": i[best], "score": sc[best].astype(np.int64)}))
        return pd.concat(out) if out else empty

    def visit(lists: DataFrame) -> DataFrame:
        wanted = lists.select("query_id", "v", F.explode("cells").alias("cell"))
        groups = wanted.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
        wanted = wanted.join(groups, "cell").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count[F.col("cell").cast("int")].cast("long") - 1)))
        wanted = wanted.selectExpr("query_id", "v", "cell as cell_q", "block as block_q", "group as group_q")
        copies = groups.selectExpr("cell as cell_g", "groups as n_groups")
        needed = rows.join(copies, F.col("cell") == F.col("cell_g")).select("id", "v", "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_groups") - 1)).alias("group"))
        return needed.groupBy("cell", "block", "group").cogroup(wanted.groupBy("cell_q", "block_q", "group_q")).applyInPandas(solve, "query_id long, vec_id long, score long")

    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    lists = materialize(asked.mapInPandas(first_cells, "query_id long, v array<long>, own long, cells array<long>"), "knn-first")
    first = materialize(visit(lists), "knn-near")
    kth = first.withColumn("rank", F.row_number().over(rank)).filter(f"rank = {int(k)}").select("query_id", F.col("score").alias("threshold"))
    more = lists.join(kth, "query_id", "left").select("query_id", "v", "own", "cells", "threshold").mapInPandas(next_cells, "query_id long, v array<long>, cells array<long>")
    both = first.unionByName(visit(materialize(more, "knn-more")))
    return both.withColumn("rank", F.row_number().over(rank)).filter(f"rank <= {int(k)}").select("query_id", "rank", "vec_id", "score")


def op5_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return voronoi_top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH u AS (
  SELECT CAST(vec_id AS BIGINT) AS id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), d AS (
  SELECT id, list_transform(e, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM u
), s AS (
  SELECT q.id AS query_id, d.id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM (SELECT * FROM d WHERE id % 100 = 0) q JOIN d ON q.id <> d.id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""
