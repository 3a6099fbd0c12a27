"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.runtime import materialize, ship, table

from .rows import PART, shielded, with_part

WORD = r"[^\\x20\\x09-\\x0D]+"
COPIES = 3
#: Rows that a range of the hash, and copies that a bin of virtual time, hold on average; numbers of both grow with the input.
RANGE_ROWS, BIN_ROWS = 65_536, 250_000


def n_words(text: str) -> Column:
    return F.expr(f"cast(coalesce(regexp_count({text}, '{WORD}'), 0) as long)")


def source_targets(sizes: DataFrame, copies: int = COPIES) -> DataFrame:
    """Targets of the sources in sizes (source, source_size), by water-filling; source_no counts them from 1.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Those whose share passes copies * source_size stop
    there; what they leave goes to the others by weight. In ascending order of size over weight the capped ones come
    first, so two running sums find the first open one and with it the share of a unit of weight.
    """
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy("ratio", "source_no")
    s = sizes.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", (F.col("source_no") - 1) % 3 + 1).withColumn("ratio", F.col("source_size") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("left", F.col("total") - copies * F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("open", F.min(F.when(F.col("left") * F.col("weight") <= copies * F.col("source_size") * F.col("weights"), F.struct("ratio", "source_no", "left", "weights"))).over(everything))
    capped = F.struct("ratio", "source_no") < F.struct("open.ratio", "open.source_no")
    share = F.col("open.left").cast("double") * F.col("weight") / F.col("open.weights")
    return s.select("source", "source_no", "source_size", F.when(capped, (copies * F.col("source_size")).cast("double")).otherwise(share).alias("target"), "total")


def fair_queue(docs: DataFrame, copies: int = COPIES, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text", tie: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row; with tie, a column that tells rows of one key apart, that as well.

    Each source shuffles its rows by md5 of seed, source and key. A row's copy number e (from 0) finishes at virtual time
    (e * source_size + words of its source up to and with it) / target. Copies are taken in the order of that time, ties
    by source, then place, until the total budget, the sum of all sizes, is spent: the first copy that would pass it and
    all later ones stay out. No source is windowed or sorted as a whole: rows fall into ranges of the hash, each
    range starts from the sum of those before it, and only the virtual-time bin in which the budget ends is sorted. Both numbers grow with the rows.

    Texts of any length are counted whole. Null text has size 0 and takes 0 words. Null source is a source of its own, the last. Null keys order first. Rows
    that repeat wholly are interchangeable. With no words at all every target is 0; an empty table gives no rows. Other
    columns are ignored.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(f"`{text}`").alias("size"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("tie"))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = materialize(d.withColumn("h", h), "mix-sizes")
    rows = d.count()
    digits = max(3, math.ceil(math.log(max(1, rows) / RANGE_ROWS, 16)))
    bins_to_1 = max(4096, copies * rows // BIN_ROWS)
    d = d.withColumn("range", F.substring("h", 1, digits))
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), copies)
    starts = sums.withColumn("start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    starts = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.source", "range", "start", "source_no", "source_size", "target", "total")
    d = d.alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source and d.range = s.range")).drop(F.col("s.source"), F.col("s.range"))
    inside = W.partitionBy("source_no", "range").orderBy("h", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    d = materialize(d.withColumn("cum", F.col("start") + F.sum("size").over(inside)).select("doc_id", "size", "tie", "source_no", "source_size", "target", "total", "cum"), "mix-order")

    finish = F.array(*[(e * F.col("source_size") + F.col("cum")).cast("double") / F.col("target") for e in range(copies)])
    copied = d.filter("size > 0").select("source_no", "cum", "size", "total", F.posexplode(finish).alias("copy", "finish")).withColumn("bin", F.floor(F.least("finish", F.lit(4.0)) * bins_to_1))
    bins = copied.groupBy("bin").agg(F.sum("size").alias("bin_size"), F.first("total").alias("total")).withColumn("to", F.sum("bin_size").over(W.orderBy("bin")))
    edge = bins.filter(F.col("to") > F.col("total")).agg(F.min(F.struct("bin", (F.col("to") - F.col("bin_size")).alias("spent"))).alias("edge"))
    edge = edge.select(F.coalesce("edge.bin", F.lit(2**40)).alias("edge_bin"), F.coalesce("edge.spent", F.lit(0)).alias("spent"))
    order = W.orderBy("finish", "source_no", "cum", "copy").rowsBetween(W.unboundedPreceding, 0)
    last = copied.join(F.broadcast(edge), F.col("bin") == F.col("edge_bin")).withColumn("spent", F.col("spent") + F.sum("size").over(order)).filter("spent <= total")
    last = last.groupBy("source_no", "cum").agg(F.count("*").alias("more"))
    whole = sum((F.when(F.floor(F.least(finish[e], F.lit(4.0)) * bins_to_1) < F.col("edge_bin"), 1).otherwise(0) for e in range(copies)), F.lit(0))
    d = d.crossJoin(F.broadcast(edge)).withColumn("whole", F.when((F.col("size") > 0), whole).otherwise(0)).join(last, ["source_no", "cum"], "left")
    taken = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("more", F.lit(0))).otherwise(0).cast("long")
    return d.select("doc_id", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"), *(["tie"] if tie else []))


@shielded
def mixed(docs: DataFrame, copies: int = COPIES) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept.

    Rows without words are not taken. Null keys and sources, and rows that share a key, are told apart by their texts and count each; an empty table gives none.
    """
    d = with_part(docs, "doc_id", "text")
    plan = fair_queue(d, copies, tie=PART).filter("copies > 0").select(F.col("doc_id").alias("tw_id"), F.col("tie").alias("tw_tie"), F.col("copies").alias("tw_copies"))
    out = d.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("tw_id")) & (F.col(PART) == F.col("tw_tie")))
    return out.withColumn("tw_copy", F.explode(F.sequence(F.lit(1).cast("long"), "tw_copies"))).select(*docs.columns)


def op9_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fair_queue(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(source, ''), ':', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM d GROUP BY source
), w AS (
  SELECT *, (source_no - 1) % 3 + 1 AS weight, source_size / ((source_no - 1) % 3 + 1) AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), r AS (
  SELECT *, total - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY ratio, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w
), o AS (
  SELECT ratio, source_no, CAST(rest AS DOUBLE) AS rest, CAST(weights AS DOUBLE) AS weights FROM r WHERE rest * weight <= 3 * source_size * weights ORDER BY ratio, source_no LIMIT 1
), t AS (
  SELECT r.source, r.source_no, r.source_size, r.total,
         CASE WHEN r.ratio < o.ratio OR (r.ratio = o.ratio AND r.source_no < o.source_no) THEN CAST(3 * r.source_size AS DOUBLE) ELSE o.rest * r.weight / o.weights END AS target
  FROM r, o
), q AS (
  SELECT d.doc_id, d.size, t.source_no, t.source_size, t.target, t.total,
         CAST(sum(d.size) OVER (PARTITION BY t.source_no ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(e * source_size + cum AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1), (2)) v(e) WHERE size > 0
), k AS (
  SELECT source_no, cum, count(*) AS copies FROM (SELECT *, sum(size) OVER (ORDER BY finish, source_no, cum, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM c) WHERE spent <= total GROUP BY ALL
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(CASE WHEN q.size > 0 THEN coalesce(k.copies, 0) ELSE 0 END * q.size AS BIGINT) AS taken,
       CAST(CASE WHEN q.size > 0 THEN coalesce(k.copies, 0) ELSE 0 END AS BIGINT) AS copies
FROM q LEFT JOIN k ON q.source_no = k.source_no AND q.cum = k.cum
"""
