"""Quality, drift, run and experiment reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numeric_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, max, mean, median and p95 (linear interpolation) of the finite values."""
    v = F.col(value).cast("double")
    finite = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return finite.groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.percentile(v, 0.95), 6).alias("p95"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, missing (null or empty) and the covered share, null for no rows."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    return counts.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.field", "rows", "x.missing", F.round(F.try_divide(F.col("rows") - F.col("x.missing"), F.col("rows")), 6).alias("coverage"))


def imbalance(df: DataFrame, label: str, rare_share: float) -> DataFrame:
    """total, classes, ratio of the largest to the smallest class, and labels with a share below rare_share, sorted."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"))
    rare = counts.crossJoin(F.broadcast(total)).filter(F.col("n") / F.col("total") < rare_share).agg(F.array_join(F.array_sort(F.collect_list(F.col(label).cast("string"))), ",").alias("rare"))
    return total.crossJoin(rare)


def shares(df: DataFrame, category: str) -> DataFrame:
    n = df.groupBy(F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("category", (F.col("n") / F.col("total")).alias("share"))


def drift(before: DataFrame, after: DataFrame, category: str) -> DataFrame:
    """Jensen-Shannon divergence (base 2), total variation, and numbers of new and dropped categories."""
    both = shares(before, category).withColumnRenamed("share", "p").join(shares(after, category).withColumnRenamed("share", "q"), "category", "full_outer").select("category", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    middle = (F.col("p") + F.col("q")) / 2

    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0)

    return both.agg(F.round(F.sum(part("p") + part("q")) / 2, 9).alias("js"), F.round(F.sum(F.abs(F.col("p") - F.col("q"))) / 2, 9).alias("tv"), F.count_if((F.col("p") == 0) & (F.col("q") > 0)).alias("new"), F.count_if((F.col("q") == 0) & (F.col("p") > 0)).alias("dropped"))


def run_diagnostics(log: DataFrame, run: str, step: str, loss: str, order: str) -> DataFrame:
    """One row per run of an ordered training log: what its loss curve shows.

    best and last loss, whether the last is over 1.02 times the best of three or more, the slope over the second half, the
    standard deviation of consecutive differences, steps that do not increase, and spikes over ten times the median.
    """
    w = W.partitionBy(run).orderBy(order)
    x = log.filter(F.col(loss).isNotNull()).withColumn("rn", F.row_number().over(w)).withColumn("rows", F.count("*").over(W.partitionBy(run)))
    x = x.withColumn("before", F.lag(loss).over(w)).withColumn("step_before", F.lag(step).over(w))
    late = F.col("rn") > F.floor(F.col("rows") / 2)
    third = F.floor(F.col("rows") / 3)
    g = x.groupBy(run).agg(
        F.count("*").alias("n"), F.min(F.struct(loss, order)).alias("best"), F.max(F.struct(order, loss)).alias("last"),
        F.round(F.regr_slope(F.when(late, F.col(loss)), F.when(late, F.col("rn").cast("double"))), 6).alias("tail_slope"),
        F.round(F.stddev_samp(F.col(loss) - F.col("before")), 6).alias("jitter"),
        F.count_if(F.col(step) <= F.col("step_before")).alias("non_increasing"),
        F.percentile(loss, 0.5).alias("median"), F.max(loss).alias("most"),
        F.avg(F.when(F.col("rn") <= third, F.col(loss))).alias("first_third"), F.avg(F.when(F.col("rn") > F.col("rows") - third, F.col(loss))).alias("last_third"),
    )
    return g.select(
        run, "n", F.round(F.col("best")[loss], 6).alias("best"), F.round(F.col("last")[loss], 6).alias("last"),
        ((F.col("n") >= 3) & (F.col("last")[loss] > F.col("best")[loss] * 1.02)).alias("regressed"), "tail_slope",
        F.when(F.col("n") >= 3, F.col("jitter")).alias("jitter"), "non_increasing",
        ((F.col("n") >= 3) & (F.col("most") > F.greatest(F.lit(100.0), F.col("median") * 10))).alias("spike"),
        ((F.col("n") >= 6) & (F.col("first_third") > 0) & (F.col("last_third") < F.col("first_third") / 2)).alias("collapsed"),
    )


def paired_effects(log: DataFrame, variant: str, baseline: str, pair: list[str], value: str, by: list[str], minimize: bool = False, order: str | None = None) -> DataFrame:
    """Mean paired difference to the baseline with a normal 95 % interval, for each variant and group; positive is better.

    A pair needs both values; of several baselines for one key the last by order counts, or the greatest. Fewer than two pairs: no interval, outcome uncertain.
    """
    base = log.filter(F.col(variant) == baseline).groupBy(*pair).agg(F.max_by(value, order or value).alias("base"))
    sign = -1.0 if minimize else 1.0
    d = log.filter(F.col(variant) != baseline).join(base, pair).withColumn("delta", (F.col(value) - F.col("base")) * sign)
    g = d.groupBy(variant, *by).agg(F.count("*").alias("pairs"), F.avg("delta").alias("m"), F.stddev_samp("delta").alias("s"))
    half = F.when(F.col("pairs") > 1, F.lit(1.96) * F.col("s") / F.sqrt(F.col("pairs")))
    return g.select(variant, *by, "pairs", F.round("m", 6).alias("mean_delta"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), F.when(F.col("m") - half > 0, "improved").when(F.col("m") + half < 0, "regressed").otherwise("uncertain").alias("outcome"))


def count_matrix(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of every pair of a row and a column value, zeros as well; both are dimensions, few by nature."""
    n = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    cells = df.select(rows).distinct().crossJoin(F.broadcast(df.select(columns).distinct()))
    return cells.join(n, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def split_leaks(df: DataFrame, family: str, split: str) -> DataFrame:
    """Families with rows in more than one split."""
    return df.groupBy(family).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("n")).filter("splits > 1")


def collisions(df: DataFrame, alias: str, owner: str) -> DataFrame:
    """Aliases with more than one owner."""
    return df.groupBy(alias).agg(F.countDistinct(owner).alias("owners")).filter("owners > 1")
