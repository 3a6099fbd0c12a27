"""Validation of logs and manifests into findings, and the reports on datasets, training runs, experiments and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Splits, metrics of a training log, those of them that are never negative, shares, states and abnormal kinds of events.
SPLITS = ("train", "validation", "test")
METRICS = ("loss", "eval_loss", "learning_rate", "grad_norm", "throughput", "gpu_memory_mb", "gpu_util_percent", "cpu_percent", "cpu_memory_mb", "disk_read_mb_s", "disk_write_mb_s")
NOT_NEGATIVE = METRICS[2:]
PERCENT = ("cpu_percent", "gpu_util_percent")
RUN_STATES = ("running", "succeeded", "failed", "cancelled")
ABNORMAL = ("signal", "timeout", "oom", "policy_violation", "monitor_lost")


def findings(rows: DataFrame, keep: list[str], rules: dict[str, Column]) -> DataFrame:
    """keep and kind, one row for each rule that a row breaks; a rule that is null holds."""
    kinds = F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])
    return rows.select(*keep, F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def nearest_rank(values: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """by, n, least, most and p<share> percentiles: the value at place ceil(share * n) in order."""
    kind = dict(values.dtypes)[value]
    names = [F.expr(f"cast(percentile_disc({s}) within group (order by `{value}`) as {kind})").alias(f"p{round(100 * s)}") for s in shares]
    return values.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *names)


def artifact_status(rows: DataFrame, facets: list[str], size: str) -> DataFrame:
    """facet, name, n and bytes: counts and sizes by each facet, and of all (facet total), in one pass by grouping sets."""
    names = list(facets)
    view = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in names], F.col(size).alias("tw_size"))
    out = view.groupingSets([[F.col(c)] for c in names] + [[]], *[F.col(c) for c in names]).agg(F.count("*").alias("n"), F.sum("tw_size").cast("long").alias("bytes"), F.grouping_id(*names).alias("g"))
    bit = lambda i: 2 ** len(names) - 1 - 2 ** (len(names) - 1 - i)
    facet = F.coalesce(*[F.when(F.col("g") == bit(i), F.lit(c)) for i, c in enumerate(names)], F.lit("total"))
    return out.select(facet.alias("facet"), F.coalesce(*[F.col(c) for c in names], F.lit("all")).alias("name"), "n", "bytes")


def manifest_findings(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """kind and subject of what is wrong with a manifest (line, sample_id, vuln_id, family_id, split, labels, modalities, weight).

    known: ids that may be named. Rows in no valid split take no part in leaks.
    """
    subject = F.coalesce(F.col("sample_id"), F.concat(F.lit("line "), F.col("line").cast("string")))
    blank = lambda c: F.exists(c, lambda x: x.isNull() | (F.trim(x) == ""))
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    weight = F.col("weight")
    single = findings(rows.withColumn("subject", subject), ["subject"], {
        "missing_sample_id": empty("sample_id"), "missing_vuln_id": empty("vuln_id"), "invalid_split": ~F.col("split").isin(*SPLITS) | F.col("split").isNull(),
        "invalid_labels": F.col("labels").isNull() | blank("labels"), "invalid_modalities": F.col("modalities").isNull() | blank("modalities"), "invalid_weight": F.isnan(weight) | (weight <= 0) | (F.abs(weight) == float("inf")),
    }).select("kind", "subject")
    placed = rows.filter(F.col("split").isin(*SPLITS))
    several = lambda c, kind: placed.filter(~empty(c)).groupBy(c).agg(F.countDistinct("split").alias("s")).filter("s > 1").select(F.lit(kind).alias("kind"), F.col(c).alias("subject"))
    repeated = rows.filter(~empty("sample_id")).groupBy("sample_id").count().filter("count > 1").select(F.lit("duplicate_sample_id").alias("kind"), F.col("sample_id").alias("subject"))
    out = single.unionByName(repeated).unionByName(several("vuln_id", "vulnerability_split_leakage")).unionByName(several("family_id", "family_split_leakage"))
    if known is not None:
        out = out.unionByName(rows.filter(~empty("vuln_id")).join(known.select(F.col(known.columns[0]).alias("vuln_id")), "vuln_id", "left_anti").select(F.lit("unknown_vulnerability").alias("kind"), F.col("vuln_id").alias("subject")))
    return out


def manifest_counts(rows: DataFrame, rare_share: float = 0.05) -> DataFrame:
    """facet (split, label, modality, label:split), name, n, share of its facet, and whether it is rare."""
    facets = F.concat(
        F.when(F.col("split").isin(*SPLITS), F.array(F.struct(F.lit("split").alias("facet"), F.col("split").alias("name")))).otherwise(F.expr("cast(array() as array<struct<facet:string,name:string>>)")),
        F.transform(F.coalesce("labels", F.expr("cast(array() as array<string>)")), lambda x: F.struct(F.lit("label").alias("facet"), F.trim(x).alias("name"))),
        F.transform(F.coalesce("modalities", F.expr("cast(array() as array<string>)")), lambda x: F.struct(F.lit("modality").alias("facet"), F.trim(x).alias("name"))),
        F.when(F.col("split").isin(*SPLITS), F.transform(F.coalesce("labels", F.expr("cast(array() as array<string>)")), lambda x: F.struct(F.lit("label_by_split").alias("facet"), F.concat_ws(":", "split", F.trim(x)).alias("name")))).otherwise(F.expr("cast(array() as array<struct<facet:string,name:string>>)")),
    )
    n = rows.select(F.explode(facets).alias("x")).groupBy("x.facet", "x.name").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("facet"))
    return n.withColumn("share", F.round(share, 6)).withColumn("rare", (share < rare_share) & F.col("facet").isin("label", "modality"))


def log_findings(log: DataFrame) -> DataFrame:
    """run_id, file, line, kind of rows of a training log that break a rule; a step is compared with the one before it in reading order."""
    w = W.partitionBy("run_id").orderBy("file", "line")
    has = [m for m in METRICS if m in log.columns]
    rules = {"non_increasing_step": F.col("step") <= F.col("before"), "invalid_step": F.col("step").isNull() | F.isnan("step") | (F.col("step") < 0)}
    rules |= {f"invalid_metric:{m}": F.isnan(m) | (F.abs(m) == float("inf")) for m in has} | {f"negative_metric:{m}": F.col(m) < 0 for m in has if m in NOT_NEGATIVE} | {f"out_of_range_metric:{m}": (F.col(m) > 100) & ~F.isnan(m) for m in has if m in PERCENT}
    if "status" in log.columns:
        rules["invalid_run_status"] = ~F.lower(F.coalesce(F.nullif("status", F.lit("")), F.lit("running"))).isin(*RUN_STATES)
    return findings(log.withColumn("step", F.col("step").cast("double")).withColumn("before", F.lag("step").over(w)), ["run_id", "file", "line"], rules)


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double"))


def training_report(log: DataFrame) -> DataFrame:
    """One row per run of a training log (run_id, file, line, step, loss, eval_loss, grad_norm, throughput, dataset_version, model_version, status).

    Rows stand in order of step, ties in reading order. Each metric is judged on its own filled rows: best and last evaluation, the gap of the last row with
    both losses, the slope of loss over step in its later half, the deviation of its changes; flags of regression, spike, collapse, versions and interruption.
    """
    order = [F.col("step").cast("double"), F.col("file"), F.col("line")]
    w = W.partitionBy("run_id").orderBy(*order)
    x = log.select("run_id", *[c.alias(n) for c, n in zip(order, ("step", "file", "line"), strict=True)], *[_finite(m).alias(m) for m in ("loss", "eval_loss", "grad_norm", "throughput")], *[F.col(c).cast("string").alias(c) for c in ("dataset_version", "model_version")], F.lower(F.coalesce(F.nullif("status", F.lit("")), F.lit("running"))).alias("status"))
    for m in ("loss", "throughput"):
        x = x.withColumn(f"{m}_n", F.count(m).over(W.partitionBy("run_id"))).withColumn(f"{m}_rn", F.when(F.col(m).isNotNull(), F.count(m).over(w)))
    x = x.withColumn("place", F.row_number().over(w)).withColumn("loss_before", F.last("loss", True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    late = F.col("loss_rn") > F.floor(F.col("loss_n") / 2)
    third = F.greatest(F.lit(1), F.floor(F.col("throughput_n") / 3))
    last = lambda c, when: F.max_by(F.when(when, c), F.when(when, F.col("place")))
    evaluated, both, ended = F.col("eval_loss").isNotNull(), F.col("loss").isNotNull() & F.col("eval_loss").isNotNull(), F.col("status").isin("failed", "cancelled")
    gradient = F.when(F.col("grad_norm") >= 0, F.col("grad_norm"))
    g = x.groupBy("run_id").agg(
        F.count("*").alias("observations"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.min(F.when(evaluated, F.struct(F.col("eval_loss").alias("value"), "place", "step"))).alias("best"), F.count("eval_loss").alias("evals"),
        last(F.col("eval_loss"), evaluated).alias("last_eval"), last(F.col("eval_loss") - F.col("loss"), both).alias("final_gap"), F.regr_slope(F.when(late, F.col("loss")), F.when(late, F.col("step"))).alias("tail_loss_slope"),
        F.count(F.col("loss") - F.col("loss_before")).alias("changes"), F.stddev_samp(F.col("loss") - F.col("loss_before")).alias("change_std"), F.count(gradient).alias("gradients"), F.percentile(gradient, 0.5).alias("median_gradient"), F.max(gradient).alias("most_gradient"),
        F.max("throughput_n").alias("speeds"), F.avg(F.when(F.col("throughput_rn") <= third, F.col("throughput"))).alias("first_speed"), F.avg(F.when(F.col("throughput_rn") > F.col("throughput_n") - third, F.col("throughput"))).alias("last_speed"),
        F.array_sort(F.collect_set(F.nullif("dataset_version", F.lit("")))).alias("dataset_versions"), F.array_sort(F.collect_set(F.nullif("model_version", F.lit("")))).alias("model_versions"),
        last(F.col("status"), F.lit(True)).alias("last_status"), last(F.struct("status", "step"), ended).alias("interrupted"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    kinds = {
        "eval_regression": (F.col("evals") >= 3) & (F.col("last_eval") > F.col("best.value") * 1.02), "dataset_version_changed": F.size("dataset_versions") > 1, "model_version_changed": F.size("model_versions") > 1,
        "run_interrupted": F.col("interrupted").isNotNull(), "gradient_spike": (F.col("gradients") >= 3) & (F.col("most_gradient") > F.greatest(F.lit(100.0), F.col("median_gradient") * 10)),
        "throughput_collapse": (F.col("speeds") >= 6) & (F.col("first_speed") > 0) & (F.col("last_speed") < F.col("first_speed") * 0.5),
    }
    r = lambda c, n: F.round(c, 6).alias(n)
    return g.select(
        "run_id", "observations", "first_step", "last_step", F.col("best.step").alias("best_step"), r(F.col("best.value"), "best_eval"), r(F.col("last_eval"), "last_eval"), r(F.col("final_gap"), "final_gap"), r(F.when(~F.isnan("tail_loss_slope"), F.col("tail_loss_slope")), "tail_loss_slope"),
        r(F.when(F.col("changes") >= 2, F.col("change_std")), "loss_change_std"), "last_status", F.array_join("dataset_versions", ",").alias("dataset_versions"), F.array_join(F.filter(F.array(*[F.when(yes(c), F.lit(k)) for k, c in kinds.items()]), lambda k: k.isNotNull()), ",").alias("findings"),
    )


def effect_report(log: DataFrame, baseline: str = "baseline", order: str = "line") -> DataFrame:
    """One row per task, metric, direction and variant but the baseline: paired differences, positive where better, with a normal 95 % interval.

    log: variant, task, metric, direction, seed, dataset_version, value. A baseline's value is the last one in order of its task, metric, seed and
    dataset; every row of a variant that has one is a pair, whatever direction the baseline's row names. Rows without a finite value or a direction take no part.
    """
    v = log.select("variant", "task", "metric", F.lower("direction").alias("direction"), F.coalesce(F.col("seed").cast("string"), F.lit("default")).alias("seed"), F.coalesce("dataset_version", F.lit("unspecified")).alias("dataset_version"), _finite("value").alias("value"), F.col(order).alias("place"))
    v = v.filter("value is not null and direction in ('maximize', 'minimize') and variant <> '' and metric <> ''")
    pair = ["task", "metric", "seed", "dataset_version"]
    base = v.filter(F.col("variant") == baseline).groupBy(*pair).agg(F.max_by("value", "place").alias("base"))
    better = F.when(F.col("direction") == "maximize", F.col("value") - F.col("base")).otherwise(F.col("base") - F.col("value"))
    d = v.filter(F.col("variant") != baseline).join(base, pair, "left").withColumn("delta", better)
    g = d.groupBy("task", "metric", "direction", "variant").agg(F.count("delta").alias("pairs"), F.avg("delta").alias("m"), F.stddev_samp("delta").alias("s"))
    half = F.when(F.col("pairs") > 1, F.lit(1.96) * F.col("s") / F.sqrt(F.col("pairs")))
    outcome = F.when(F.col("m") - half > 0, "improved").when(F.col("m") + half < 0, "regressed").otherwise("unchanged_or_uncertain")
    return g.select("task", "metric", "direction", "variant", "pairs", F.round("m", 6).alias("mean_delta"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"), outcome.alias("outcome"), F.when(F.col("pairs") >= 2, "repeated_pairs").otherwise("insufficient_pairs").alias("evidence"))


def effect_findings(log: DataFrame, order: str = "line") -> DataFrame:
    """line and kind: missing variant or metric, odd direction, no finite value, and observations that repeat an earlier one."""
    w = W.partitionBy("task", "metric", "variant", F.col("seed").cast("string"), "dataset_version").orderBy(order)
    x = log.withColumn("nth", F.row_number().over(w))
    empty = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    odd = _finite("value").isNull()
    way = ~F.lower("direction").isin("maximize", "minimize")
    return findings(x, [order], {"missing_variant": empty("variant"), "missing_metric": empty("metric"), "invalid_direction": way, "invalid_effect_value": odd, "duplicate_effect_observation": (F.col("nth") > 1) & ~odd & ~way & ~empty("variant") & ~empty("metric")})


def event_report(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of system calls by name, and abnormal events (line, run_id, kind, name), of a log (line, run_id, timestamp, type, name, pid, return_code)."""
    calls = events.filter("type = 'syscall'").groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))
    failed = (F.col("type") == "syscall") & (F.col("return_code") < 0)
    odd = events.filter(failed | F.col("type").isin(*ABNORMAL)).select("line", "run_id", F.when(failed, "syscall_error").otherwise(F.col("type")).alias("kind"), "name")
    return calls, odd


def union_findings(parts: dict[str, DataFrame]) -> DataFrame:
    """All findings with the scope that they come from; a column that a part lacks is null there."""
    out = None
    for scope, df in parts.items():
        own = df.withColumn("scope", F.lit(scope))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def write_rows(rows: DataFrame, path: str, kind: str) -> None:
    """Writes rows as json (lines) or csv (with a header; arrays, maps and structs as JSON), never over what is there."""
    if kind == "csv":
        rows = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])
        rows.write.mode("errorifexists").option("header", True).csv(path)
    elif kind == "json":
        rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"no such kind: {kind}")


def write_bundle(tables: dict[str, DataFrame | None], found: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Writes each report as csv and the union of findings; says of each whether it was written or not connected."""
    out = {}
    for name, df in tables.items():
        out[name] = "not_connected" if df is None else "written"
        if df is not None:
            write_rows(df, f"{path}/{name}", "csv")
    if found:
        write_rows(union_findings(found), f"{path}/anomalies", "csv")
    return out
