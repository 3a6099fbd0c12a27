"""A leakage-safe training dataset from canonical records and code artifacts, its independent check, and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.functions.text import text_hash
from tarnwick.operators.graph import families
from tarnwick.operators.records import cyclic_pick
from tarnwick.operators.reports import SPLITS, findings
from tarnwick.plans.datasets import chunks
from tarnwick.runtime import materialize

# Severities that count, names of components that say nothing, and what a trajectory needs.
SEVERITIES = ("critical", "high", "medium", "low", "none")
NAMELESS = ("", "n/a", "na", "unknown", "not applicable", "unspecified", "*")
TRAJECTORY = ("schema_version", "task_id", "category", "vulnerability_type", "environment", "precondition", "steps", "success", "blocked", "evidence", "created_at", "is_simulated", "execution_ready")
STEP = ("observation", "action_type", "tool", "input", "result", "blocked", "evidence")
HIDDEN = ("chain_of_thought", "reasoning", "thoughts", "internal_monologue")


def grounded(records: DataFrame) -> DataFrame:
    """Canonical records with label columns that hold only what their sources agree on: severity of the known ones, weaknesses of the form CWE-n, components with names."""
    agreed = lambda f: ~F.array_contains("conflicts", f)
    low = F.lower("severity")
    named = F.filter("components", lambda c: ~F.lower(F.trim(F.coalesce(c["name"], F.lit("")))).isin(*NAMELESS))
    first = F.get(named, F.lit(0))
    return (
        records.withColumn("severity", F.when(agreed("severity") & low.isin(*SEVERITIES), low))
        .withColumn("weaknesses", F.when(agreed("weaknesses"), F.filter("weaknesses", lambda w: w.rlike(r"^CWE-\d+$"))).otherwise(F.expr("cast(array() as array<string>)")))
        .withColumn("component", F.when(agreed("components") & first.isNotNull(), F.lower(F.concat_ws("/", F.trim(F.coalesce(first["vendor"], F.lit(""))), F.trim(first["name"])))))
    )


def linked_families(records: DataFrame, artifacts: DataFrame, links: DataFrame, seed: str, size: int = 2000, overlap: int = 200, least: int = 40) -> DataFrame:
    """vuln_id, family and split of records: families over a shared artifact, equal code, an equal chunk of code and an equal description of `least` characters.

    records: vuln_id, status, description; artifacts: artifact_id, content, review_status; links: artifact_id, vuln_id. Rejected artifacts and records link nothing;
    a link may name an id without a record. An artifact stands in a chunk's group for its least id.
    """
    live = artifacts.filter("review_status <> 'rejected'").select("artifact_id", "content")
    own = links.join(live.select("artifact_id"), "artifact_id", "left_semi").select("artifact_id", "vuln_id").distinct()
    by_content = live.select("artifact_id", text_hash(F.col("content")).alias("h")).join(own, "artifact_id").select("h", "vuln_id")
    heads = own.groupBy("artifact_id").agg(F.min("vuln_id").alias("vuln_id"))
    numbered = live.join(heads, "artifact_id").withColumn("n", F.xxhash64("artifact_id"))
    by_chunk = chunks(numbered, "n", "content", size, overlap).select("n", text_hash(F.col("text")).alias("h")).join(numbered.select("n", "vuln_id"), "n").select("h", "vuln_id")
    described = records.filter((F.col("status") == "active") & (F.length(F.trim("description")) >= least)).select(text_hash(F.trim("description")).alias("h"), "vuln_id")
    return families(records, "vuln_id", [own, by_content, by_chunk, described], seed)


def hard_negatives(records: DataFrame) -> DataFrame:
    """vuln_id, negative and strategy: another family's record of the same split, by a shared weakness (in order), else the component, else the severity.

    records: vuln_id, family, split, weaknesses, component, severity. Each bucket is a circle in order of ids, entered at a place that the id's hash gives. Records
    without a partner give no row.
    """
    named = {"weakness": F.transform("weaknesses", lambda w, i: F.struct(i.alias("at"), w.alias("value"))), "component": F.array(F.struct(F.lit(0).alias("at"), F.col("component").alias("value"))), "severity": F.array(F.struct(F.lit(0).alias("at"), F.col("severity").alias("value")))}
    picks = None
    for place, (kind, values) in enumerate(named.items()):
        rows = records.select("vuln_id", "family", "split", F.explode(values).alias("b")).filter("b.value is not null").select(F.concat_ws("\x1f", "vuln_id", "b.value").alias("row"), "vuln_id", "family", "b.at", F.concat_ws("\x1f", "split", "b.value").alias("bucket"))
        start = F.conv(F.substring(F.sha2(F.concat(F.lit(f"retrieval:{kind}:"), F.col("vuln_id")), 256), 1, 8), 16, 10).cast("long")
        own = rows.select("vuln_id", "row", "family", "bucket").distinct()
        found = cyclic_pick(own.withColumn("start", start), own.select("bucket", F.col("vuln_id"), "family", "row"), "bucket", "vuln_id", "family", F.col("start"), also=["row"])
        found = found.join(rows.select("row", "at"), "row").select("vuln_id", F.col("picked").alias("negative"), F.lit(kind).alias("strategy"), F.struct(F.lit(place).alias("p"), "at").alias("o"))
        picks = found if picks is None else picks.unionByName(found)
    best = picks.groupBy("vuln_id").agg(F.min(F.struct("o", "negative", "strategy")).alias("b"))
    return best.select("vuln_id", "b.negative", "b.strategy")


def sample(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts), 256), 1, 24))


def build(records: DataFrame, artifacts: DataFrame, links: DataFrame, seed: str = "seed", size: int = 2000, overlap: int = 200, least: int = 40) -> dict[str, DataFrame]:
    """The tables of a dataset: knowledge, rag_corpus, sft, retrieval, preference_candidates, preference (empty: nothing is preferred unreviewed) and manifest.

    records: canonical ones with title, description, severity, weaknesses, components, conflicts, aliases. What is written is grounded in agreed source fields; code stays a
    claim. Equal code is one document for all who share it; messages that repeat are kept once.
    """
    fam = materialize(linked_families(records, artifacts, links, seed, size, overlap, least), "families")
    live = grounded(records.filter((F.col("status") == "active") & (F.length(F.trim("description")) >= least))).join(fam, "vuln_id")
    live = materialize(live, "grounded")
    knowledge = live.select(sample("knowledge", F.col("vuln_id")).alias("sample_id"), "vuln_id", "family", "split", "title", "description", "severity", "weaknesses")
    doc = sample("rag", F.lit("description"), F.col("vuln_id"))
    described = live.select(doc.alias("doc_id"), F.array("vuln_id").alias("vuln_ids"), "family", "split", F.lit("description").alias("modality"), F.col("description").alias("text"))
    code = artifacts.filter("review_status <> 'rejected'").join(links, "artifact_id").join(live.select("vuln_id", "family", "split"), "vuln_id")
    shared = code.withColumn("h", text_hash(F.col("content"))).groupBy("h").agg(F.array_sort(F.collect_set("vuln_id")).alias("vuln_ids"), F.min("family").alias("family"), F.min("split").alias("split"), F.min("content").alias("content"), F.min("artifact_id").alias("artifact_id"))
    parts = chunks(shared.withColumn("n", F.xxhash64("h")), "n", "content", size, overlap).withColumn("c", text_hash(F.col("text")))
    own = parts.join(shared.select(F.xxhash64("h").alias("n"), "h", "vuln_ids", "family", "split"), "n").withColumn("rn", F.row_number().over(W.partitionBy("c").orderBy("h", "chunk"))).filter("rn = 1")
    coded = own.select(sample("rag", F.lit("code"), F.col("c")).alias("doc_id"), "vuln_ids", "family", "split", F.lit("poc_code").alias("modality"), "text")
    corpus = described.unionByName(coded).withColumn("content_sha256", text_hash(F.col("text")))
    # two tasks: what the sources say of a record, and which record a piece of code claims
    says = F.to_json(F.struct("vuln_id", "severity", "weaknesses", "component"), {"ignoreNullFields": "false"})
    ask = lambda system, user, answer: F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content"))))
    one = live.select(sample("sft", F.lit("metadata"), F.col("vuln_id")).alias("sample_id"), "vuln_id", "family", "split", F.lit("grounded_metadata_extraction").alias("task"), F.col("weaknesses").alias("labels"), ask("Extract only what the sources assert.", F.concat(F.lit("Evidence:\n"), F.col("description")), says).alias("messages"), says.alias("asserted"))
    claim = F.to_json(F.struct(F.col("vuln_id").alias("vuln_id"), F.lit(False).alias("replay_verified"), F.lit("source_claim").alias("verification_status")))
    two = code.select(sample("sft", F.lit("claim"), F.col("artifact_id"), F.col("vuln_id")).alias("sample_id"), "vuln_id", "family", "split", F.lit("poc_claim_extraction").alias("task"), F.expr("cast(array() as array<string>)").alias("labels"), ask("Name the record that the code claims.", F.substring("content", 1, size), claim).alias("messages"), claim.alias("asserted"))
    sft = one.unionByName(two).withColumn("rn", F.row_number().over(W.partitionBy(F.sha2("messages", 256)).orderBy("sample_id"))).filter("rn = 1").drop("rn")
    negative = hard_negatives(live)
    doc_of = live.select(F.col("vuln_id").alias("negative"), doc.alias("negative_doc"))
    retrieval = live.join(negative, "vuln_id", "left").join(doc_of, "negative", "left").select(
        sample("retrieval", F.col("vuln_id"), F.col("family")).alias("sample_id"), "vuln_id", "family", "split", F.concat_ws(" ", "vuln_id", "title").alias("query"), F.array(doc).alias("positive_doc_ids"),
        F.array_compact(F.array("negative_doc")).alias("hard_negative_doc_ids"), "strategy", F.col("negative").isNotNull().alias("requires_human_review"),
    )
    bucket = F.concat_ws("\x1f", "split", "artifact_type", "language")
    have = code.select("artifact_id", "vuln_id", "family", bucket.alias("bucket"))
    firsts = have.groupBy("vuln_id", "family").agg(F.min(F.struct("artifact_id", "bucket")).alias("a")).select("vuln_id", "family", "a.artifact_id", "a.bucket", F.conv(F.substring(F.sha2(F.concat(F.lit("preference:"), F.col("vuln_id")), 256), 1, 8), 16, 10).cast("long").alias("start"))
    others = have.groupBy("artifact_id", "bucket").agg(F.min("family").alias("family"))
    chosen = cyclic_pick(firsts.withColumnRenamed("artifact_id", "positive"), others, "bucket", "artifact_id", "family", F.col("start"), row="vuln_id")
    candidates = firsts.join(chosen, "vuln_id").join(live.select("vuln_id", "split"), "vuln_id").select(sample("preference", F.col("vuln_id")).alias("sample_id"), "vuln_id", "family", "split", F.col("artifact_id").alias("chosen"), F.col("picked").alias("rejected"), F.lit(False).alias("training_eligible"), F.lit(True).alias("requires_human_review"))
    manifest = sft.select("sample_id", "vuln_id", "family", "split", "labels", F.array(F.lit("sft")).alias("modalities")).unionByName(retrieval.select("sample_id", "vuln_id", "family", "split", F.expr("cast(array() as array<string>)").alias("labels"), F.array(F.lit("retrieval")).alias("modalities")))
    return {"knowledge": knowledge, "rag_corpus": corpus, "sft": sft, "retrieval": retrieval, "preference_candidates": candidates, "preference": candidates.limit(0), "manifest": manifest.withColumn("weight", F.lit(1.0))}


def check(tables: dict[str, DataFrame]) -> DataFrame:
    """table, kind and n of what forbids a dataset's publication, found from its tables alone; no rows: none."""
    out = None

    def add(table: str, kind: str, rows: DataFrame) -> None:
        nonlocal out
        own = rows.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(table).alias("table"), F.lit(kind).alias("kind"), "n")
        out = own if out is None else out.unionByName(own)

    for name, t in tables.items():
        key = "doc_id" if name == "rag_corpus" else "sample_id"
        add(name, "duplicate_id", t.groupBy(key).count().filter("count > 1"))
        add(name, "invalid_split", t.filter(~F.col("split").isin(*SPLITS) | F.col("split").isNull()))
    placed = [t.select("family", "split", F.col("vuln_ids") if "vuln_ids" in t.columns else F.array("vuln_id").alias("vuln_ids")) for t in tables.values()]
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    leaks = lambda rows, by: rows.groupBy(by).agg(F.countDistinct("split").alias("s")).filter("s > 1")
    add("all", "family_leak", leaks(every, "family"))
    add("all", "vulnerability_leak", leaks(every.select(F.explode("vuln_ids").alias("v"), "split"), "v"))
    corpus = tables["rag_corpus"]
    add("rag_corpus", "content_leak", leaks(corpus, "content_sha256"))
    add("rag_corpus", "wrong_content_hash", corpus.filter(F.col("content_sha256") != text_hash(F.col("text"))))
    refs = tables["retrieval"].select("split", F.explode(F.concat("positive_doc_ids", "hard_negative_doc_ids")).alias("doc_id")).join(corpus.select("doc_id", F.col("split").alias("s")), "doc_id", "left")
    add("retrieval", "missing_document", refs.filter("s is null"))
    add("retrieval", "document_of_another_split", refs.filter("s <> split"))
    sft = tables["sft"]
    answer = F.element_at(F.from_json("messages", "array<struct<role:string,content:string>>"), -1)["content"]
    add("sft", "unsupported_target", sft.filter((F.col("task") == "grounded_metadata_extraction") & (answer != F.col("asserted"))))
    add("sft", "unsupported_replay_claim", sft.filter((F.col("task") == "poc_claim_extraction") & (F.get_json_object(answer, "$.replay_verified") == "true") & (F.get_json_object(answer, "$.verification_status") != "sandbox_verified")))
    loose = tables["preference_candidates"]
    add("preference_candidates", "not_quarantined", loose.filter("training_eligible or not requires_human_review"))
    formal = sft.select("sample_id").unionByName(tables["retrieval"].select("sample_id"))
    add("manifest", "not_of_a_table", tables["manifest"].join(formal, "sample_id", "left_anti"))
    add("manifest", "lacks_a_sample", formal.join(tables["manifest"], "sample_id", "left_anti"))
    add("manifest", "names_a_candidate", tables["manifest"].join(loose, "sample_id", "left_semi"))
    return out


def publish_all(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes tables into a folder beside path, reads and checks what was written, and only then renames it to path, which must not be there.

    Returns table, rows and fingerprint of each, which manifest.json in the folder has as well.
    """
    import json
    import uuid

    from tarnwick.functions.canonical import fingerprint

    spark = next(iter(tables.values())).sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, staging = hadoop.Path(path), f"{path}.{uuid.uuid4().hex}"
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ValueError(f"{path} exists")
    try:
        for name, t in tables.items():
            t.write.parquet(f"{staging}/{name}")
        written = {name: spark.read.schema(t.schema).parquet(f"{staging}/{name}") for name, t in tables.items()}
        found = check(written).collect()
        if found:
            raise ValueError(f"not published: {[tuple(r) for r in found]}")
        facts = [(name, *fingerprint(t.withColumn("tw_row", F.to_json(F.struct(*t.columns))), "doc_id" if name == "rag_corpus" else "sample_id", "tw_row").first()) for name, t in written.items()]
        out = files.create(hadoop.Path(f"{staging}/manifest.json"))
        out.write(bytearray(json.dumps({n: {"rows": r, "fingerprint": f} for n, r, f in facts}, sort_keys=True).encode()))
        out.close()
        if not files.rename(hadoop.Path(staging), target):
            raise ValueError(f"{path} could not be made")
    finally:
        files.delete(hadoop.Path(staging), True)
    return spark.createDataFrame(facts, "table string, rows long, fingerprint string")


def export_by(rows: DataFrame, path: str, by: str, key: str) -> DataFrame:
    """Writes rows in a folder for each value of by, never over what is there, and returns value and n as read back; ids that repeat are refused."""
    if rows.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError("ids repeat")
    rows.write.partitionBy(by).mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(by).agg(F.count("*").alias("n"))


def trajectory_findings(lines: DataFrame, schema: str, categories: tuple[str, ...]) -> DataFrame:
    """line and kind of what is wrong with trajectories (line, value: JSON text)."""
    v = lines.select("line", F.expr("try_parse_json(value)").alias("j"), "value")
    get = lambda path, kind="string": F.expr(f"try_variant_get(j, '$.{path}', '{kind}')")
    keys = F.coalesce(F.json_object_keys("value"), F.expr("cast(array() as array<string>)"))
    steps = F.from_json(F.get_json_object("value", "$.steps"), "array<string>")
    events = F.from_json(F.get_json_object("value", "$.runtime_events"), "array<struct<timestamp:string,type:string>>")
    typed = lambda f: F.expr(f"schema_of_variant(variant_get(j, '$.{f}', 'variant'))")
    lacks = lambda names, have: F.size(F.array_except(F.array(*map(F.lit, names)), have)) > 0
    step_keys = lambda s: F.coalesce(F.json_object_keys(s), F.expr("cast(array() as array<string>)"))
    broken = F.col("j").isNull()
    return findings(v, ["line"], {
        "invalid_json": broken, "hidden_reasoning": ~broken & (F.arrays_overlap(keys, F.array(*map(F.lit, HIDDEN))) | F.exists(steps, lambda s: F.arrays_overlap(step_keys(s), F.array(*map(F.lit, HIDDEN))))),
        "missing_fields": ~broken & lacks(TRAJECTORY, keys), "unsupported_schema": get("schema_version") != schema, "invalid_task_id": ~get("task_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{5,127}$"),
        "unsupported_category": ~get("category").isin(*categories), "empty_type": F.trim(get("vulnerability_type")) == "", "not_authorized": ~broken & (F.coalesce(F.get_json_object("value", "$.environment.authorized"), F.lit("")) != "true"),
        **{f"not_boolean:{f}": F.array_contains(keys, f) & (typed(f) != "BOOLEAN") for f in ("success", "blocked", "is_simulated", "execution_ready")},
        "simulated_but_ready": get("execution_ready", "boolean") & get("is_simulated", "boolean"), "no_steps": F.array_contains(keys, "steps") & (F.coalesce(F.size(steps), F.lit(0)) == 0),
        "incomplete_step": F.exists(steps, lambda s: lacks(STEP, step_keys(s)) | ~F.get_json_object(s, "$.blocked").isin("true", "false") | ~F.startswith(F.coalesce(F.get_json_object(s, "$.evidence"), F.lit("")), F.lit("["))),
        "evidence_no_array": F.array_contains(keys, "evidence") & ~F.startswith(F.coalesce(F.get_json_object("value", "$.evidence"), F.lit("")), F.lit("[")), "incomplete_event": F.exists(events, lambda e: F.coalesce(e["timestamp"] == "", F.lit(True)) | F.coalesce(e["type"] == "", F.lit(True))),
    })


def trajectory_messages(rows: DataFrame) -> DataFrame:
    """task_id, input and output, as JSON text, of trajectories (task_id, category, vulnerability_type, precondition, steps, success, blocked, evidence, is_simulated): what is seen, and how it ended."""
    asked = F.to_json(F.struct("category", "precondition", "steps", "task_id", "vulnerability_type"))
    said = F.to_json(F.struct("blocked", "evidence", "is_simulated", "success"))
    return rows.select("task_id", asked.alias("input"), said.alias("output"))


def acceptance(rows: DataFrame, methods: list[str], obstacles: list[str], phases: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """Counts of every method and obstacle, zeros as well, and one row of gates, accepted if all of them hold.

    rows: method, obstacle, success, complete, recovered, actions (array), reasoning, synthetic.
    """
    spark = rows.sparkSession
    cells = spark.createDataFrame([(m, o) for m in methods for o in obstacles], "method string, obstacle string")
    n = rows.groupBy("method", "obstacle").agg(F.count("*").alias("n"))
    matrix = cells.join(n, ["method", "obstacle"], "left").select("method", "obstacle", F.coalesce("n", F.lit(0)).alias("n"))
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))
    chain = F.col("complete") & (F.col("actions") == F.array(*map(F.lit, phases)))
    g = rows.agg(F.count("*").alias("rows"), every(F.col("success")).alias("all_succeeded"), every(chain).alias("all_chains_complete"), every(F.col("recovered")).alias("all_obstacles_processed"), every(~F.col("reasoning")).alias("no_internal_reasoning"), every(F.col("synthetic")).alias("synthetic"), F.array_sort(F.collect_set("method")).alias("m"), F.array_sort(F.collect_set("obstacle")).alias("o"))
    g = g.crossJoin(matrix.agg(F.bool_and(F.col("n") > 0).alias("every_pair_present")))
    g = g.select("rows", (F.col("rows") >= least).alias("minimum_met"), (F.col("m") == F.array(*map(F.lit, sorted(methods)))).alias("methods_present"), (F.col("o") == F.array(*map(F.lit, sorted(obstacles)))).alias("obstacles_present"), "all_succeeded", "all_chains_complete", "all_obstacles_processed", "no_internal_reasoning", "synthetic", "every_pair_present")
    gates = [c for c in g.columns if c != "rows"]
    return matrix, g.withColumn("accepted", F.expr(" and ".join(gates)))


def scenario_grid(spark: SparkSession, count: int, types: list[tuple[str, str]], variants: list[str], obstacles: list[str], seed: str) -> DataFrame:
    """Metadata of count scenarios, dealt evenly over types, then variants, then obstacles, each with an id that its place and the seed give. Nothing is run."""
    if count < len(types):
        raise ValueError("count must cover every type")
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    d = spark.range(count).select((F.col("id") % len(types)).alias("t"), F.floor(F.col("id") / len(types)).alias("case_index"))
    d = d.select(at([c for c, _ in types], F.col("t")).alias("category"), at([n for _, n in types], F.col("t")).alias("vulnerability_type"), "case_index")
    mark = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "vulnerability_type", F.col("case_index").cast("string")), 256), 1, 24)
    return d.select(F.concat_ws(":", F.lit("docker-lab"), "vulnerability_type", F.lpad(F.col("case_index").cast("string"), 4, "0"), F.substring(mark, 1, 8)).alias("scenario_id"), "*", at(variants, F.col("case_index") % len(variants)).alias("variant"), at(obstacles, F.floor(F.col("case_index") / len(variants)) % len(obstacles)).alias("obstacle"), mark.alias("canary"))
