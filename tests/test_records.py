"""Merge, components, evidence, families, datasets, reports, search and index on small fixtures with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwick.functions import canonical as C
from tarnwick.functions import text as T
from tarnwick.operators import embedding as E
from tarnwick.operators import graph as G
from tarnwick.operators import merge as M
from tarnwick.operators import records as R
from tarnwick.operators import reports as P
from tarnwick.operators import retrieval as S
from tarnwick.plans import builder as B
from tarnwick.plans import datasets as D
from tarnwick.runtime import end_run, materialize, ship
from tarnwick.sources import records as S_
from tarnwick.streaming import incremental as I


def source(spark, rows):
    return spark.createDataFrame([tuple({"source": "nvd", "status": "active", "aliases": [], "components": [], "weaknesses": [], "refs": [], **r}.get(c) for c in S_.COLUMNS) for r in rows], S_.RECORD)


def test_merge_of_the_demo(spark):
    ship(spark)
    demo = S_.demo_records(spark)
    got = {r.vuln_id: r for r in M.canonical_records(demo).collect()}
    assert set(got) == {"CVE-2099-1001", "CVE-2099-1002", "CVE-2099-1003"}
    one = got["CVE-2099-1001"]
    assert one.fields["severity"] == "high" and one.conflicts == ["severity"] and one.field_states["poc"] == "missing" and len(one.sources) == 3
    again = {r.vuln_id: r.revision for r in M.canonical_records(demo.orderBy(F.desc("source_id")).repartition(3)).collect()}
    assert again == {k: r.revision for k, r in got.items()}
    said = [(x.source, x.value) for x in M.merged_fields(demo).filter("vuln_id = 'CVE-2099-1001' and field = 'severity'").first().provenance]
    assert said == [("cve", "high"), ("cnnvd", "medium")]
    assert M.canonical_records(demo.limit(0)).collect() == []


def test_merge_rejects_and_carries_open_fields(spark):
    rows = [{"source": "cve", "source_id": "CVE-2024-0001", "aliases": ["CVE-2024-0001"], "status": "rejected"}, {"source_id": "CVE-2024-0001", "aliases": ["cve-2024-0001"], "title": "t", "extra": {"own": "1"}}, {"source": "avd", "source_id": "A-1", "status": "rejected"}]
    got = {r.vuln_id: r for r in M.canonical_records(source(spark, rows)).collect()}
    assert got["CVE-2024-0001"].status == "rejected" and got["CVE-2024-0001"].fields == {"title": "t", "own": "1"} and got["CVE-2024-0001"].field_states["own"] == "present"
    assert got["AVD:A-1"].status == "rejected" and got["AVD:A-1"].fields == {}
    odd = source(spark, [{"source": "x", "source_id": "", "aliases": ["CVE-2024-0001", "CVE-2024-0002"]}])
    assert {r.kind for r in M.rejects(odd).collect()} == {"unknown_source", "missing_id", "several_identities"}


def test_component_clusters(spark):
    ship(spark)
    part = lambda **k: {"vendor": "Acme", "name": "Widget", "versions": "[]", "default_status": None, "purl": None, "cpes": [], **k}
    alike = [{"source": "cve", "source_id": "CVE-2024-0001", "components": [part(purl="pkg:pypi/widget@1.0", versions='[{"version":"1"}]')]}, {"source_id": "CVE-2024-0001", "components": [part(cpes=["cpe:2.3:a:acme:widget:1:*:*:*:*:*:*:*"])]}]
    got = M.resolved_components(source(spark, alike)).collect()
    assert len(got) == 2 or (len(got) == 1 and got[0].basis == "purl")
    one = [{"aliases": ["CVE-2024-0001"], **r} for r in alike]
    got = M.resolved_components(source(spark, one)).collect()
    assert [(r.basis, r.confidence, r.purls, r.cpes, r.versions) for r in got] == [("purl", "high", ["pkg:pypi/widget"], ["cpe:2.3:a:acme:widget"], '[{"version":"1"}]')]
    apart = [{"aliases": ["CVE-2024-0001"], "source_id": "a", "components": [part(purl="pkg:pypi/widget"), part(purl="pkg:npm/widget"), part(name="", vendor="")]}]
    got = M.resolved_components(source(spark, apart)).collect()
    assert sorted(r.basis for r in got) == ["purl", "purl", "unresolved"]
    assert any(f.startswith("conflicting_component_identifiers") for r in got for f in r.findings)


def test_segments_and_alignment(spark):
    ship(spark)
    text = "see\n```python\nimport socket\n```\n<pre class=x><code>a &lt; b</code></pre> ![alt](u.png 't')"
    got = C.segments(text)
    assert [(s["modality"], s["text"]) for s in got] == [("text", text), ("code", "import socket\n"), ("code", "a < b"), ("image_reference", "alt")]
    assert all(text[s["start"] : s["end"]] for s in got) and got[1]["behaviours"] == ["network"] and text[got[1]["start"] : got[1]["end"]] == "import socket\n"
    assert C.segments(None) == C.segments("  ") == []
    found = C.evidence(spark.createDataFrame([("cve", "1", text, None), ("cve", "2", None, "x = 1")], "source string, source_id string, description string, poc string"))
    counts = {(r.facet, r.name): r.n for r in C.alignment(found).collect()}
    assert counts["modality", "code"] == 3 and counts["finding", "unverified_evidence"] == 1 and counts["behaviour", "network"] == 1


def test_small_functions(spark):
    ship(spark)
    row = spark.range(1).select(
        T.purl_coordinate(F.lit("pkg:PyPI/%41bc@1.0?x=1#y")).alias("purl"), T.purl_coordinate(F.lit("widget")).alias("none"), T.entity_token(F.lit("ＡＢＣ d-é漏")).alias("token"), T.cpe_coordinate(F.lit("cpe:2.3:a:Ac-me:Wid get:1:*")).alias("cpe"),
        T.yaml_scalar(F.lit("id: 'x-1'\ninfo:\n  name: \"A b\"\n"), "name").alias("yaml"), T.iso(T.to_utc(F.lit("2024-05-01 10:00:00"), "+08:00")).alias("stamp"), T.iso(T.to_utc(F.lit("2024-05-01T10:00:00Z"))).alias("utc"), T.to_utc(F.lit("soon")).alias("odd"),
        T.risk_hints(F.lit("Kernel bug: Denial of Service")).alias("risks"), T.record_path(F.lit("cve-2024-12345")).alias("path"), T.trace_event(F.lit('1.5 openat(3, "x") = -2 ENOENT')).alias("call"), T.trace_event(F.lit("1.5 +++ exited with 0 +++")).alias("exit"), T.trace_event(F.lit("noise")).alias("noise"),
    ).first()
    assert (row.purl, row.none, row.token, row.cpe, row.yaml) == ("pkg:pypi/abc", None, "abcd漏", "cpe:2.3:a:acme:widget", "A b")
    assert (row.stamp, row.utc, row.odd) == ("2024-05-01T02:00:00.000Z", "2024-05-01T10:00:00.000Z", None)
    assert row.risks == ["kernel_requires_separate_pool", "availability_impact"] and row.path == "2024/12xxx/CVE-2024-12345.json"
    assert (row.call.type, row.call.name, row.call.return_code) == ("syscall", "openat", -2) and row.exit.type == "exit" and row.noise.type is None
    assert C.canonical({"b": 1.5, "a": "é"}) == '{"a":"é","b":1.5}' and C.sample_id("x", 1) == C.sample_id("x", 1) != C.sample_id("x", 2)
    lists = spark.createDataFrame([(1, ['"u"', '{"b":1,"a":2}', '"a"', '"u"', '{"a":2, "b":1}']), (2, None), (3, [])], "k int, v array<string>")
    assert [r.d for r in lists.select("k", C.distinct_json("v").alias("d")).orderBy("k").collect()] == [['"u"', '{"b":1,"a":2}', '"a"'], None, []]
    prints = lambda rows: C.fingerprint(spark.createDataFrame(rows, "k string, r string"), "k", "r").first()
    assert prints([("a", "1"), ("b", "2")]) == prints([("b", "2"), ("a", "1")]) != prints([("a", "2"), ("b", "1")])


def artifact(n, content, cves, review="candidate"):
    return (f"a{n}", content, review, "exploit_code", "python"), [(f"a{n}", c) for c in cves]


def dataset(spark, records, artifacts):
    rows = [(*r, "active", "title", "high", ["CWE-79"], [], [("v", "widget")]) for r in records]
    records = spark.createDataFrame(rows, "vuln_id string, description string, status string, title string, severity string, weaknesses array<string>, conflicts array<string>, components array<struct<vendor:string,name:string>>")
    arts = spark.createDataFrame([a for a, _ in artifacts], "artifact_id string, content string, review_status string, artifact_type string, language string")
    return records, arts, spark.createDataFrame([x for _, ls in artifacts for x in ls], "artifact_id string, vuln_id string")


LONG = "A description of record {} that is long enough for the dataset to take."


def test_chain_of_links_is_one_family(spark):
    ship(spark)
    ids = [f"CVE-2026-900{i}" for i in range(3)]
    r, a, links = dataset(spark, [(ids[0], LONG.format("x")), (ids[1], LONG.format("x")), (ids[2], LONG.format("y"))], [artifact(1, "print(1)", ids[1:])])
    got = B.linked_families(r, a, links, "seed").collect()
    assert {x.family for x in got} == {ids[0]} and len({x.split for x in got}) == 1
    tables = B.build(r, a, links)
    assert tables["retrieval"].filter("requires_human_review").count() == 0 and tables["preference"].count() == 0
    assert B.check(tables).collect() == []
    one = B.linked_families(r.limit(1), a, links, "seed").collect()
    assert [(x.vuln_id, x.family) for x in one] == [(ids[0], ids[0])]


def test_dataset_of_three_records(spark, tmp_path):
    ship(spark)
    split = lambda i: spark.range(1).select(T.split_bucket(F.lit(i), "seed").alias("s")).first().s
    ids = [i for i in (f"CVE-2026-9{n:03d}" for n in range(40)) if split(i) == "train"][:3]
    r, a, links = dataset(spark, [(i, LONG.format(i)) for i in ids], [artifact(n, f"# number {n}\nprint('not run')", [i]) for n, i in enumerate(ids)] + [artifact(9, "# rejected", [ids[0]], "rejected")])
    tables = {k: materialize(t, k) for k, t in B.build(r, a, links).items()}
    assert {k: t.count() for k, t in tables.items()} == {"knowledge": 3, "rag_corpus": 6, "sft": 6, "retrieval": 3, "preference_candidates": 3, "preference": 0, "manifest": 9}
    assert tables["retrieval"].filter("requires_human_review and strategy = 'weakness'").count() == 3
    assert all(x.chosen != x.rejected for x in tables["preference_candidates"].collect())
    assert P.manifest_findings(tables["manifest"].withColumn("line", F.monotonically_increasing_id()).withColumnRenamed("family", "family_id")).collect() == []
    written = {x.table: x.rows for x in B.publish_all(tables, str(tmp_path / "set")).collect()}
    assert written["sft"] == 6 and (tmp_path / "set" / "manifest.json").exists()
    with pytest.raises(ValueError, match="exists"):
        B.publish_all(tables, str(tmp_path / "set"))
    bad = tables | {"retrieval": tables["retrieval"].withColumn("split", F.lit("test")), "rag_corpus": tables["rag_corpus"].withColumn("content_sha256", F.lit("x"))}
    assert {"document_of_another_split", "wrong_content_hash", "family_leak", "vulnerability_leak"} <= {x.kind for x in B.check(bad).collect()}
    with pytest.raises(ValueError, match="not published"):
        B.publish_all(bad, str(tmp_path / "bad"))
    assert [p.name for p in tmp_path.iterdir()] == ["set"]


def test_families_against_plain_union_find(spark):
    rng = np.random.default_rng(3)
    shared = [[(int(g), int(n)) for g, n in zip(rng.integers(0, 60, 80), rng.integers(0, 120, 80), strict=True)] for _ in range(2)]
    above = {n: n for n in range(120)}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for rows in shared:
        by = {}
        for g, n in rows:
            a, b = sorted((root(by.setdefault(g, n)), root(n)))
            above[b] = a
    got = G.families(spark.range(120).withColumnRenamed("id", "n"), "n", [spark.createDataFrame(rows, "g long, n long") for rows in shared], "s")
    assert {r.n: r.family for r in got.collect()} == {n: root(n) for n in range(120)}


def test_jaccard_pairs(spark):
    rng = np.random.default_rng(4)
    sets = {i: sorted({f"t{x}" for x in rng.integers(0, 12, rng.integers(1, 9))}) for i in range(60)} | {60: [], 61: None}
    got = {(r.left, r.right): r.score for r in G.jaccard_pairs(spark.createDataFrame(list(sets.items()), "k long, t array<string>"), "k", "t", 65).collect()}
    head = {}
    for i, t in sets.items():
        if t:
            head.setdefault(tuple(t), i)
    heads = sorted(head.values())
    want = {(a, b): s for a in heads for b in heads if a < b and (s := len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))) >= 0.65}
    want |= {(head[tuple(t)], i): 1.0 for i, t in sets.items() if t and head[tuple(t)] != i}
    assert got == pytest.approx(want) and len(want) > 5
    labels = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["c"]), (4, []), (5, ["b"])], "k long, s array<string>")
    assert [tuple(r) for r in G.pairs_of_disjoint_labels(labels, "k", "s", 3).collect()] == [(1, 3), (1, 5), (2, 3)]


def test_training_report(spark):
    shape = "run_id string, file string, line int, step double, loss double, eval_loss double, grad_norm double, throughput double, dataset_version string, model_version string, status string"
    flat = [("r", "a", i, float(i), 1.0, [1.0, 0.8, 0.9][i] if i < 3 else None, [1.0, 2.0, 500.0][i] if i < 3 else -7.0, 100.0 if i < 3 else 10.0, "v1" if i < 4 else "v2", "m", "running" if i < 6 else "failed") for i in range(7)]
    one = P.training_report(spark.createDataFrame(flat, shape)).first()
    assert one.findings.split(",") == ["eval_regression", "dataset_version_changed", "run_interrupted", "gradient_spike", "throughput_collapse"]
    assert (one.best_step, one.best_eval, one.last_eval, one.final_gap, one.last_status, one.loss_change_std) == (1.0, 0.8, 0.9, -0.1, "failed", 0.0)
    odd = spark.createDataFrame([("r", "a", 1, 2.0, float("nan"), None, -1.0, None, None, None, "odd"), ("r", "a", 2, 1.0, 1.0, None, None, None, None, None, None), ("r", "b", 1, -1.0, 1.0, None, None, None, None, None, "")], shape)
    assert sorted(r.kind for r in P.log_findings(odd).collect()) == ["invalid_metric:loss", "invalid_run_status", "invalid_step", "negative_metric:grad_norm", "non_increasing_step", "non_increasing_step"]
    assert P.training_report(odd).count() == 1 and P.training_report(odd.limit(0)).count() == 0


def test_effect_report(spark):
    shape = "line int, variant string, task string, metric string, direction string, seed string, dataset_version string, value double"
    rows = [(1, "baseline", "t", "error", "minimize", "1", "d", 9.0), (2, "baseline", "t", "error", "minimize", "1", "d", 0.4), (3, "baseline", "t", "error", "minimize", "2", "d", 0.5), (4, "new", "t", "error", "minimize", "1", "d", 0.3), (5, "new", "t", "error", "minimize", "2", "d", 0.4), (6, "new", "t", "error", "minimize", "3", "d", None), (7, "", "t", "", "up", "1", "d", 1.0)]
    log = spark.createDataFrame(rows, shape)
    r = P.effect_report(log).collect()
    assert [(x.pairs, x.mean_delta, x.outcome, x.evidence) for x in r] == [(2, 0.1, "improved", "repeated_pairs")]
    assert sorted((x.line, x.kind) for x in P.effect_findings(log).collect()) == [(2, "duplicate_effect_observation"), (6, "invalid_effect_value"), (7, "invalid_direction"), (7, "missing_metric"), (7, "missing_variant")]


def test_manifest_and_bundle(spark, tmp_path):
    shape = "line int, sample_id string, vuln_id string, family_id string, split string, labels array<string>, modalities array<string>, weight double"
    rows = [(1, "s1", "v1", "f1", "train", ["common"], ["text"], 1.0), (2, "s1", "v1", "f1", "test", ["common", "rare"], ["text"], 1.0), (3, "s2", "v9", "f2", "train", ["common"], ["text"], 1.0), (4, None, "v1", None, "dev", None, [""], float("nan"))]
    m = spark.createDataFrame(rows, shape)
    found = P.manifest_findings(m, spark.createDataFrame([("v1",)], "id string"))
    assert sorted(r.kind for r in found.collect()) == ["duplicate_sample_id", "family_split_leakage", "invalid_labels", "invalid_modalities", "invalid_split", "invalid_weight", "missing_sample_id", "unknown_vulnerability", "vulnerability_split_leakage"]
    assert [r.name for r in P.manifest_counts(m, 0.4).filter("facet = 'label' and rare").collect()] == ["rare"]
    out = P.write_bundle({"manifest": P.manifest_counts(m), "effects": None}, {"manifest": found, "other": spark.createDataFrame([("x", 3)], "kind string, line int")}, str(tmp_path / "b"))
    assert out == {"manifest": "written", "effects": "not_connected"}
    back = spark.read.option("header", True).csv(str(tmp_path / "b" / "anomalies"))
    assert set(back.columns) == {"kind", "subject", "scope", "line"} and back.count() == 10
    P.write_rows(m, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_search_over_channels(spark):
    ship(spark)
    views = [("r1", "description", "path traversal in archives", [1.0, 0.0]), ("r1", "component", "archive tool", [0.0, 1.0]), ("r2", "description", "scripting in pages", [0.0, 1.0]), ("r3", "aggregate", "nothing alike", [-1.0, 0.0])]
    v = spark.createDataFrame(views, "id string, view string, text string, vector array<double>")
    q = spark.createDataFrame([("q", "query", "path traversal", [1.0, 0.0]), ("q", "component", "archive", [0.0, 1.0])], "query_id string, channel string, text string, vector array<double>")
    s = S.channel_scores(v, q, "id")
    got = {r.id: r for r in s.collect()}
    assert got["r1"].dense == pytest.approx(1.0) and got["r2"].dense == pytest.approx(0.0) and got["r1"].best_views == ["component:component", "query:description"]
    assert [r.id for r in S.fused_hits(s, "id").orderBy("rank").collect()] == ["r1"]
    assert S.fused_hits(s, "id", least=0.99).count() == 1 and S.fused_hits(s, "id", mode="sparse", least=1.0).count() in (0, 1)
    named = spark.createDataFrame([("q", "r1")], "query_id string, id string")
    assert S.fused_hits(s, "id", named=named).first().id == "r1"
    hits = S.fused_hits(s, "id")
    evidence = spark.createDataFrame([("r1", "e1", "no"), ("r1", "e2", "path " * 200), ("r1", "e3", "traversal path")], "id string, evidence_id string, text string")
    one = S.hits_with_evidence(hits, v.filter("view = 'description'").select("id", "text"), evidence, q, "id").first()
    assert one.evidence[0] == "traversal path" and len(one.evidence[1]) == 600 and one.matched_terms == ["path", "traversal"]
    assert S.pool_size(0, 10) == 2000 and S.pool_size(20_000, 10) == 12_000


def test_filters_by_version_and_names(spark):
    ship(spark)
    rules = json.dumps([{"version": "1.0.0", "lessThan": "1.2.0", "versionType": "semver", "status": "affected"}])
    tree = json.dumps([{"nodes": [{"operator": "OR", "cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:acme:widget:*:*:*:*:*:*:*:*"}]}]}])
    rows = [("a", "low", [("v", "Widget", rules, "unaffected", None, [])], [], tree), ("b", "high", [("v", "other", "[]", None, None, [])], [], None), ("c", "low", [("v", "widget", rules, "unaffected", None, [])], ["components"], tree)]
    r = spark.createDataFrame(rows, "id string, severity string, components array<struct<vendor:string,name:string,versions:string,default_status:string,purl:string,cpes:array<string>>>, conflicts array<string>, applicability string")
    ids = lambda **k: sorted(x.id for x in S.Filters(**k).applied(r).collect())
    assert ids(component="widget") == ["a", "c"] and ids(component="WIDGET", version="1.1.9") == ["a"] and ids(component="widget", version="1.2.0") == []
    assert ids(cpes=("cpe:2.3:a:acme:widget:1:*:*:*:*:*:*:*",)) == ["a", "c"] and ids(severity="HIGH") == ["b"]
    for bad in ({"version": "1"}, {"cpes": ("x",)}):
        with pytest.raises(ValueError, match=r"component|CPE"):
            S.Filters(**bad)


def test_index_keeps_up(spark):
    ship(spark)

    class Lengths:
        manifest = {"model": "lengths", "dimension": 2}

        def encode(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    records = spark.createDataFrame([("a", "1", "active", ["x"]), ("b", "2", "active", ["y"]), ("c", "1", "rejected", ["z"])], "vuln_id string, revision string, status string, weaknesses array<string>")
    views = spark.createDataFrame([("a", "description", "text a"), ("b", "description", "text b"), ("b", "poc", "code")], "vuln_id string, view string, text string")
    model = E.model_id(Lengths())
    shape = "vuln_id string, revision string, view string, model_id string, text string, vector array<double>"
    index = spark.createDataFrame([("a", "1", "description", model, "text a", [6.0, 1.0]), ("b", "1", "description", model, "old", [3.0, 1.0])], shape)
    todo = E.outdated(records, index, model)
    assert [r.vuln_id for r in todo.collect()] == ["b"]
    s = E.index_status(records, index, views, model).first()
    assert (s.active, s.indexed, s.missing, s.stale, s.vectors) == (2, 1, 0, 1, 2)
    fresh = E.encoded(todo.join(views, "vuln_id").select("vuln_id", "revision", "view", F.lit(model).alias("model_id"), "text"), "text", Lengths, 2)
    after = E.refreshed(index, fresh, records)
    assert after.count() == 3 and E.index_status(records, after, views, model).first().indexed == 2
    assert [(r.relation, r.right) for r in E.positive_pairs(views).collect()] == [("description_to_poc", "code")]
    assert [(r.left, r.right) for r in E.negative_pairs(records, views).collect()] == [("text a", "text b")]
    lines = spark.createDataFrame([(1, '{"left":"a","right":"b","label":1}'), (2, "{"), (3, '{"left":"","right":"b","label":0}'), (4, '{"left":"a","right":"b","label":2}')], "line int, value string")
    good, bad = E.read_pairs(lines)
    assert [(r.line, r.label, r.relation) for r in good.collect()] == [(1, 1, "unspecified")]
    assert sorted((r.line, r.kind) for r in bad.collect()) == [(2, "invalid_json"), (3, "missing_text"), (4, "invalid_label")]


def test_adapter_and_classes(spark):
    a, b = np.array([[1.0, 0.5], [1.0, 0.5]]), np.array([[1.0, -0.5], [-1.0, 0.5]])
    weights, losses = E.fit_adapter(a, b, np.array([1, 0]), epochs=4)
    assert len(losses) == 4 and losses[-1] < losses[0] and weights[0] > weights[1]
    v = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, [0.0, 1.0], "y")], "id long, v array<double>, label string")
    got = E.classify(v, v, "id", "v", "label", 1).orderBy("id").collect()
    assert [(r.label, r.support, r.examples) for r in got] == [("x", 2, [1, 2])] * 2 + [("y", 1, [3])]
    c = G.cohesion(v.join(E.classify(v, v, "id", "v", "label", 1).select("id", "score"), "id"), "label", "id", F.col("score")).orderBy("label").collect()
    assert [(r.label, r.size) for r in c] == [("x", 2), ("y", 1)]
    assert [k for k, _ in R.nth_rows(spark.range(100).select(F.col("id").alias("key"), F.lit(1).alias("v")).repartition(5), "key", [0, 49, 99])] == [0, 49, 99]


def test_trajectories(spark):
    whole = {"schema_version": "s1", "task_id": "task-001", "category": "web", "vulnerability_type": "xss", "environment": {"kind": "lab", "authorized": True}, "precondition": "none", "steps": [{"observation": "o", "action_type": "a", "tool": "t", "input": "i", "result": "r", "blocked": False, "evidence": []}], "success": True, "blocked": False, "evidence": [], "created_at": "2024", "is_simulated": True, "execution_ready": False}
    cases = {1: {}, 2: {"task_id": "x"}, 3: {"thoughts": "t"}, 4: {"success": "yes"}, 5: {"execution_ready": True}, 6: {"steps": []}, 7: {"steps": [{"observation": "o"}]}, 8: {"environment": {"kind": "lab"}}, 9: {"runtime_events": [{"type": "x"}]}, 10: {"category": "odd"}}
    lines = [(n, json.dumps({**whole, **c})) for n, c in cases.items()] + [(11, "{"), (12, json.dumps({k: v for k, v in whole.items() if k != "evidence"}))]
    got = {}
    for r in B.trajectory_findings(spark.createDataFrame(lines, "line int, value string"), "s1", ("web",)).collect():
        got.setdefault(r.line, set()).add(r.kind)
    assert got == {2: {"invalid_task_id"}, 3: {"hidden_reasoning"}, 4: {"not_boolean:success"}, 5: {"simulated_but_ready"}, 6: {"no_steps"}, 7: {"incomplete_step"}, 8: {"not_authorized"}, 9: {"incomplete_event"}, 10: {"unsupported_category"}, 11: {"invalid_json"}, 12: {"missing_fields"}}
    rows = spark.createDataFrame([("m", "o", True, True, True, ["a"], False, True)], "method string, obstacle string, success boolean, complete boolean, recovered boolean, actions array<string>, reasoning boolean, synthetic boolean")
    matrix, gates = B.acceptance(rows, ["m"], ["o", "p"], ["a"], 1)
    assert sorted((r.obstacle, r.n) for r in matrix.collect()) == [("o", 1), ("p", 0)] and not gates.first().accepted and gates.first().all_chains_complete
    assert B.acceptance(rows, ["m"], ["o"], ["a"], 1)[1].first().accepted
    types = [("c", f"t{i}") for i in range(10)]
    grid = B.scenario_grid(spark, 1500, types, [f"v{i}" for i in range(6)], [f"o{i}" for i in range(5)], "seed")
    assert {r["count"] for r in grid.groupBy("vulnerability_type").count().collect()} == {150}
    assert {r["count"] for r in grid.groupBy("vulnerability_type", "obstacle").count().collect()} == {30}
    assert grid.select("scenario_id").distinct().count() == 1500


def test_importers(spark, tmp_path):
    ship(spark)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.yaml").write_text("id: one\ninfo:\n  name: First\n  severity: high\n# cve-2024-0001 CVE-2024-0002 CVE-2024-0001\n")
    (tmp_path / "t" / "two.yml").write_text("id: two\n")
    (tmp_path / "t" / "three.yaml").write_bytes(b"CVE-2024-0003\x00")
    arts, skipped = S_.template_files(spark, str(tmp_path / "t"))
    assert [(r.source_item_id, r.title, r.cve_ids, r.language) for r in arts.collect()] == [("one.yaml", "First", ["CVE-2024-0001", "CVE-2024-0002"], "yaml")]
    assert {r.reason: r.n for r in skipped.collect()} == {"no_cve": 1, "binary": 1}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "files_exploits.csv").write_text("id,file,description,date_published,author,type,platform,verified,codes,aliases,tags\n1,/x/a.py,Title,2024,me,local,linux,1,CVE-2024-0001,,\n2,x/b.py,None,2024,me,local,linux,1,CVE-2024-0002,,\n3,x/a.py,None,2024,me,local,linux,1,,,\n")
    (tmp_path / "e" / "x").mkdir()
    (tmp_path / "e" / "x" / "a.py").write_bytes("print('\xe9')".encode("latin-1"))
    arts, skipped = S_.indexed_files(spark, str(tmp_path / "e"))
    assert [(r.source_item_id, r.title, r.language, r.content) for r in arts.collect()] == [("1", "Title", "python", "print('é')")]
    assert {r.reason: r.n for r in skipped.collect()} == {"missing_file": 1, "no_cve": 1}
    history = spark.createDataFrame([("a", "h1", "c1", "t0")], "artifact_id string, content_sha256 string, content string, seen_at string")
    assert I.versioned(history, spark.createDataFrame([("a", "h1", "c1", "t1"), ("a", "h2", "c2", "t1")], history.schema)).count() == 2
    links = spark.createDataFrame([("a", "CVE-2024-0001"), ("b", "CVE-2024-0009")], "artifact_id string, vuln_id string")
    assert sorted(map(tuple, I.relinked(links, spark.createDataFrame([("a", ["cve-2024-0002"])], "artifact_id string, cve_ids array<string>")).collect())) == [("a", "CVE-2024-0002"), ("b", "CVE-2024-0009")]


def test_pages_and_mappings(spark):
    ship(spark)
    page = "<html><head><title>T</title><meta name=description content=M></head><body><h1>Fault</h1>AVD-2024-12345 CVE-2024-0001 CWE-79<dl><dt>危害等级：</dt><dd>高危</dd><dt>披露时间</dt><dd>2024-05-01 10:00</dd><dt>影响产品</dt><dd>Widget</dd></dl><a href='/x'>l</a></body></html>"
    pages = spark.createDataFrame([("https://h.example/d", page), ("https://h.example/w", page + '"_waf_x"'), ("https://h.example/m", page + "AVD-2024-54321")], "url string, html string")
    good, *bad = sorted(S_.page_records(pages, "avd").collect(), key=lambda r: r.status)
    assert (good.source_id, good.title, good.severity, good.source_updated_at, good.description, good.weaknesses, good.components[0].name, good.refs) == ("AVD-2024-12345", "Fault", "high", "2024-05-01T10:00+08:00", "M", ["CWE-79"], "Widget", ["https://h.example/x"])
    assert [r.status for r in bad] == ["invalid"] * 2
    table = "<table><tr><td>AVD-2024-11111</td><td>Name &amp; more</td><td>CWE-22</td><td>2024-01-02</td></tr><tr><td>x</td></tr></table>"
    rows = S_.catalogue_rows(spark.createDataFrame([("https://h.example/list", table)], "url string, html string")).collect()
    assert [(r.source_id, r.title, r.weaknesses, r.url) for r in rows] == [("AVD-2024-11111", "Name & more", ["CWE-22"], "https://h.example/detail?id=AVD-2024-11111")]
    mapping = {"record_pointer": "/data", "mapping": {"source_id": "/id", "aliases": "/a~1b/0", "fields": {"title": "/t"}}}
    payloads = spark.createDataFrame([(json.dumps({"data": {"id": 7, "a/b": ["CVE-2024-0001"], "t": "x"}}),), (json.dumps({"data": {"id": 8}}),)], "payload string")
    got = sorted(S_.mapped_records(payloads, "avd", mapping).collect(), key=lambda r: r.status)
    assert [(r.source_id, r.aliases, r.title, r.status) for r in got] == [("7", ["CVE-2024-0001"], "x", "active"), (None, None, None, "invalid")]
    assert [r.source_id for r in M.kept_longest(spark.createDataFrame([("a", "1", "xx"), ("a", "2", "x")], "k string, source_id string, e string"), "k", "e").collect()] == ["1"]


def test_files_lines_and_log_stream(spark, tmp_path):
    ship(spark)
    (tmp_path / "in").mkdir()
    for i, (s, p) in enumerate(S_.demo_payloads()):
        if s == "nvd":
            (tmp_path / "in" / f"{i}.json").write_text(p)
    (tmp_path / "in" / "x.jsonl").write_text(S_.demo_payloads()[-1][1] + "\n\n")
    assert sorted(r.source_id for r in S_.read_records(spark, str(tmp_path / "in"), "nvd").collect()) == ["CVE-2099-1002", "CVE-2099-1003", "CVE-2099-1003"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"a":1}\n[2]\n{\n')
    good, bad = S_.parsed_lines(S_.read_lines(spark, str(tmp_path / "log")))
    assert good.count() == 1 and [(r.line, r.kind) for r in bad.orderBy("line").collect()] == [(2, "no_object"), (3, "invalid_json")]
    seen = []
    write = lambda df, n: seen.extend(r.value for r in df.collect())
    I.log_stream(spark, str(tmp_path / "log"), write, str(tmp_path / "c")).awaitTermination()
    (tmp_path / "log" / "b.jsonl").write_text("new\n")
    I.log_stream(spark, str(tmp_path / "log"), write, str(tmp_path / "c")).awaitTermination()
    assert len(seen) == 4 and seen[-1] == "new"
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, payload string")
    none = rows.limit(0)
    assert I.resumed(rows, "a").count() == 1 and I.next_position(rows, none, None) == "b" and I.next_position(rows, rows, "q") == "q"
    before = spark.createDataFrame([("v", {"title": "missing", "poc": "present"})], "vuln_id string, field_states map<string,string>")
    after = spark.createDataFrame([("v", {"title": "present", "poc": "conflicted"})], "vuln_id string, field_states map<string,string>")
    r = M.improvements(before, after).first()
    assert r.filled == ["title"] and r.new_conflicts == ["poc"] and "patch" in r.missing_after


def test_export_and_chunks(spark, tmp_path):
    ship(spark)
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, kind string")
    assert {r.kind: r.n for r in B.export_by(rows, str(tmp_path / "o"), "kind", "id").collect()} == {"x": 2, "y": 1}
    with pytest.raises(ValueError, match="repeat"):
        B.export_by(rows.union(rows), str(tmp_path / "p"), "kind", "id")
    got = D.chunks(spark.createDataFrame([(1, "a" * 10 + " " * 30 + "b" * 5)], "k long, t string"), "k", "t", 10, 0).collect()
    assert [(r.start, r.text) for r in got] == [(0, "a" * 10), (40, "b" * 5)]


def test_views_and_removed_tables(spark):
    r = spark.createDataFrame([("v", ["A-1"], "t", "d", '["CWE-79"]', "high")], "vuln_id string, aliases array<string>, title string, description string, weaknesses string, severity string")
    got = {x.view: x.text for x in C.view_texts(r).collect()}
    assert got == {"aggregate": 'v\nA-1\ntitle: t\ndescription: d\nweaknesses: ["CWE-79"]', "description": "t\nd", "metadata": 'vuln_id: v\naliases: A-1\ntitle: t\nweaknesses: ["CWE-79"]\nseverity: high'}
    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3
    end_run(spark)
    with pytest.raises(Exception, match=r"(?i)exist|found"):
        kept.count()
