"""Readers, incremental state and dataset plans on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import records as R
from tarnwick.plans import datasets as D
from tarnwick.runtime import ship
from tarnwick.sources import records as S
from tarnwick.streaming import incremental as I

CVE = {
    "cveMetadata": {"cveId": "CVE-2024-0001", "state": "PUBLISHED", "dateUpdated": "2024-05-01T00:00:00Z"},
    "containers": {
        "cna": {"title": "T", "descriptions": [{"lang": "en", "value": "D"}], "affected": [{"vendor": "v", "product": "p", "versions": []}], "problemTypes": [{"descriptions": [{"cweId": "CWE-79"}]}], "metrics": [{"cvssV3_1": {"baseSeverity": "MEDIUM", "version": "3.1"}}], "references": [{"url": "http://x"}]},
        "adp": [{"metrics": [{"cvssV4_0": {"baseSeverity": "HIGH", "version": "4.0"}}]}],
    },
}
NVD = {"vulnerabilities": [{"cve": {"id": "CVE-2024-0002", "vulnStatus": "Rejected", "descriptions": [{"lang": "en", "value": "N"}], "metrics": {"cvssMetricV2": [{"baseSeverity": "LOW"}]}, "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:acme:w:1:*:*:*:*:*:*:*"}, {"vulnerable": False, "criteria": "cpe:2.3:o:x:y:1:*:*:*:*:*:*:*"}]}]}]}}]}


def test_records(spark, tmp_path):
    ship(spark)
    (tmp_path / "a.json").write_text("﻿" + json.dumps([CVE, CVE]), encoding="utf-8")
    (tmp_path / "delta.json").write_text("[]")
    got = S.records(S.read_payloads(spark, str(tmp_path)), "cve").withColumn("id", S.identity()).collect()
    assert len(got) == 2 and (got[0].id, got[0].severity, got[0].weaknesses, got[0].components[0].name) == ("CVE-2024-0001", "high", ["CWE-79"], "p")
    nvd = S.records(spark.createDataFrame([(json.dumps(NVD),), ("{broken",)], "payload string"), "nvd").collect()
    assert (nvd[0].status, nvd[0].severity, [c.name for c in nvd[0].components]) == ("rejected", "low", ["w"]) and nvd[1].status == "invalid"
    with pytest.raises(ValueError):
        S.records(spark.createDataFrame([], "payload string"), "other")


def test_lines_and_pages(spark, tmp_path):
    ship(spark)
    (tmp_path / "x.jsonl").write_text("a\n\nb\n")
    assert [(r.line, r.value) for r in S.read_lines(spark, str(tmp_path)).orderBy("line").collect()] == [(1, "a"), (3, "b")]
    page = spark.createDataFrame([(1, "http://h/d/", "<h1>T</h1><dl><dt>CVE:</dt><dd>CVE-1</dd></dl><a href='x'>l</a><script>no</script>"), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in S.page_details(page).collect()}
    assert (got[1].title, got[1].pairs, got[1].links) == ("T", ["CVE=CVE-1"], ["http://h/d/x"]) and got[2].words == 0


def test_merge_and_upsert(spark):
    rows = spark.createDataFrame([("k", 1, "a", "high"), ("k", 0, "b", "medium"), ("k", 2, "c", None)], "id string, prio int, src string, severity string")
    m = R.merge_by_priority(rows, "id", F.col("prio"), "src", ["severity"]).first()
    assert (m.severity, m.severity_state, m.sources) == ("medium", "conflicted", 3)
    stored = spark.createDataFrame([(1, "2024-02", "x"), (2, "2024-02", "x"), (3, "2024-02", "x")], "id long, at string, h string")
    new = spark.createDataFrame([(1, "2024-01", "y"), (2, "2024-03", "x"), (3, None, "z"), (4, None, "q")], "id long, at string, h string")
    assert {r.id: r.outcome for r in R.upsert(stored, new, "id", "at", "h").collect()} == {1: "stale", 2: "unchanged", 3: "stale", 4: "changed"}


def test_upsert_stream(spark, tmp_path):
    for i, row in enumerate([{"id": 1, "at": "2", "h": "a"}, {"id": 1, "at": "1", "h": "old"}, {"id": 2, "at": "1", "h": "b"}]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(row))
    state = {}

    def write(df, number):
        path = str(tmp_path / f"state-{number}")
        df.write.mode("overwrite").parquet(path)
        state["path"] = path

    stream = spark.readStream.schema("id long, at string, h string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    I.upsert_stream(stream, lambda: spark.read.parquet(state["path"]) if state else None, write, "id", "at", "h", str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.h for r in spark.read.parquet(state["path"]).collect()} == {1: "a", 2: "b"}


def test_windows_delta_and_failures(spark):
    w = I.sync_windows(spark, "2024-01-01", "2024-09-01").orderBy("start").collect()
    assert len(w) == 3 and str(w[1].start) == "2024-04-29 23:55:00" and str(w[2].end) == "2024-09-01 00:00:00"
    log = spark.createDataFrame([("a", "1", "1", "u"), ("a", "2", "2", "v"), ("b", "1", "1", "w")], "id string, fetch_time string, updated string, url string")
    assert {r.id: r.url for r in I.delta_latest(log, "1", "a").collect()} == {"a": "v", "b": "w"}
    queue = spark.createDataFrame([("a", 1, "e"), ("b", 2, "e")], "id string, attempts int, error string")
    got = I.record_failures(queue, spark.createDataFrame([("a", "f"), ("c", "g")], "id string, error string"), spark.createDataFrame([("b",)], "id string")).collect()
    assert {r.id: (r.attempts, r.error) for r in got} == {"a": (2, "f"), "c": (1, "g")}


def test_datasets(spark, tmp_path):
    ship(spark)
    text = "line one\nline two is longer\n" * 20
    c = D.chunks(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t", 100, 10).orderBy("chunk").collect()
    assert c[0].start == 0 and c[-1].end == len(text) and all(r.text == text[r.start : r.end] for r in c) and all(a.end - b.start in (10, 0) or a.end >= b.start for a, b in zip(c, c[1:], strict=False))
    fam = D.exact_families(spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "id long, t string"), "id", "t", "s")
    assert {r.id: r.family for r in fam.collect()} == {1: 1, 2: 1, 3: 3}
    D.publish(fam, str(tmp_path / "out"), "id", "family", "split")
    with pytest.raises(ValueError, match="duplicate_id"):
        D.publish(fam.unionByName(fam), str(tmp_path / "out2"), "id", "family", "split")
    turns = spark.createDataFrame([(1, 1, "assistant", "y"), (1, 0, "user", "x"), (2, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    got = D.conversations_to_messages(turns).collect()
    assert len(got) == 1 and json.loads(got[0].messages) == [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]


def test_kmeans_is_deterministic(spark):
    ship(spark)
    v = spark.createDataFrame([(i, [1.0, 0.1 * (i % 3)] if i < 6 else [0.1 * (i % 3), 1.0]) for i in range(12)], "id long, v array<double>")
    a = {r.key: r.cluster for r in R.spherical_kmeans(v, "id", "v", 2).collect()}
    assert a == {i: int(i >= 6) for i in range(12)} == {r.key: r.cluster for r in R.spherical_kmeans(v.repartition(5), "id", "v", 2).collect()}
