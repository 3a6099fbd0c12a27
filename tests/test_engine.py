"""Functions and operators of the engine against expected values and DuckDB."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwick import catalogue
from tarnwick.functions import text as T
from tarnwick.functions import versions
from tarnwick.operators import analytics as A
from tarnwick.operators import retrieval as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(catalogue.ORACLE[name]).df()
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(tuple(None if x != x else x for x in r) for r in df[columns].itertuples(index=False))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(str, plain(got))), sorted(map(str, plain(want))), strict=True):
        assert a == b or a.replace(".0", "") == b.replace(".0", "")


def test_tokens_with_han_script(spark):
    got = spark.createDataFrame([("Ab-1.2:c 漏洞利用 x",), (None,)], "t string").select(T.tokens(F.col("t")).alias("k")).collect()
    assert got[0].k == ["ab-1.2:c", "x", "漏", "洞", "利", "用", "漏洞", "洞利", "利用"] and got[1].k == []


@pytest.mark.parametrize(("name", "component", "version", "want"), catalogue.VERSION_CASES)
def test_version_cases(name, component, version, want):
    assert versions.status_of(version, component) == want


def test_odd_version_rules_never_raise():
    rule = lambda **k: {"default_status": "unaffected", "versions": [{"status": "affected", **k}]}
    of = versions.status_of
    semver = {"version": "1.0.0", "lessThan": "2.0.0", "versionType": "semver"}
    assert of("1.5.0", rule(**semver, changes=[{"at": "bad", "status": "unaffected"}])) == "affected"
    assert of("1.5.0", rule(**semver, changes=[{"status": "unaffected"}, None, {"at": "1.4.0", "status": "unaffected"}, {"at": "1.2.0", "status": "affected"}])) == "unaffected"
    assert of("1.0", rule(version="1.0", changes=[{"at": "0.5"}])) == "affected" and of("1.1", rule(version="1.0")) == "unaffected"
    assert of("1.0", rule(version="*")) == "unknown" and of("1.0", rule(version="*", lessThan="2.0", versionType="numeric")) == "unknown"
    assert of("1.5", rule(version="*", versionStartIncluding="1.0", versionEndExcluding="2.0", versionType="numeric")) == "affected"
    assert of("1.0", {"versions": ["1.0"]}) == "affected" and of(None, rule(version="1")) == "unknown" and of("1", {}) == "unknown"
    order = lambda kind, *vs: [versions.compare(a, b, kind) for a, b in zip(vs, vs[1:], strict=False)]
    assert order("semver", "1.0.0-1", "1.0.0-Alpha", "1.0.0-alpha.1", "1.0.0", "V1.0.1") == [-1] * 4
    assert order("pep440", "1.0.dev1", "1.0a1", "1.0rc1", "1.0", "1.0.post1") == [-1] * 4
    assert order("maven-version", "1.0-alpha", "1.0-sp") == [-1] and versions.compare("1", "1.0", "maven") == 0
    assert versions.compare("v1", "1", "numeric") is None and versions.compare("2024-01", "12", "date") is None and versions.compare("2024-02-1", "2024.1.30", "date") == 1


@pytest.mark.parametrize(("name", "trees", "present", "want"), catalogue.CPE_CASES)
def test_cpe_cases(name, trees, present, want):
    assert versions.cpe_status(trees, present) == want
    assert versions.cpe_status(trees, ["no name"]) == "unknown" and versions.cpe_status(None, present) == versions.cpe_status(trees, []) == "unknown"


def test_cpe_escapes():
    assert versions.split_cpe(r"cpe:2.3:a:x\\:y\:z:1:*:*:*:*:*:*:*")[:4] == ["a", "x\\", "y:z", "1"]
    assert versions.split_cpe(r"cpe:2.3:a:x\:y:p:1:*:*:*:*:*:*:*")[1] == "x:y"
    assert versions.split_cpe("cpe:2.3:a:b") is None


def test_paired_effect(spark):
    log = spark.createDataFrame([("base", "t", 1, 0.4), ("base", "t", 2, 0.5), ("new", "t", 1, 0.3), ("new", "t", 2, 0.4)], "variant string, task string, seed int, value double")
    r = A.paired_effects(log, "variant", "base", ["task", "seed"], "value", ["task"], minimize=True).first()
    assert (r.pairs, r.mean_delta, r.outcome) == (2, 0.1, "improved")


def test_run_diagnostics(spark):
    log = spark.createDataFrame([("r", i, i, x) for i, x in enumerate((1.0, 0.8, 0.9))], "run string, step int, line int, loss double")
    r = A.run_diagnostics(log, "run", "step", "loss", "line").first()
    assert (r.best, r.last, r.regressed, r.non_increasing) == (0.8, 0.9, True, 0)


def test_filters_never_relax(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "high"), (2, "alpha", "low")], "id long, text string, severity string")
    asked = spark.createDataFrame([(9, "alpha")], "q long, query string")
    run = lambda **k: [r.id for r in S.search(docs, asked, "id", "text", "q", "query", mode="sparse", **k).orderBy("rank").collect()]
    assert run() == [2, 1] and run(filters=S.Filters(severity="HIGH")) == [1] and run(filters=S.Filters(severity="none")) == []
    with pytest.raises(ValueError):
        run(k=0)


def test_cyclic_pick_around_the_end(spark):
    from tarnwick.operators.records import cyclic_pick

    buckets = {"a": "xxyzxx", "b": "xxx", "c": "xyx", "d": "xy", "e": "yxx"}
    data = [(10 * n + i, b, f) for n, (b, fs) in enumerate(buckets.items()) for i, f in enumerate(fs)]
    df = spark.createDataFrame(data, "doc_id long, lang string, source string")
    got = {r.doc_id: r.picked for r in cyclic_pick(df, df, "lang", "doc_id", "source", F.col("doc_id")).collect()}
    want = {}
    for k, b, f in data:
        own = [x for x in data if x[1] == b]
        around = (own[(k + i) % len(own)] for i in range(len(own)))
        if (found := next((x[0] for x in around if x[2] != f), None)) is not None:
            want[k] = found
    assert got == want
