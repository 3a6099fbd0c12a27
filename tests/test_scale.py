"""Steps that are to stay bounded on large tables, against brute force."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tarnwick import catalogue
from tarnwick.operators import graph as G
from tarnwick.operators import retrieval as S


def check(spark, path, name, **tables):
    """A query over these tables gives what its SQL gives."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE[name]).df()
    got = catalogue.QUERIES[name](spark, str(path)).toPandas()[list(want.columns)]
    rows = lambda df: sorted((tuple(None if x != x else float(x) if isinstance(x, (int, float)) else x for x in r) for r in df.itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_BITS", 2)  # blocks of 4 sets
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    sets = {i: rng.sample(words, rng.randint(1, 30)) for i in range(60)}
    sets |= {100 + i: [w for w in sets[1] + ["x", "y", "z"] if rng.random() < 0.9] for i in range(40)} | {200: list(reversed(sets[5])), 201: [], 202: None}
    rows = [(k, v) for k, v in sets.items()]
    got = {(r.left, r.right): round(r.score, 9) for r in G.jaccard_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", 65).collect()}
    heads, want = {}, {}
    for k in sorted(sets):
        if s := frozenset(sets[k] or ()):
            if s in heads:
                want[heads[s], k] = 1.0
            else:
                heads[s] = k
    for a, x in heads.items():
        for b, y in heads.items():
            c, u = len(a & b), len(a | b)
            if x < y and 100 * c >= 65 * u:
                want[x, y] = round(c / u, 9)
    assert got == want


def test_training_pairs_of_odd_rows(spark, tmp_path):
    rows = [(3, "abc", "en"), (3, "abcde", "en"), (4, None, "en"), (5, "", "en"), (6, "  ", "en"), (7, "  　", "en"), (9, "\t", "fr"), (10, "x" * 9, None), (12, "y", "")]
    check(spark, tmp_path, "training_pairs", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_nearest_vectors_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_NUMBERS", 64)  # blocks of 16 vectors of 4
    rng = random.Random(2)
    vectors = [(i, [float(rng.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(100)] + [(100 + i, [1.0, 2.0, 0.0, 0.0], 7) for i in range(30)] + [(200, [0.0] * 4, 1), (201, [1.0], 1), (202, None, 1)]
    e = spark.createDataFrame(vectors, "id long, v array<float>, label int")
    got = {(r.q, r.rank): (r.id, round(r.score, 6)) for r in S.dense_top(e, e.select(F.col("id").alias("q"), F.col("v").alias("w")), "id", "v", "q", "w", 5).collect()}
    want = {}
    for q, a, _ in vectors:
        size = lambda x: sum(y * y for y in x)
        near = [(-round(sum(x * y for x, y in zip(a, b)) / ((size(a) * size(b)) ** 0.5 or 1), 6), k) for k, b, _ in vectors if a and b and k != q and len(a) == len(b)]
        want |= {(q, i + 1): (k, -s) for i, (s, k) in enumerate(sorted(near)[:5])}
    assert got == want


def test_every_vector_is_asked(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0, float(i % 3)], i % 4) for i in range(1, 40)] + [(60, [1.0, 2.0, 3.0], 9)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check(spark, tmp_path, "ir_recall_mrr_ndcg", embeddings=e)
    assert catalogue.QUERIES["ir_recall_mrr_ndcg"](spark, str(tmp_path)).first().queries == 39  # all but the one without others of its label


def test_fusion_of_many_ties(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(300)] + [(300 + i, "w1 w2 w3") for i in range(150)] + [(900, ""), (901, None), (902, "zz")]
    asked = [(i, " ".join(rng.sample(words, 3))) for i in range(8)] + [(8, "none here"), (9, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    for name in ("bm25_topk", "rrf_hybrid_topk", "rrf_modes", "two_stage_prescore"):
        (path := tmp_path / name).mkdir()
        check(spark, path, name, documents=d, benchmark=q)


def test_scores_leave_tasks_as_the_best_only(spark):
    rows = [(i, f"a b{i % 7}") for i in range(2000)]
    asked = S.Asked.of(spark.createDataFrame([(1, "a"), (2, "a b3")], "q long, text string"), "q", "text")
    docs = S.matched(spark.createDataFrame(rows, "k long, text string").repartition(2), "k", "text", asked).coalesce(1)
    best = S.Best(2, 5)
    scores = S.Channels(docs, asked).scores
    for part in docs.orderBy("k").toArrow().to_batches():
        best.add(scores(part.column("m"))[0], S._keys(part, "k"))
    assert best.settle().groupby("q").size().tolist() == [5, 5] and len(best.held[0]) == 10
    assert best.settle().key.tolist() == [0, 1, 2, 3, 4, 3, 10, 17, 24, 31]


def test_features_are_shuffled_once(spark, tmp_path):
    spark.createDataFrame([(1, "a a b"), (2, "c"), (1, "b d")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalogue.QUERIES["hash_features_512"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange ") == 1


def test_first_disjoint_pairs(spark):
    rng = random.Random(4)
    for most in (3, 40):
        rows = [(i, [rng.choice("ab"), rng.choice("cde")]) for i in range(60)] + [(60 + i, ["a", "c", "e"]) for i in range(40)] + [(None, ["z"]), (7, ["y"])]
        d = spark.createDataFrame(rows, "k long, s array<string>")
        got = [tuple(r) for r in G.pairs_of_disjoint_labels(d, "k", "s", most).collect()]
        assert got == sorted((a, b) for a, x in rows for b, y in rows if None not in (a, b) and a < b and not set(x) & set(y))[:most]


def test_links_of_odd_parts(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (5, 1), (9, 1), (4, 3)], "l_partkey long, l_suppkey long")
    part = spark.createDataFrame([(1, "x", 3), (2, "x", 3), (5, "y", 7), (10, None, 7), (4, None, 1), (3, "z", 1)], "p_partkey long, p_brand string, p_size int")
    check(spark, tmp_path, "artifact_links", lineitem=lines, part=part)


def test_batches_are_cut(monkeypatch):
    from tarnwick.plans import datasets as D

    taken = {}
    fake = type("Frame", (), {"select": lambda self, *c: self, "mapInPandas": lambda self, f, shape: taken.update(f=f) or self, "withColumnRenamed": lambda self, *c: self})()
    monkeypatch.setattr(D.F, "col", lambda c: type("C", (), {"cast": lambda self, k: self, "alias": lambda self, n: self})())
    D.chunks(fake, "k", "t", 4, 0)
    made = list(taken["f"](iter([pd.DataFrame({"key": range(1000), "text": ["abcdefgh"] * 1000})])))
    assert max(map(len, made)) <= 512 and sum(map(len, made)) == 2000
