"""The operators on Spark, against brute force, with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwick.llm import jaccard, knn, mixing, packing, pages, pii, ppm, quality, substrings, tokens
from tarnwick.runtime import ship

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n long, block string, tokens string, prefix long, size long"


def _texts():
    rng = random.Random(5)
    word = [f"{a}{b}" for a in ("th", "er", "on", "an", "re", "in") for b in ("ou", "ea", "st", "nd", "wh", "ly", "es")]
    long = lambda n: " ".join(rng.choice(word) for _ in range(n))
    base = long(120)
    near = base.split()
    near[60] = "CHANGED"
    passage = long(40)
    texts = [base, " ".join(near), base, long(80) + " " + passage + " " + long(30), passage + long(90), "", None, "two words", "two words", "One", long(4000), "é日 mail me a.b@x.org or +1 (504) 555-2652", "x " * 300]
    return [*texts, *(long(rng.randrange(1, 200)) for _ in range(30))]


def rows():
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1, "b", "t", 2, 3) for i, t in enumerate(_texts())]
    return [*out, out[4], (3, "another text under one key", None, None, None, None, None, None, None, None), (None, "no key here", None, "s1", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(rows(), SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(spark):
    """Only rows with keys of their own."""
    ship(spark)
    return spark.createDataFrame([r for i, r in enumerate(rows()) if r[0] is not None and r[0] not in {x[0] for x in rows()[:i]}], SHAPE).repartition(3).cache()


OPERATORS = {
    "quality": quality.quality_rules,
    "ppm": lambda d: ppm.score_texts(d, F.lit(False)),
    "substrings": substrings.remove_repeats,
    "pii": pii.find_pii,
    "tokens": tokens.count_tokens,
    "packing": packing.pack,
    "mixing": mixing.fair_queue,
    "jaccard": jaccard.jaccard_components,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, docs, name):
    got = OPERATORS[name](docs).collect()
    keys = Counter(r.doc_id for r in got)
    assert set(keys) == {r[0] for r in rows()}
    if name != "packing":
        assert keys == Counter(r[0] for r in rows())
    assert OPERATORS[name](spark.createDataFrame([], SHAPE)).collect() == []


def test_substrings(plain):
    want, seen = {}, set()
    for r in sorted(plain.collect(), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(raw[i : i + 100])
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        want[r.doc_id] = len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(plain).collect()} == want
    assert sum(v[1] for v in want.values()) > 500


def test_jaccard(plain):
    sets = {}
    for r in plain.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    least = {k: k for k in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = least[b] = min(least[a], least[b])
    got = jaccard.jaccard_components(plain).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(sets[k]), least[k]) for k in sets}
    tiny = jaccard.JoinRules(sketch_bits=4, block=2, queries=2)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(plain, tiny).collect()} == least



def test_jaccard_near_copies(spark, monkeypatch):
    """Near copies of one text, few of which link, meet as few groups, not in pairs; a block of them gives each link."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(160):
        words = list(texts[-7] if k % 10 == 9 else base)
        for i in rng.sample(range(400), 2 if k % 10 == 9 else rng.choice([14, 18, 19])):
            words[i] = f"x{rng.randrange(10**9)}"
        texts.append(words)
    written = {}
    real = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: written.setdefault(name, []).append(real(df, name)) or written[name][-1])
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.JoinRules(block=32)).collect()}
    least = list(range(len(texts)))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(6):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == dict(enumerate(least))
    assert 10 < len(links) < 100
    groups = written["jaccard-lists"][-1].join(written["jaccard-groups"][-1], "doc_id").groupBy("token").agg(F.countDistinct("group").alias("k"))
    assert groups.agg(F.sum(F.expr("k * (k - 1) div 2"))).first()[0] <= 2 * groups.count()


def test_ppm(plain):
    got = {r.doc_id: r for r in ppm.score_texts(plain, F.col("doc_id") % 3 == 0, ppm.PpmModel(order=3, block_bytes=2000)).collect()}
    data = {r.doc_id: (r.text or "").encode() for r in plain.collect()}
    counts, words = defaultdict(Counter), Counter()
    for k, raw in data.items():
        if k % 3:
            words.update([*raw.lower().split(), None])
            x = b"\xff" * 3 + raw + b"\xfe"
            for i in range(3, len(x)):
                for n in range(4):
                    counts[x[i - n : i]][x[i]] += 1

    def log10(context, symbol):
        out, gone = 0.0, set()
        for n in range(3, -1, -1):
            left = {s: c for s, c in counts.get(context[3 - n :], {}).items() if s not in gone}
            if left:
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    return out + math.log10(left[symbol] / whole)
                out, gone = out + math.log10(len(left) / whole), gone | set(left)
        return out - math.log10(255 - len(gone))

    n, v = sum(words.values()), len(words)
    for k, raw in data.items():
        x, w = b"\xff" * 3 + raw + b"\xfe", [*raw.lower().split(), None]
        assert got[k].score == pytest.approx(sum(log10(x[i - 3 : i], x[i]) for i in range(3, len(x))), rel=1e-9)
        assert got[k].base_score == pytest.approx(sum(math.log10((words[t] + 1) / (n + v + 1)) for t in w), rel=1e-9)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(w), sum(words[t] > 0 for t in w), n)


def test_knn(spark):
    rng = random.Random(6)
    data = [(i, [rng.uniform(-1, 1) for _ in range(6)] if i % 9 else [0.5] * 6, "x") for i in range(400)]
    odd = [(401, None, "x"), (500, [float("nan")] * 6, "x"), (402, [None] * 6, "x"), (None, [1.0] * 6, "x")]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, cell string")
    ship(spark)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.voronoi_top_k(df).collect()}
    import numpy as np

    v = {i: np.floor(1024 * np.array(x, dtype=np.float32).astype(float)).astype(int) for i, x, _ in data}
    for q in (0, 100, 200, 300):
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert len(got) == 40
    assert knn.voronoi_top_k(df.limit(0)).collect() == []


def test_knn_of_repeated_query_keys(spark):
    import numpy as np

    ship(spark)
    rng = random.Random(8)
    data = [(i, [rng.gauss(0, 1) + 8 * (j == i % 8) for j in range(8)]) for i in range(1, 200)]
    hot = [9.0] + [0.0] * 7
    data = [x for x in data if x[0] != 100 and x[0] % 8] + [(100, hot)] * 60
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r["rank"]: (r.vec_id, r.score) for r in knn.voronoi_top_k(df).filter("query_id = 100").collect()}
    whole = [(i, np.floor(1024 * np.array(x)).astype(int)) for i, x in data]
    best = sorted((-int(whole[-1][1] @ v), i) for i, v in whole if i != 100)[:10]
    assert got == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}


def test_knn_of_odd_widths(spark):
    ship(spark)
    odd = [(i, [1.0] * (i % 3)) for i in range(1000, 1008)]
    for few in odd, [(i, []) for i in range(1000, 1008)]:
        df = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(98, 108)] + few, "vec_id long, embedding array<double>")
        got = [r.vec_id for r in knn.voronoi_top_k(df).filter("query_id = 100").orderBy("rank").collect()]
        assert got == [107, 106, 105, 104, 103, 102, 101, 99, 98]
    only = spark.createDataFrame([(100, []), (101, [])], "vec_id long, embedding array<double>")
    assert knn.voronoi_top_k(only).collect() == []


def test_mixing_targets(spark, docs):
    got = mixing.fair_queue(docs).collect()
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 90), ("c", 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert t == pytest.approx({"a": 30.0, "c": 0.0, None: 270.0, "b": 800.0})
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.fair_queue(docs.repartition(5)).collect()), key=str)


def test_pages(spark):
    ship(spark)
    html = "<html><body><div>Site</div><ul><li>Home<li>More</ul><div>own text {}</div></body></html>"
    data = [(i, "http://h.example/x", html.format(i), 1) for i in range(9)] + [(20, None, None, 1), (None, "bad", "", 1), (3, "http://h.example/x", html.format(3), 1)]
    got = sorted((r.page_id if r.page_id is not None else -1, r.text) for r in pages.extract_text(spark.createDataFrame(data, "page_id long, url string, html string, host int")).collect())
    assert got == sorted([(-1, ""), (20, ""), (3, "own text 3"), *((i, f"own text {i}") for i in range(9))])
    assert pages.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pages_main_slot_without_marks(spark):
    """No element or word tells the article: the slot that the template of the host's pages leaves open does; other hosts and layouts keep theirs."""
    page = '<html><body><div class="q1"><p>Stay {0}</div><div class="q2"><h1>Title {0}</h1><p>first of {0}, quite long as it goes on<p>{1}</div><div class="q3">say {0}</div></body></html>'
    more = ["", "and on", "and on<p>and so on"]
    data = [(i, "http://a.example/x", page.format(i, more[i % 3])) for i in range(12)]
    data += [(50, "http://a.example/x", "<html><body><section>another layout</section></body></html>"), (51, "http://b.example", page.format(51, ""))]
    got = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].split("\n") == [x for x in (f"Title {i}", f"first of {i}, quite long as it goes on", *more[i % 3].split("<p>")) if x]
    assert got[50] == "another layout" and got[51].startswith("Stay 51\n")


def test_templates_against_occurrence_vectors(spark):
    rng = random.Random(5)
    kinds = ["<div class=a><p>{0}</div>", "<div class=b>same</div>", "<ul><li>{0}<li>x</ul>", "<div class=c><h1>{0}</h1><div class=d>{0} {0} {0} {0} {0}</div></div>", "<hr><p>{0}"]
    data = []
    for i in range(60):
        inner = "".join(kinds[j].format(f"w{i}" * rng.randint(1, 5)) for j in rng.sample(range(5), 5) if rng.random() < 0.8)
        data.append((i, f"http://h{i % 3}.example/p", f"<html><body>{inner}</body></html>" if i % 20 else None))
    rules = pages.TemplateRules()
    got = {r.host: r for r in pages.deduce_templates(spark.createDataFrame(data, "page_id long, url string, html string"), rules).collect()}
    for h in range(3):
        own = [pages.occurrences(html) if html else {0: [1, 0, 0, 0]} for i, _, html in data if i % 3 == h]
        vectors = {t: tuple(p.get(t, [0])[0] for p in own) for p in own for t in p if t}
        classes = {}
        for t, v in vectors.items():
            classes.setdefault(v, []).append(t)
        on = {t: sum(x > 0 for x in v) for t, v in vectors.items()}
        valid = {t for v, c in classes.items() if len(c) >= rules.tokens for t in c if on[t] >= max(rules.pages, rules.share * len(own))}
        row = got[f"h{h}.example"]
        assert set(row.template) == valid and dict(zip(row.template, row.spread, strict=True)) == {t: on[t] for t in valid}
        held = lambda t, i: sum(p[t][i] for p in own if t in p)
        mains = [(held(t, 1), -max(p[t][3] for p in own if t in p), t) for t in valid if max(vectors[t]) == 1 and 2 * held(t, 1) > held(0, 1) and 2 * held(t, 2) > held(0, 2)]
        assert mains and (row.main == min(mains)[2] or min(mains)[:2] == min(m[:2] for m in mains if m[2] == row.main))


def test_pages_template_inside_articles(spark):
    ship(spark)
    body = "<html><body><nav><ul><li>Home</ul></nav><article><p>Read our other news<div>All rights reserved</div><p>{}<p>{}</article></body></html>"
    own, copy = "what only this page says, at some length, number {}", "a text that half of the pages copy, as long as articles are"
    data = [(i, "http://h.example/x", body.format(*(((own + " " + k).format(i) for k in "ab") if i < 5 else (copy, copy + " again")))) for i in range(10)]
    got = {r.page_id: r.text for r in pages.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join((own + " " + k).format(i) for k in "ab") if i < 5 else f"{copy}\n{copy} again" for i in range(10)}


def test_one_of_each_row_of_repeated_and_null_keys(spark):
    ship(spark)
    texts = [" ".join(f"w{t}x{i}" for i in range(60)) for t in range(6)]
    data = [(1, texts[0]), (7, texts[0] + " more"), (7, texts[1]), (7, texts[2]), (7, texts[2] + " more"), (None, texts[3]), (None, texts[3] + " more"), (None, texts[4]), (9, texts[4]), (None, ""), (None, ""), (7, None), (8, texts[5])]
    out = jaccard.one_of_each(spark.createDataFrame(data, "doc_id long, text string"), jaccard.JoinRules(words=5, percent=80))
    got = Counter((r.doc_id, (r.text or "").removesuffix(" more")) for r in out.collect())
    assert out.columns == ["doc_id", "text"]
    assert got == Counter([(1, texts[0]), (7, texts[1]), (7, texts[2]), (None, texts[3]), (9, texts[4]), (None, ""), (None, ""), (7, ""), (8, texts[5])])


def test_clashing_names(spark):
    ship(spark)
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t, "s", 5, "x"), (1, t + " more", "s", 6, "y"), (2, t, "s", 7, "z"), (None, "other words here", None, 8, "w")], "doc_id long, text string, source string, tw_part long, tw_copy string")
    out = jaccard.one_of_each(df, jaccard.JoinRules(words=5, percent=80))
    assert out.columns == df.columns and sorted(r.tw_part for r in out.collect()) in ([5, 8], [6, 8])
    mix = mixing.mixed(df)
    assert mix.columns == df.columns and {(r.tw_part, r.tw_copy) for r in mix.collect()} <= {(5, "x"), (6, "y"), (7, "z"), (8, "w")}


def test_packing_round_trip(docs):
    encode = packing.encoder("byte_bpe_50k.tiktoken")
    want = Counter((r.doc_id, tuple([*encode(r.text or ""), 0])) for r in docs.collect())
    pieces = packing.pack(docs, with_ids=True).collect()
    by_document = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) == p.ids_crc32 and len(p.ids) == p.length
        by_document[p.doc_id, p.doc_tokens].append(p)
    for (key, n), ps in by_document.items():  # rows of one key and size meet here: each start as often as there are such rows
        own = sorted(t for (k, t), times in want.items() for _ in range(times) if k == key and len(t) == n)
        if len(own) == 1:
            assert tuple(i for p in sorted(ps, key=lambda p: p.start) for i in p.ids) == own[0]
        assert sum(p.length for p in ps) == n * len(own)
    assert sum(p.length for p in pieces) == sum(len(encode(r.text or "")) + 1 for r in docs.collect())
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_pipeline_stages(spark, docs, plain):
    for d in (docs, plain):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, "")
            assert out.columns == d.columns, name
            out.collect()
            assert stage(spark, d.limit(0), "").collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, plain, "").count() > 0
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, plain, "").collect()}
    assert {1, 2}.isdisjoint(kept) and {0, 3, 4, 5, 6, 10} <= kept
    assert "<phone>" in corpus_pipeline.personal_data(spark, plain, "").filter("doc_id = 11").first().text
    copies = Counter(r.doc_id for r in corpus_pipeline.mixing(spark, plain, "").collect())
    taken = {r.doc_id: r.copies for r in mixing.fair_queue(plain).collect()}
    assert all(copies[k] == n for k, n in taken.items())
