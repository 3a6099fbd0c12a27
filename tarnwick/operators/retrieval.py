"""Hybrid retrieval: BM25, cosine, reciprocal rank fusion, filters and evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.functions.text import tokens
from tarnwick.functions.vector import cosine
from tarnwick.functions.versions import cpe_applicability, named_status, split_cpe
from tarnwick.runtime import by_key, materialize


def term_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf and dl, the number of tokens of the document."""
    d = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    return d.select(key, "dl", F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def indexed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The term table of docs, written once, and the number and mean length of all of them, also of those without a term."""
    terms = materialize(term_table(docs, key, text), "terms")
    sizes = terms.groupBy(key).agg(F.max("dl").alias("dl")).agg(F.sum("dl").cast("double").alias("total"))
    return terms, docs.agg(F.count("*").cast("double").alias("n")).join(sizes).select("n", (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("avgdl"))


def question_terms(queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """query_key and each distinct term of its text."""
    return queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))


def bm25_of(terms: DataFrame, stats: DataFrame, asked: DataFrame, key: str, query_key: str) -> DataFrame:
    """query_key, key and score from a term table, stats (n, avgdl) and the terms asked for."""
    own = terms.join(asked.select("term").distinct(), "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(F.expr("1e0 + (n - df + 5e-1) / (df + 5e-1)"))
    part = F.expr("tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / avgdl))") * idf
    weighted = own.join(df, "term").join(F.broadcast(stats))  # one row
    return weighted.select("term", key, part.alias("part")).join(asked, "term").groupBy(query_key, key).agg(F.sum("part").alias("score"))


def overlap_of(terms: DataFrame, asked: DataFrame, key: str, query_key: str) -> DataFrame:
    """query_key, key and the share of the query's terms that the document has."""
    sizes = asked.groupBy(query_key).agg(F.count("*").alias("m"))
    met = terms.select(key, "term").join(asked, "term").groupBy(query_key, key).agg(F.count("*").alias("c"))
    return met.join(sizes, query_key).select(query_key, key, (F.col("c").cast("double") / F.col("m")).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str) -> DataFrame:
    """query_key, key and score of documents that share a term with a query; query terms are a set.

    df and the mean length come from all of docs, so filters belong before. Documents meet queries on terms, never as a cross product.
    """
    terms, stats = indexed(docs, key, text)
    return bm25_of(terms, stats, question_terms(queries, query_key, query_text), key, query_key)


@dataclass(frozen=True)
class Asked:
    """A stated query set: its keys, distinct terms, each term's queries (a row of `queries` from starts[term] on) and each query's number of terms."""

    keys: list
    kind: str
    terms: list
    starts: np.ndarray
    queries: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, queries: DataFrame, query_key: str, query_text: str) -> Asked:
        rows = question_terms(queries, query_key, query_text).filter(F.col(query_key).isNotNull()).distinct().orderBy("term", query_key).collect()
        keys, terms = sorted({r[0] for r in rows}), sorted({r.term for r in rows})
        at, place = {k: i for i, k in enumerate(keys)}, {t: i for i, t in enumerate(terms)}
        own, of = np.array([at[r[0]] for r in rows], np.int64), np.array([place[r.term] for r in rows], np.int64)
        order = np.argsort(of, kind="stable")
        return cls(keys, dict(queries.dtypes)[query_key], terms, np.searchsorted(of[order], np.arange(len(terms) + 1)), own[order], np.bincount(own, minlength=len(keys)))


def matched(docs: DataFrame, key: str, text: str, asked: Asked) -> DataFrame:
    """One row per key of docs: key and m, an array of term (its number in asked, -1 for the document itself), dl and tf.

    Terms that nobody asks for go before anything is shuffled, and a key's rows meet once.
    """
    named = docs.sparkSession.createDataFrame(pd.DataFrame({"term": ["", *asked.terms], "i": np.arange(-1, len(asked.terms))}), "term string, i int")  # no token is empty
    t = docs.select(F.col(key).alias("k"), tokens(F.col(text)).alias("t")).select("k", F.size("t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    own = by_key(t.join(F.broadcast(named), "term").select("k", "dl", "i"), "k").groupBy("k", "dl", "i").agg(F.count("*").cast("int").alias("tf"))
    return own.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "dl", "tf"))).alias("m")).withColumnRenamed("k", key)


class Channels:
    """BM25 and the share of a query's terms, of matched documents, document by document: every score that is not 0, rounded, without a table of pairs."""

    def __init__(self, docs: DataFrame, asked: Asked, digits: int = 6) -> None:
        m = docs.select(F.explode("m").alias("x")).select("x.*")
        self.asked, self.digits, self.df, self.n, total = asked, digits, np.zeros(len(asked.terms)), 0.0, 0.0
        for r in m.groupBy("i").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.sum(F.col("tf").cast("double") * F.col("dl")).alias("total")).collect():  # one row per term
            if r.i < 0:
                self.n, total = float(r.n), r.total
            else:
                self.df[r.i] = r.df
        self.avgdl = total / self.n if self.n else 0.0

    def scores(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """BM25 and overlap of a batch of m: rows are documents, columns queries; 0 where no term is shared."""
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x = lists.flatten()
        i, dl, tf = (x.field(f).to_numpy(zero_copy_only=False) for f in range(3))
        row = np.repeat(np.arange(len(n)), n)
        own = np.flatnonzero(i >= 0)
        i, dl, tf, row = i[own], dl[own].astype(float), tf[own].astype(float), row[own]
        idf = np.log(1.0 + (self.n - self.df + 0.5) / (self.df + 0.5))
        part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (self.avgdl or 1.0))) * idf[i]
        times = np.diff(self.asked.starts)[i]
        query = self.asked.queries[np.arange(times.sum()) + np.repeat(self.asked.starts[i] - np.cumsum(times) + times, times)]
        width = len(self.asked.keys)
        cell, size = np.repeat(row, times) * width + query, len(n) * width
        sparse = np.bincount(cell, np.repeat(part, times), size).reshape(len(n), width)
        over = np.bincount(cell, minlength=size).reshape(len(n), width) / np.maximum(self.asked.sizes, 1)
        return rounded(sparse, self.digits), rounded(over, self.digits)


def slices(parts: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that a matrix of them with width columns has a million numbers at most."""
    step = max(1, (1 << 20) // max(1, width))
    for part in parts:
        for at in range(0, part.num_rows, step):
            yield part.slice(at, step)


class Best:
    """The k best of each query out of batches of scores, by falling score, then rising (or falling) key; a bounded number of them waits."""

    def __init__(self, width: int, k: int, down: bool = False) -> None:
        self.k, self.down, self.least, self.last, self.held, self.n = k, down, np.full(width, -np.inf), None, [], 0

    def add(self, scores: np.ndarray, keys: np.ndarray, where: np.ndarray | None = None) -> None:
        good = scores > self.least
        if self.last is not None:
            good |= (scores == self.least) & (np.greater if self.down else np.less).outer(keys, self.last)
        row, query = np.nonzero(good if where is None else good & where)
        self.held.append(pd.DataFrame({"q": query, "score": scores[row, query], "key": keys[row]}))
        self.n += len(row)
        if self.n > (1 << 19) + 2 * self.k * len(self.least):
            self.settle()

    def settle(self) -> pd.DataFrame:
        rows = pd.concat(self.held).sort_values(["q", "score", "key"], ascending=[True, False, not self.down], ignore_index=True) if self.held else pd.DataFrame({"q": np.zeros(0, int), "score": np.zeros(0), "key": []})
        place = rows.groupby("q").cumcount()
        last = rows[place == self.k - 1]
        if len(last):
            self.last = np.full(len(self.least), last.key.iloc[0]) if self.last is None else self.last  # looked at only where least is a score
            self.least[last.q.to_numpy()], self.last[last.q.to_numpy()] = last.score, last.key
        self.held = [rows[place < self.k]]
        self.n = len(self.held[0])
        return self.held[0]


def top_channels(docs: DataFrame, key: str, query_key: str, channels: Channels, k: int) -> DataFrame:
    """query_key, key, channel (0: BM25, 1: overlap), score and rank of the k best of each query in each channel, of scores above 0."""
    width, kind = len(channels.asked.keys), dict(docs.dtypes)[key]

    def run(parts):
        best = [Best(width, k), Best(width, k)]
        for part in slices(parts, width):
            for b, s in zip(best, channels.scores(_list(part, "m")), strict=True):
                b.add(s, _keys(part, key), s > 0)
        names = pa.array(channels.asked.keys)
        for c, b in enumerate(best):
            if not len(rows := b.settle()):
                continue
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows.q.to_numpy(np.int64))), pa.array(rows.key.to_numpy()), pa.array(np.full(len(rows), c, np.int32)), pa.array(rows.score.to_numpy(float))], [query_key, key, "channel", "score"])

    found = docs.select(key, "m").mapInArrow(run, f"`{query_key}` {channels.asked.kind}, `{key}` {kind}, channel int, score double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy(query_key, "channel").orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def _keys(part: pa.RecordBatch, name: str) -> np.ndarray:
    return _list(part, name).to_pandas().to_numpy()


def _list(part: pa.RecordBatch, name: str) -> pa.Array:
    c = part.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def fused_channels(docs: DataFrame, key: str, query_key: str, channels: Channels, k: int, constant: int = 60) -> tuple[DataFrame, DataFrame]:
    """The k best of each query by reciprocal rank fusion of both channels (query_key, key, rrf, rank), and the best of each channel as top_channels has them.

    Exact without ranks of all: the k best of one channel have 1 / (constant + k) at least, and what is behind rank constant + 2 k in both has less.
    So only those before it can be hits. Their ranks in the other channel are counted in one more pass: how many documents stand before each.
    """
    reach = constant + 2 * k + 1
    best = materialize(top_channels(docs, key, query_key, channels, reach), "channel-tops")
    width, at = len(channels.asked.keys), {q: i for i, q in enumerate(channels.asked.keys)}
    rows = best.select(query_key, key).distinct().toPandas()
    rows = pd.DataFrame({"q": rows[query_key].map(at).astype("int64"), "key": rows[key]})
    names, kind = pd.Index(pd.unique(rows.key)), dict(docs.dtypes)[key]

    def scored(parts):  # of the candidates, in both channels
        for part in slices(parts, width):
            keys = pd.Series(_keys(part, key))
            i = np.flatnonzero(keys.isin(names))
            if len(i):
                some = part.take(pa.array(i))
                sparse, over = channels.scores(_list(some, "m"))
                mine = rows.merge(pd.DataFrame({"key": keys.iloc[i].to_numpy(), "row": np.arange(len(i))}), on="key")
                yield pa.RecordBatch.from_arrays([pa.array(mine.q.to_numpy()), pa.array(mine.key.to_numpy()), pa.array(sparse[mine.row, mine.q]), pa.array(over[mine.row, mine.q])], ["q", "key", "s0", "s1"])

    found = docs.select(key, "m").mapInArrow(scored, f"q long, key {kind}, s0 double, s1 double").toPandas()
    order = np.sort(names.to_numpy())
    places = []  # by channel and query: candidates from the best on, as negative scores, keys, and both as one number
    span = 2 * len(order) + 1  # more than any code
    for c in ("s0", "s1"):
        own = found[found[c] > 0].sort_values(["q", c, "key"], ascending=[True, False, True], ignore_index=True)
        places.append({int(q): (s := -g[c].to_numpy(), k_ := g.key.to_numpy(), np.searchsorted(s, s) * span + 2 * np.searchsorted(order, k_) + 1) for q, g in own.groupby("q")})

    def counted(parts):  # how many documents stand between one candidate and the next
        seen = [{q: np.zeros(len(s) + 1, np.int64) for q, (s, *_) in p.items()} for p in places]
        for part in slices(parts if len(order) else [], width):
            keys = _keys(part, key)
            code = np.searchsorted(order, keys)
            code = 2 * code + (order[np.minimum(code, len(order) - 1)] == keys)  # odd: the key of a candidate, even: between two
            for p, n, score in zip(places, seen, channels.scores(_list(part, "m")), strict=True):
                for q, (s, _, both) in p.items():
                    i = np.flatnonzero(score[:, q] > 0)
                    mine = -score[i, q]
                    lo = np.searchsorted(s, mine)
                    same = np.flatnonzero(s[np.minimum(lo, len(s) - 1)] == mine)  # of equal scores the key decides
                    lo[same] = np.searchsorted(both, lo[same] * span + code[i[same]])
                    n[q] += np.bincount(lo, minlength=len(s) + 1)
        for c, n in enumerate(seen):
            for q, x in n.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(np.full(len(x), q, np.int64)), pa.array(np.arange(len(x))), pa.array(x)], ["c", "q", "place", "n"])

    before = docs.select(key, "m").mapInArrow(counted, "c int, q long, place long, n long").groupBy("c", "q", "place").agg(F.sum("n").alias("n")).toPandas().sort_values("place")
    ranks = []
    for (c, q), g in before.groupby(["c", "q"]):
        # a document counts at the place of the first candidate that it does not stand behind, a candidate at its own
        ranks.append(pd.DataFrame({"q": q, "key": places[c][q][1], "rank": np.cumsum(g.n.to_numpy())[:-1]}))
    spark, names = docs.sparkSession, channels.asked.keys
    ranks = pd.concat(ranks) if ranks else pd.DataFrame({"q": np.zeros(0, int), "key": [], "rank": []})
    both = spark.createDataFrame([(names[int(q)], k_.item() if hasattr(k_, "item") else k_, int(r)) for q, k_, r in ranks.itertuples(index=False)], f"`{query_key}` {channels.asked.kind}, `{key}` {kind}, rank long")
    return top(fuse([both], query_key, key, constant), query_key, key, "rrf", k), best


def dense(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, most: int = 4096) -> DataFrame:
    """query_key, key and cosine of every pair, from matrix products of batches of vectors with blocks of at most `most` queries, one after another.

    0 where a vector has no length; vectors of another width than the query's give nothing.
    """
    q = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("q is not null and v is not null")
    kind, own = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]
    shape = f"`{query_key}` {kind}, `{key}` {own}, score double"
    out = None
    blocks = max(1, -(-q.count() // most))
    numbered = q.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).orderBy("q").collect()  # a stated query set, block by block
        by_width: dict[int, tuple[list, list]] = {}
        for r in rows:
            names, values = by_width.setdefault(len(r.v), ([], []))
            names.append(r.q)
            values.append(r.v)
        unit = {w: (np.array(names, dtype=object), _units(np.array(values, dtype=float))) for w, (names, values) in by_width.items() if w}

        def run(parts, unit=unit):
            for part in parts:
                widths = part.v.map(lambda v: -1 if v is None else len(v)).to_numpy()
                for w, (names, m) in unit.items():
                    mine, step = np.flatnonzero(widths == w), max(1, (1 << 20) // len(names))
                    for some in (mine[at : at + step] for at in range(0, len(mine), step)):  # a million pairs at once
                        scores = _units(np.array(part.v.iloc[some].tolist(), dtype=float)) @ m.T
                        keys = part.k.to_numpy()[some]
                        yield pd.DataFrame({query_key: np.tile(names, len(some)), key: np.repeat(keys, len(names)), "score": scores.ravel()})

        made = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, shape)
        out = made if out is None else out.unionByName(made)
    return out


#: Numbers of one block of vectors at most, and rows of one at least.
BLOCK_NUMBERS, BLOCK_ROWS = 1 << 22, 4096


def dense_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int, digits: int = 6) -> DataFrame:
    """query_key, key, score and rank of each query's k vectors of the largest rounded cosine but the one of its own key, ties to the smaller key.

    Blocks of queries meet blocks of vectors, each pair of blocks in one task's matrix products, of which only the k best of a query go on. A product of
    single floats finds who may be among them, within its bound of error; these are scored in doubles. 0 where a vector has no length; widths must agree.
    """
    own, asked = dict(vectors.dtypes), dict(queries.dtypes)
    floats = lambda c, kind: F.col(c) if kind == "array<float>" else F.col(c).cast("array<double>")
    v = vectors.select(F.col(key).alias("k"), floats(vector, own[vector]).alias("v")).filter("k is not null and size(v) > 0 and not exists(v, x -> x is null)")
    q = queries.select(F.col(query_key).alias("q"), floats(query_vector, asked[query_vector]).alias("w")).filter("q is not null and size(w) > 0 and not exists(w, x -> x is null)")
    n, width = v.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, BLOCK_NUMBERS // max(1, width or 1))
    blocks = lambda n: -(-n // min(most, max(BLOCK_ROWS, -(-n // 6))))
    nv, nq = max(1, blocks(n)), max(1, blocks(q.count()))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("q", "w", F.pmod(F.xxhash64("q"), F.lit(nq)).cast("int").alias("qb"), each(nv).alias("vb"))
    right = v.select("k", "v", each(nq).alias("qc"), F.pmod(F.xxhash64("k"), F.lit(nv)).cast("int").alias("vc"))
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qc", "vc")).applyInArrow(_best_of(k, digits), f"q {asked[query_key]}, k {own[key]}, score double")
    ranks = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "k"))).filter(F.col("rank") <= k)
    return ranks.select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")


def rounded(x, digits: int):
    """Half away from zero, as SQL rounds."""
    y = x * 10.0**digits
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**digits


def _best_of(k: int, digits: int):
    """For cogroups of queries (q, w) and vectors (k, v): q, k and score of the k best of each query."""
    def sorted_rows(t: pa.Table, name: str, values: str):
        """By width: sorted keys, vectors and their squared lengths."""
        t = t.sort_by(name)
        lists = t[values].combine_chunks()
        flat, ends, n = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy()), lists.value_lengths().to_numpy()
        keys = t[name].combine_chunks()
        return {int(w): (keys.take(pa.array(i := np.flatnonzero(n == w))), flat[(ends[i] - w)[:, None] + np.arange(w)]) for w in np.unique(n)}

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [pa.table({"q": queries["q"].slice(0, 0), "k": vectors["k"].slice(0, 0), "score": pa.array([], pa.float64())})]
        stored = sorted_rows(vectors, "k", "v")
        for w, (names, a) in sorted_rows(queries, "q", "w").items():
            if w in stored:
                keys, b = stored[w]
                i, j, score = top_pairs(a, b, names.to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False))
                out.append(pa.table({"q": names.take(pa.array(i)), "k": keys.take(pa.array(j)), "score": score}))
        return pa.concat_tables(out)

    def top_pairs(a, b, names, keys):
        error = (a.shape[1] + 8) * 2.0**-23 + 10.0**-digits
        aa, bb = (np.concatenate([np.einsum("ij,ij->i", m[x : x + 4096], m[x : x + 4096], dtype=float) for x in range(0, len(m), 4096)]) for m in (a, b))
        unit = lambda m, mm: (np.divide(m, np.sqrt(mm)[:, None], out=np.zeros(m.shape), where=mm[:, None] > 0)).astype(np.float32)

        def exact(i, j):
            parts = [np.einsum("ij,ij->i", a[i[x : x + 65536]], b[j[x : x + 65536]], dtype=float) for x in range(0, len(i), 65536)]
            size = np.sqrt(aa[i] * bb[j])
            score = np.divide(np.concatenate(parts) if parts else np.zeros(0), size, out=np.zeros(len(i)), where=size > 0)
            return rounded(np.clip(score, -1.0, 1.0), digits)

        units, found = unit(b, bb), []
        for at in range(0, len(a), 512):
            mine = unit(a[at : at + 512], aa[at : at + 512])
            least = np.full(len(mine), -np.inf, np.float32)
            best, waiting, n = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

            def settle(best, waiting, least, at=at):
                i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
                other = names[i + at] != keys[j]
                i, j = i[other], j[other]
                i, j, s = (np.concatenate(x) for x in zip(best, (i, j, exact(i + at, j)), strict=True))
                order = np.lexsort((j, -s, i))  # rows of vectors stand in order of keys
                i, j, s = i[order], j[order], s[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                full = place == k - 1
                least[i[full]] = s[full] - 2 * error
                keep = place < k
                return i[keep], j[keep], s[keep]

            for begin in range(0, len(b), 4096):
                s = mine @ units[begin : begin + 4096].T
                if not begin and s.shape[1] > k:
                    least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - np.float32(2 * error)
                i, j = np.nonzero(s >= least[:, None])
                waiting.append((i, j + begin))
                n += len(i)
                if n > 8192:
                    best, waiting, n = settle(best, waiting, least), [], 0
            i, j, s = settle(best, waiting, least) if waiting else best
            found.append((i + at, j, s))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return run


def _units(m):
    """Rows brought to length 1; rows without a length stay 0."""
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


#: Channels of a search with their weights and the views that each looks at.
CHANNELS = {"query": (1.0, ("description", "metadata", "patch", "aggregate")), "poc": (1.3, ("poc", "description", "aggregate")), "component": (0.8, ("component", "aggregate"))}


def channel_scores(views: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """query_id, key, dense, sparse and best_view of every record, over the channels that its query has.

    views: key, view, text, vector; questions: query_id, channel, text, vector. Dense: the best cosine among the channel's views; sparse: BM25 over the texts
    of those views together; both are means weighted by channel. One pass of the views per channel, of which there are three.
    """
    parts = None
    for channel, (weight, names) in CHANNELS.items():
        asked = questions.filter(F.col("channel") == channel)
        if not asked.take(1):
            continue
        own = views.filter(F.col("view").isin(*names))
        texts = own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("view")).alias("i"), "text"))), lambda x: x["text"]), "\n").alias("text"))
        sparse = bm25(texts, asked.select("query_id", F.col("text").alias("asked")), key, "text", "query_id", "asked").withColumnRenamed("score", "sparse")
        named = own.withColumn("place", F.struct(F.col(key), F.col("view")))
        cosines = dense(named.select(F.to_json("place").alias("place"), "vector"), asked.select("query_id", F.col("vector").alias("asked")), "place", "vector", "query_id", "asked")
        pair = F.from_json("place", f"`{key}` {dict(views.dtypes)[key]}, view string")
        best = cosines.select("query_id", pair.alias("p"), "score").groupBy("query_id", F.col("p")[key].alias(key)).agg(F.max(F.struct("score", F.col("p.view").alias("view"))).alias("b"))
        both = best.select("query_id", key, F.col("b.score").alias("dense"), F.col("b.view").alias("best_view")).join(sparse, ["query_id", key], "left")
        rows = both.select("query_id", key, F.lit(weight).alias("weight"), "dense", F.coalesce("sparse", F.lit(0.0)).alias("sparse"), F.concat(F.lit(f"{channel}:"), "best_view").alias("best_view"))
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        raise ValueError("no channel has a text")
    weights = F.expr(" + ".join(f"if(array_contains(channels, '{c}'), {w}e0, 0e0)" for c, (w, _) in CHANNELS.items()))
    total = questions.groupBy("query_id").agg(F.collect_set("channel").alias("channels")).select("query_id", weights.alias("all_weights"))
    sums = parts.groupBy("query_id", key).agg(F.sum(F.col("weight") * F.col("dense")).alias("d"), F.sum(F.col("weight") * F.col("sparse")).alias("s"), F.array_sort(F.collect_list("best_view")).alias("best_views"))
    return sums.join(F.broadcast(total), "query_id").select("query_id", key, (F.col("d") / F.col("all_weights")).alias("dense"), (F.col("s") / F.col("all_weights")).alias("sparse"), "best_views")


def fused_hits(scores: DataFrame, key: str, mode: str = "hybrid", least: float | None = None, offset: int = 0, k: int = 10, named: DataFrame | None = None) -> DataFrame:
    """query_id, key, dense, sparse, rrf and rank of the hits after offset.

    least cuts by the dense score, for both lists. named (query_id, key): records that a query names, which come first. Ties go to the smaller key.
    """
    if mode not in ("hybrid", "dense", "sparse"):
        raise ValueError(f"no such mode: {mode}")
    if not 1 <= k <= 100 or not 0 <= offset <= 10_000 or (least is not None and not -1 <= least <= 1):
        raise ValueError("k must lie in 1..100, offset in 0..10000 and least in -1..1")
    s = scores if least is None else scores.filter(F.col("dense") >= least)
    lists = [ranked(s.select("query_id", key, F.col(c).alias("score")), "query_id", key) for c in (("dense", "sparse") if mode == "hybrid" else (mode,))]
    fused = fuse(lists, "query_id", key).join(s.select("query_id", key, "dense", "sparse"), ["query_id", key]).withColumn("rrf", F.round("rrf", 9))
    if named is not None:
        fused = fused.join(F.broadcast(named.select("query_id", key).distinct().withColumn("asked_for", F.lit(0))), ["query_id", key], "left")
    else:
        fused = fused.withColumn("asked_for", F.lit(1))
    w = W.partitionBy("query_id").orderBy(F.coalesce("asked_for", F.lit(1)), F.desc("rrf"), key)
    return fused.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") > offset) & (F.col("rank") <= offset + k)).drop("asked_for")


def prescored(docs: DataFrame, key: str, vector: str, query_key: str, queries: dict, channels: Channels, pool: int, share: float = 0.25) -> DataFrame:
    """query_key, key, prescore and place of the pool rows of each query with the largest cosine + share * overlap, ties to the greater key: what a second stage looks at.

    docs: key, m as of matched, and the vector as indexes and values of a unit vector; queries: query key to unit vector.
    """
    order, kind, terms = list(queries), dict(docs.dtypes)[key], channels.asked.keys
    matrix = np.array([queries[q] for q in order], dtype=float).reshape(len(order), -1)
    at = {q: i for i, q in enumerate(terms)}
    place = np.array([at.get(q, len(terms)) for q in order], np.int64)

    def run(parts):
        best = Best(len(order), pool, down=True)
        for part in slices(parts, max(len(order), matrix.shape[1])):
            lists = _list(part, vector)
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            own, x = np.zeros((part.num_rows, matrix.shape[1])), lists.flatten()
            own[row, x.field(0).to_numpy()] = x.field(1).to_numpy()
            over = channels.scores(_list(part, "m"))[1]
            over = np.concatenate([over, np.zeros((len(over), 1))], axis=1)[:, place]
            best.add(rounded(own @ matrix.T + share * over, channels.digits), _keys(part, key))
        if not len(rows := best.settle()):
            return
        yield pa.RecordBatch.from_arrays([pa.array(order).take(pa.array(rows.q.to_numpy(np.int64))), pa.array(rows.key.to_numpy()), pa.array(rows.score.to_numpy(float))], [query_key, key, "prescore"])

    found = docs.select(key, "m", vector).mapInArrow(run, f"`{query_key}` {channels.asked.kind}, `{key}` {kind}, prescore double")
    return found.withColumn("place", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("prescore"), F.desc(key)))).filter(F.col("place") <= pool)


def pool_size(offset: int, k: int) -> int:
    return max(2_000, min(12_000, offset + k + 1_000))


def hits_with_evidence(hits: DataFrame, records: DataFrame, evidence: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """hits with the record's columns, the terms that its text and the query share, and its two evidence texts of most shared terms, of 600 characters each."""
    asked = questions.select("query_id", F.explode(tokens(F.col("text"))).alias("t")).groupBy("query_id").agg(F.array_sort(F.collect_set("t")).alias("asked"))
    h = hits.join(F.broadcast(asked), "query_id", "left").join(records, key, "left")
    h = h.withColumn("matched_terms", F.array_intersect("asked", tokens(F.col("text"))))
    e = hits.select("query_id", key).join(F.broadcast(asked), "query_id").join(evidence.select(key, "evidence_id", F.col("text").alias("said")), key)
    e = e.withColumn("shared", F.size(F.array_intersect("asked", tokens(F.col("said"))))).withColumn("rn", F.row_number().over(W.partitionBy("query_id", key).orderBy(F.desc("shared"), "evidence_id"))).filter("rn <= 2")
    best = e.groupBy("query_id", key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring("said", 1, 600).alias("text")))), lambda x: x["text"]).alias("evidence"))
    return h.join(best, ["query_id", key], "left").drop("asked")


def view_similarity(left: DataFrame, right: DataFrame, pair: list[str], view: str, vector: str) -> DataFrame:
    """pair, view and score of the views that both records of a pair have; left and right: pair, view, vector."""
    a, b = left.select(*pair, view, F.col(vector).alias("v1")), right.select(*pair, view, F.col(vector).alias("v2"))
    return a.join(b, [*pair, view]).select(*pair, view, F.round(cosine(F.col("v1"), F.col("v2")), 6).alias("score"))


def ranked(scores: DataFrame, query_key: str, key: str, least: float = 0.0) -> DataFrame:
    """Ranks by falling score, then key, over scores above least. Scores are rounded first, so that order does not hang on the last bits of sums."""
    rounded = scores.withColumn("score", F.round("score", 9)).filter(F.col("score") > least)
    return rounded.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key)))


def fuse(channels: list[DataFrame], query_key: str, key: str, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked channels."""
    all_ranks = channels[0].select(query_key, key, "rank")
    for c in channels[1:]:
        all_ranks = all_ranks.unionByName(c.select(query_key, key, "rank"))
    return all_ranks.groupBy(query_key, key).agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("rrf"))


def top(scores: DataFrame, query_key: str, key: str, score: str, k: int, digits: int = 9) -> DataFrame:
    s = scores.withColumn(score, F.round(score, digits))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(F.desc(score), key))).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Filters:
    """Strict filters: what does not match stays out, even if nothing is left."""

    severity: str | None = None
    component: str | None = None
    weakness: str | None = None
    source: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    version: str | None = None
    cpes: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.version and not self.component:
            raise ValueError("a version needs a component")
        if any(split_cpe(x) is None for x in self.cpes):
            raise ValueError("cpes must be CPE 2.3 names")

    def applied(self, records: DataFrame) -> DataFrame:
        """The records that match, with version_match: what was found of the version or of the CPE names, else not_checked.

        Cheap conditions come first. A component with a version decides alone, without a look at the names, as does a conflict between sources on components.
        Versions need components, an array of structs with name, versions (JSON text), default_status and purl; names need applicability, JSON text of configurations.
        """
        kept = records.filter(self.condition())
        if self.version:
            if "conflicts" in records.columns:
                odd = F.array_contains("conflicts", "components")
            else:
                odd = F.lit(False)
            # versions are JSON text already and go in as they are
            one = lambda c: F.concat(F.rtrim(F.to_json(F.struct(c["name"].alias("name"), c["default_status"].alias("default_status"), c["purl"].alias("packageURL"))), F.lit("}")), F.when(c["name"].isNull() & c["default_status"].isNull() & c["purl"].isNull(), "").otherwise(","), F.lit('"versions":'), F.coalesce(F.nullif(c["versions"], F.lit("")), F.lit("[]")), F.lit("}"))
            parts = F.concat(F.lit("["), F.array_join(F.transform("components", one), ","), F.lit("]"))
            return kept.withColumn("version_match", named_status(parts, F.lit(self.component), F.lit(self.version), odd)).filter("version_match = 'affected'")
        if self.cpes:
            return kept.withColumn("version_match", cpe_applicability(F.col("applicability"), F.array(*map(F.lit, self.cpes)))).filter("version_match = 'affected'")
        return kept.withColumn("version_match", F.lit("not_checked"))

    def condition(self) -> Column:
        out = F.lit(True)
        if self.severity:
            out = out & (F.lower("severity") == self.severity.lower())
        if self.component:
            out = out & F.exists("components", lambda c: F.lower(c["name"]) == self.component.lower())
        if self.weakness:
            out = out & F.exists("weaknesses", lambda w: F.upper(w) == self.weakness.upper())
        if self.source:
            out = out & F.exists("sources", lambda s: F.lower(s) == self.source.lower())
        for name, value in self.columns.items():
            out = out & (F.lower(F.col(name).cast("string")) == value.lower())
        return out


def search(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, vectors: DataFrame | None = None, vector: str = "vector", query_vector: str = "query_vector", mode: str = "hybrid", filters: Filters = Filters(), least: float = 0.0, offset: int = 0, k: int = 10) -> DataFrame:
    """query_key, key, rrf and rank of the hits from offset on; modes hybrid, dense and sparse."""
    if mode not in ("hybrid", "dense", "sparse"):
        raise ValueError(f"no such mode: {mode}")
    if k < 1 or offset < 0:
        raise ValueError("k must be positive and offset not negative")
    kept = filters.applied(docs)
    channels = []
    if mode != "dense":
        channels.append(ranked(bm25(kept, queries, key, text, query_key, query_text), query_key, key, 0.0))
    if mode != "sparse":
        if vectors is None:
            raise ValueError("dense search needs vectors")
        own = vectors.join(kept.select(key), key, "left_semi")
        channels.append(ranked(dense(own, queries.select(query_key, query_vector), key, vector, query_key, query_vector), query_key, key, least))
    return top(fuse(channels, query_key, key), query_key, key, "rrf", offset + k).filter(F.col("rank") > offset)


def evaluate(ranks: DataFrame, relevant: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Macro recall@k, MRR and nDCG@k over the queries of relevant (query_key, key); ranks has rank as well."""
    hits = ranks.filter(F.col("rank") <= k).join(relevant, [query_key, key])
    return evaluate_hits(hits, relevant.groupBy(query_key).agg(F.count("*").alias("total")), query_key, k)


def evaluate_hits(hits: DataFrame, total: DataFrame, query_key: str, k: int) -> DataFrame:
    """The same from relevant hits (query_key, rank) of rank k at most and how many rows are relevant to each query (query_key, total)."""
    gain = F.lit(1.0) / (F.log(F.col("rank") + 1.0) / F.log(F.lit(2.0)))
    got = hits.groupBy(query_key).agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / (F.log(i + 1.0) / F.log(F.lit(2.0))))
    per = total.join(got, query_key, "left").select((F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))
    return per.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
