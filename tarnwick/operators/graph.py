"""Connected components, families that share content, and near-duplicate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.runtime import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. The least neighbour of a node comes from a pre-aggregated groupBy, and a join carries it to the node's edges, so no neighbour list is collected."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
    out = both.join(least, F.col("u") == F.col("w"))
    if large:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component, its least member, for every node of edges (u, v), by alternating large-star and small-star rounds (Kiveris et al., 2014).

    Nodes are longs or strings. Each round is written to the shared folder and the one before it is removed.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = materialize(e, "edges")
    sign = None
    for _ in range(rounds):
        before, e = e, materialize(_star(_star(e, True), False), "edges")
        discard(before)
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if sign == (r.n, r.h):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        sign = (r.n, r.h)
    raise RuntimeError("components did not settle")


def star_edges(members: DataFrame, group: str, node: str) -> DataFrame:
    """u, v: an edge from each member of a group to its least one, which connects what all pairs would."""
    heads = members.groupBy(group).agg(F.min(node).alias("v"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return members.join(heads, group).select(F.col(node).alias("u"), "v").filter("u <> v").distinct()


def families(nodes: DataFrame, node: str, shared: list[DataFrame], seed: str) -> DataFrame:
    """node, family and split of every node: families are components over what nodes share.

    shared: tables (group, node): an artifact, a content, a chunk or a description and who has it. Groups may name nodes that
    nodes lacks; these join families but get no row. A family's name is its least member, and its split is the name's.
    """
    from tarnwick.functions.text import split_bucket

    edges = None
    for members in shared:
        m = members.select(F.col(members.columns[0]).alias("g"), F.col(members.columns[1]).alias("n")).filter("g is not null and n is not null").distinct()
        own = star_edges(m, "g", "n")
        edges = own if edges is None else edges.unionByName(own)
    found = components(edges)
    out = nodes.select(node).distinct().join(found, F.col(node) == F.col("node"), "left").select(node, F.coalesce("component", node).alias("family"))
    return out.withColumn("split", split_bucket(F.col("family").cast("string"), seed))


#: Places of the table that orders tokens, longs of a set's bit picture, and rows of a block in which pairs are looked through.
PLACES, LONGS, BLOCK_BITS = 1 << 20, 16, 10


def jaccard_pairs(sets: DataFrame, key: str, tokens: str, percent: int) -> DataFrame:
    """left, right and score of near duplicates: all pairs of different token sets with 100 * intersection >= percent * union, by the least keys
    that have them, and for every other row with one of these or any set, its least key and 1.0.

    Rarest tokens first, two sets that qualify share one of the first n - ceil(percent * n / 100) + 1 of each; at the first that they share, sizes,
    places and bit pictures bound what they can share. Only keys go from there on: blocks of sets of like least hash meet once for all of their pairs.
    Copies meet in a pre-aggregated groupBy, never in pairs. Tokens of near duplicates are held as 64-bit hashes. Empty and null sets pair with nothing.
    """
    whole = sets.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("t")).filter("k is not null and size(t) > 0")
    d = whole.select("k", F.sha2(F.array_join("t", "\x1f"), 256).alias("h"), F.array_sort(F.array_distinct(F.transform("t", lambda x: F.xxhash64(x)))).alias("a"))
    small = materialize(d.select("k", "h", F.col("a")[0].alias("m")), "pair-sets")
    heads = small.groupBy("h").agg(F.min(F.struct("k", "m")).alias("s")).select("h", "s.*")
    copies = small.select("k", "h").join(heads.select("h", F.col("k").alias("head")), "h").filter("k <> head").select(F.col("head").alias("left"), F.col("k").alias("right"), F.lit(1.0).alias("score"))
    blocked = materialize(heads.repartitionByRange("m", "k").sortWithinPartitions("m", "k").select("k", "h", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")), "pair-blocks")
    own = materialize(d.join(blocked, ["k", "h"]).select("k", "block", "a").dropDuplicates(["k"]), "pair-heads")
    entries = materialize(_prefixes(own, percent), "pair-prefixes")
    side = lambda of, i: entries.select("token", F.col("k").alias(of), *[F.col(c).alias(f"{c}{i}") for c in ("n", "rank", "block", "bits")])
    close = f"left < right and 100 * least(n1, n2) >= {percent} * greatest(n1, n2) and {100 + percent} * (1 + least(n1 - rank1, n2 - rank2)) >= {percent} * (n1 + n2)"
    apart = " + ".join(f"bit_count(bits1[{i}] ^ bits2[{i}])" for i in range(LONGS))  # tokens that only one of both has, at least
    pairs = side("left", 1).join(side("right", 2), "token").filter(f"{close} and {100 + percent} * ({apart}) <= {100 - percent} * (n1 + n2)")
    pairs = materialize(pairs.select("left", "right", F.col("block1").alias("b1"), F.col("block2").alias("b2")).distinct(), "pair-keys")
    asked = pairs.select("b1", "b2", F.col("left").alias("k")).unionByName(pairs.select("b1", "b2", F.col("right").alias("k"))).distinct()
    shape = f"left {dict(d.dtypes)['k']}, right {dict(d.dtypes)['k']}, score double"
    named = asked.join(own.select("k", "a"), "k").select(F.col("b1").alias("c1"), F.col("b2").alias("c2"), "k", "a")
    near = pairs.groupBy("b1", "b2").cogroup(named.groupBy("c1", "c2")).applyInArrow(_met(percent), shape)
    return near.unionByName(copies)


def _prefixes(own: DataFrame, percent: int) -> DataFrame:
    """token, k, n, rank, block and bits of the prefixes of sets (k, block, a), least frequent tokens first, without those that only one set has."""
    import numpy as np
    import pyarrow as pa

    place = F.pmod("x", F.lit(PLACES)).cast("int")
    counted = own.select(F.explode("a").alias("x")).groupBy(place.alias("p")).agg(F.count("*").alias("c")).toArrow()
    often = np.zeros(PLACES, np.int64)  # orders tokens only; a place that was counted once has a token of one set
    often[counted["p"].to_numpy()] = counted["c"].to_numpy()

    def run(parts):
        for part in parts:
            lists = part.column("a").combine_chunks() if isinstance(part.column("a"), pa.ChunkedArray) else part.column("a")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            bits = np.zeros((len(n), LONGS), np.uint64)
            high = x.view(np.uint64) >> np.uint64(40)
            np.bitwise_or.at(bits, (row, (high >> np.uint64(6)).astype(np.int64) % LONGS), np.uint64(1) << (high & np.uint64(63)))
            order = np.lexsort((x, f := often[x % PLACES], row))
            rank = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + 1
            x, f, last = x[order], f[order], (n + (-percent * n // 100) + 1)[row]
            kept = np.flatnonzero((rank <= last) & (f > 1))
            at = row[kept]
            pictures = pa.ListArray.from_arrays(np.arange(0, LONGS * len(kept) + 1, LONGS, dtype=np.int32), pa.array(bits.view(np.int64)[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]), part.column("k").take(pa.array(at)), pa.array(n[at]), pa.array(rank[kept]), part.column("block").take(pa.array(at)), pictures], ["token", "k", "n", "rank", "block", "bits"])

    return own.mapInArrow(run, f"token long, k {dict(own.dtypes)['k']}, n long, rank long, block long, bits array<long>")


def _met(percent: int):
    """For cogroups of pairs (left, right) of two blocks and the sets (k, a) that they name: the pairs that qualify and their scores."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        keys, lists = sets["k"].combine_chunks(), sets["a"].combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        names, x = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        index = lambda c: pc.index_in(pairs[c].combine_chunks(), keys).to_numpy(zero_copy_only=False)
        left, right = index("left"), index("right")
        order = np.argsort(left, kind="stable")
        cuts = np.flatnonzero(np.diff(left[order], prepend=-1))
        shared, held = np.zeros(len(left), np.int64), np.zeros(len(names), bool)
        for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own, i = order[lo:hi], left[order[lo]]
            mine = x[ends[i] - n[i] : ends[i]]
            held[mine] = True
            for at in range(0, len(own), 1024):
                some = right[own[at : at + 1024]]
                begins = np.cumsum(n[some]) - n[some]
                places = np.arange(n[some].sum()) + np.repeat(ends[some] - n[some] - begins, n[some])
                shared[own[at : at + 1024]] = np.add.reduceat(held[x[places]].astype(np.int64), begins)
            held[mine] = False
        both = n[left] + n[right] - shared
        good = np.flatnonzero(100 * shared >= percent * both)
        return pa.table({"left": pairs["left"].take(pa.array(good)), "right": pairs["right"].take(pa.array(good)), "score": pa.array(shared[good] / both[good])})

    return run


def pairs_of_disjoint_labels(rows: DataFrame, key: str, labels: str, most: int) -> DataFrame:
    """The first pairs, by left key, then right key, whose label sets are both filled and share nothing; most bounds the report.

    Rows are grouped by their whole label set, so that sets are compared, not rows: the number of different sets is what grows. A left row
    needs most partners at most, and left rows are taken in order until the report is full. Of right rows only the first of each set and each
    stretch between left keys go on, so what meets does not grow with the rows.
    """
    d = rows.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(labels)).alias("s")).filter("size(s) > 0")
    sets = d.groupBy("s").agg(F.max("k").alias("last"))
    apart = sets.select(F.col("s").alias("s1")).join(sets.select(F.col("s").alias("s2"), "last"), F.expr("not arrays_overlap(s1, s2)"))
    ends = apart.groupBy(F.col("s1").alias("s")).agg(F.max("last").alias("last"))
    lefts = materialize(d.join(ends, "s").filter("k < last").orderBy("k").limit(most), "pair-lefts")  # each has a partner at least
    # between two left keys, and after the last, only the first rows of each set can be in the report
    bounds = F.broadcast(lefts.agg(F.array_sort(F.collect_list("k")).alias("l")))
    band = F.when(F.col("k") > F.element_at("l", -1), F.size("l")).when(F.col("k") <= F.get("l", F.lit(0)), 0).otherwise(F.size(F.filter("l", lambda x: x < F.col("k"))))
    rights = d.filter("k is not null").join(bounds, F.size("l") > 0).withColumn("band", band).filter("band > 0").select("k", "s", "band")
    firsts = rights.withColumn("place", F.row_number().over(W.partitionBy("s", "band").orderBy("k"))).filter(f"place <= {most}")
    pairs = lefts.select(F.col("k").alias("left"), F.col("s").alias("s1")).join(apart, "s1")
    partners = pairs.join(firsts.select(F.col("k").alias("right"), F.col("s").alias("s2")), "s2").filter("left < right")
    few = partners.withColumn("rn", F.row_number().over(W.partitionBy("left").orderBy("right"))).filter(f"rn <= {most}")
    return few.select("left", "right").orderBy("left", "right").limit(most)


def cohesion(vectors: DataFrame, cluster: str, key: str, similarity: Column) -> DataFrame:
    """cluster, size, medoid (the key closest to its centroid) and cohesion (the mean similarity)."""
    s = vectors.withColumn("s", similarity)
    return s.groupBy(cluster).agg(F.count("*").alias("size"), F.min_by(key, F.struct(-F.round("s", 9), F.col(key))).alias("medoid"), F.avg("s").alias("cohesion"))
