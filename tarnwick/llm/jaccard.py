"""Exact n-gram Jaccard join with a token-group matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.operators.graph import components
from tarnwick.runtime import materialize, ship, table

from .bytetext import U64, give_back, lowered, mix, pieces, text_bytes, tidied, word_hashes, words_of
from .rows import shielded

ROW = "tw_row"


@dataclass(frozen=True)
class JoinRules:
    """words in a shingle; links hold where 100 * intersection >= percent * union.

    more: linking sets must share so many prefix tokens, in percent of the smaller set, and prefixes are longer by as many; sketch_bits: binary logarithm of the size of the table of frequencies, an ordering aid; draws: rounds in which groups join larger ones, which decide only who meets in which task; block: members of a group that are opened at once; queries: queries that one task holds against a block.
    """

    words: int = 4
    percent: int = 85
    more: int = 8
    sketch_bits: int = 23
    draws: int = 2
    block: int = 512
    queries: int = 2048
    piece_bytes: int = 1 << 20


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row of a batch, as sorted 48-bit hashes, and the offsets of the rows. At most 65,536 rows."""
    data, offsets = text_bytes(column)
    data = lowered(data)
    n = len(offsets) - 1
    start, end, row = words_of(data, offsets)
    if not len(start):
        return np.empty(0, U64), np.zeros(n + 1, np.int64)
    h = word_hashes(data, start, end)
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    with np.errstate(over="ignore"):
        combined = np.zeros(len(h), U64)
        position = np.arange(len(h))
        left = first[row + 1] - position
        for k in range(words):  # words past the row's end take no part
            inside = np.flatnonzero(left > k)
            combined[inside] = mix(combined[inside] * U64(0x9E3779B97F4A7C15) + h[inside + k] + U64(k))
    whole = left >= words
    whole |= (position == first[row]) & (count[row] < words)
    combined, owner = combined[whole], row[whole]
    packed = (owner.astype(U64) << U64(48)) | (combined >> U64(16))
    packed.sort()
    packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    sizes = np.bincount((packed >> U64(48)).astype(np.int64), minlength=n)
    return packed & U64((1 << 48) - 1), np.concatenate(([0], np.cumsum(sizes)))


def set_hashes(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of mixed tokens for each row: equal sets have equal ones."""
    out = []
    for salt in (U64(0x1234567), U64(0x89ABCDEF01)):
        with np.errstate(over="ignore"):
            sums = np.concatenate(([U64(0)], np.cumsum(mix(tokens + salt), dtype=U64)))
            out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def prefix_lengths(sizes: np.ndarray, percent: int, more: int) -> np.ndarray:
    """Two sets that link share at least `more` percent of the smaller one's size, rounded up, among so many first tokens of each, in any common order."""
    return np.where(sizes > 0, sizes - (percent * sizes + 99) // 100 + (more * sizes + 99) // 100, 0)


def frequency_classes(docs: DataFrame, rules: JoinRules) -> np.ndarray:
    """At the place of a shingle's low hash bits: the binary logarithm of how often texts have shingles of that place.

    Every shingle of every text counts, so that one that many texts share comes late in every order. The table's size is fixed
    (at most 2 ** sketch_bits bytes); it only orders tokens, and any order gives the same links.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = min(rules.sketch_bits, max(12, int(size // 8).bit_length()))
    part_bits = min(bits, 14)
    low, parts, wide = U64((1 << bits) - 1), 1 << (bits - part_bits), 1 << part_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for piece in pieces(batch, "text", rules.piece_bytes):
                at = (shingle_sets(piece.column(0), rules.words)[0] & low).astype(np.int64)
                at.sort()
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
                counts[at[first]] += np.diff(np.concatenate((first, [len(at)]))).astype(np.uint32)
        for p in range(parts):  # each part as small counts, where few are empty, and as places and counts of the others
            own = counts[p * wide : (p + 1) * wide]
            filled = np.flatnonzero(own)
            dense = len(filled) * 6 > wide
            over = np.flatnonzero(own > 255) if dense else filled
            if len(filled):
                rest = own[over] - 255 if dense else own[over]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.minimum(own, 255).astype(np.uint8).tobytes() if dense else b""]), pa.array([over.astype(np.uint16).tobytes()]), pa.array([rest.astype(np.uint32).tobytes()])], ["part", "small", "place", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, small, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = held.setdefault(p, np.zeros(wide, np.int64))
                if small:
                    total += np.frombuffer(small, np.uint8)
                total[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.uint32)
        for p, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()])], ["part", "classes"])

    counted = docs.select("text").mapInArrow(tidied(count), "part int, small binary, place binary, n binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in counted.repartition("part").mapInArrow(tidied(add), "part int, classes binary").collect():
        out[r.part * wide : (r.part + 1) * wide] = np.frombuffer(r.classes, np.uint8)
    return out


def signatures(docs: DataFrame, classes: np.ndarray, rules: JoinRules) -> DataFrame:
    """doc_id, n, h1, h2 and the first tokens, in order of class and hash, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in pieces(batch, "text", rules.piece_bytes):
                tokens, offsets = shingle_sets(part.column(1), rules.words)
                sizes = np.diff(offsets)
                kind = table[(tokens & U64(len(table) - 1)).astype(np.int64)]
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((tokens, kind, row))
                lengths = prefix_lengths(sizes, rules.percent, rules.more)
                take = (np.arange(len(tokens)) - offsets[row]) < lengths[row]
                first = tokens[order][take]
                h1, h2 = set_hashes(tokens, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array(h1), pa.array(h2), lists], ["doc_id", "n", "h1", "h2", "prefix"])

    return docs.mapInArrow(tidied(run), "doc_id long, n long, h1 long, h2 long, prefix array<long>")


def open_groups(members: pd.DataFrame, queries: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between queries and the members of one block of a group.

    The block's token union bounds each query's overlap with any member: a query opens the block only if the union holds
    enough of its tokens, and then all overlaps are counted at once. A token that most members have lists those that lack it, so that
    a query costs what the members differ in, not what near copies share.
    """
    out: list[tuple[int, int]] = []
    ids = members.doc_id.to_numpy()
    sets = [np.asarray(t, np.int64) for t in members.tokens]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    union, counts = flat[at], np.diff(np.concatenate((at, [len(flat)])))
    much = 2 * counts > len(sets)  # their owners are replaced by the others
    token = np.repeat(np.arange(len(union)), counts)
    often = much[token]
    lacks = np.ones((int(much.sum()), len(sets)), dtype=bool)
    lacks[(np.cumsum(much) - 1)[token[often]], owner[often]] = False
    which, who = np.nonzero(lacks)
    token, owner = np.concatenate((token[~often], np.flatnonzero(much)[which])), np.concatenate((owner[~often], who))
    order = np.argsort(token, kind="stable")
    owner, ends = owner[order], np.searchsorted(token[order], np.arange(len(union) + 1))
    sign = np.where(much, -1, 1)
    for q, tokens in zip(queries.doc_id.to_numpy(), queries.tokens, strict=True):
        tokens = np.asarray(tokens, np.int64)
        n = len(tokens)
        place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        place = place[union[place] == tokens]
        if 100 * len(place) < percent * n:
            continue
        lengths = ends[place + 1] - ends[place]
        steps = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(ends[place], lengths)
        count = much[place].sum() + np.bincount(owner[steps], np.repeat(sign[place], lengths), len(sets)).astype(np.int64)
        linked = np.flatnonzero((100 * count >= percent * (n + sizes - count)) & (ids != q))
        out += [(int(q), int(ids[m])) for m in linked]
    return out


def spanning(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the links of one task as connect what all of them connect."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    out = []
    for u, v in links:
        a, b = root(u), root(v)
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def fitted(docs: DataFrame, by_doc: DataFrame, most_broadcast: int = 64 << 20) -> DataFrame:
    """docs joined with by_doc on doc_id: by broadcast while its rows, measured, are few, else by a shuffle."""
    n = by_doc.agg(F.sum(F.size("roles") * 48 + 64).alias("n")).first().n or 0
    return docs.join(F.broadcast(by_doc) if n <= most_broadcast else by_doc, "doc_id")


def _verified(docs: DataFrame, candidates: DataFrame, grouped: DataFrame, rules: JoinRules) -> DataFrame:
    """Edges (u, v) between queries and members of the groups that they are candidates for.

    candidates: query, group; grouped: doc_id, group, block, the members that may be opened. Texts get their roles, and their sets go straight
    from the text to the tasks that compare them. A task holds one block of a group and one crowd of its queries.
    """
    crowds = candidates.groupBy("group").agg(F.ceil(F.count("*") / rules.queries).alias("crowds"))
    blocks = grouped.groupBy("group").agg((F.max("block") + 1).alias("blocks"))
    size = crowds.join(blocks, "group").withColumnRenamed("group", "g")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = grouped.join(size, F.col("group") == F.col("g")).select("doc_id", "group", "block", upto("crowds").alias("crowd"), F.lit(0).alias("role"))
    right = candidates.join(size, F.col("group") == F.col("g")).select(F.col("query").alias("doc_id"), "group", upto("blocks").alias("block"), F.pmod(F.xxhash64("query"), F.col("crowds")).alias("crowd"), F.lit(1).alias("role"))
    roles = materialize(left.unionByName(right).groupBy("doc_id").agg(F.collect_list(F.struct("group", "block", "crowd", "role")).alias("roles")), "jaccard-roles")
    kinds = [("group", pa.int64()), ("block", pa.int64()), ("crowd", pa.int64()), ("role", pa.int32())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", rules.piece_bytes):
                tokens, offsets = shingle_sets(part.column(1), rules.words)
                ids, lists = part.column(0), part.column(2)
                counts = np.diff(np.asarray(lists.offsets))
                owner = np.repeat(np.arange(len(counts)), counts)
                flat = lists.flatten()
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.view(np.int64)))
                held = np.cumsum(np.diff(offsets)[owner]) // (1 << 20)
                for h in np.unique(held):
                    rows = np.flatnonzero(held == h)
                    take, who = pa.array(rows), pa.array(owner[rows])
                    columns = [flat.field(k).take(take).cast(t) for k, (_, t) in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*columns, ids.take(who), sets.take(who)], [*(k for k, _ in kinds), "doc_id", "tokens"])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        member = rows.role == 0
        members, queries = rows[member], rows[~member]
        links = open_groups(members, queries, rules.percent) if len(members) and len(queries) else []
        give_back()
        return pd.DataFrame(spanning(links), columns=["u", "v"]).astype("int64")

    dealt = fitted(docs, roles).select("doc_id", "text", "roles").mapInArrow(tidied(deal), "group long, block long, crowd long, role int, doc_id long, tokens array<long>")
    return dealt.groupBy("group", "block", "crowd").applyInPandas(solve, "u long, v long")


def heads_of(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of signed that stand for their sets, and doc_id and head of all others that have a set.

    The least key of equal sets comes from a pre-aggregated groupBy, so a class of any size costs one row a task; only rows of classes with
    several are looked up in it.
    """
    usable = signed.filter("doc_id is not null and n > 0")
    same = ["n", "h1", "h2"]
    several = usable.groupBy(*same).agg(F.min("doc_id").alias("head"), F.count("*").alias("c")).filter("c > 1").drop("c")
    rest = materialize(usable.select("doc_id", *same).join(several, same).filter("doc_id <> head"), "jaccard-copies")
    # by a shuffle at every size, so that its cost grows with the input alone
    return usable.join(rest.select("doc_id", *same).distinct().hint("merge"), ["doc_id", *same], "left_anti"), rest.select("doc_id", "head")


def token_lists(heads: DataFrame, rules: JoinRules) -> DataFrame:
    """token, doc_id, n and hub of the prefix tokens that two heads of fitting sizes share.

    Rows arrive by token, sorted by size, and stream. A list's first head is its hub until a head is too large for it, which becomes the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_n, before = None, 0, None  # before: the last row seen and whether it has been given
        for batch in batches:
            token, doc, n = (batch.column(i).to_numpy() for i in range(3))
            same = np.zeros(len(token) + 1, dtype=bool)  # whether a row fits the one before it
            same[1:-1] = (token[1:] == token[:-1]) & (rules.percent * n[1:] <= 100 * n[:-1])
            same[0] = before is not None and before[0] == token[0] and rules.percent * int(n[0]) <= 100 * before[2]
            out: list[tuple[int, int, int, int]] = []
            if before is not None and same[0] and not before[4]:
                out.append(before[:4])
            shared = same[:-1] | same[1:]
            for i in np.flatnonzero(shared):
                t, d, k = int(token[i]), int(doc[i]), int(n[i])
                if not same[i] or rules.percent * k > 100 * hub_n:
                    hub, hub_n = d, k
                out.append((t, d, k, hub))
            i = len(token) - 1
            if not shared[i]:
                hub, hub_n = int(doc[i]), int(n[i])
            before = (int(token[i]), int(doc[i]), int(n[i]), hub, bool(shared[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["token", "doc_id", "n", "hub"])

    entries = heads.select(F.explode("prefix").alias("token"), "doc_id", "n")
    return entries.repartition("token").sortWithinPartitions("token", "n", "doc_id").mapInArrow(tidied(run), "token long, doc_id long, n long, hub long")


def token_groups(entries: DataFrame, heads_in: DataFrame) -> DataFrame:
    """The token-group matrix: token, group and the least and most size of the group's sets that have the token, for tokens of several groups."""
    own = entries.select("token", "doc_id", "n").join(heads_in.select("doc_id", "group").hint("merge"), "doc_id")
    own = own.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return own.withColumn("groups", F.count("*").over(W.partitionBy("token"))).filter("groups > 1").drop("groups")


def moves_up(matrix: DataFrame, heads_in: DataFrame, rules: JoinRules, enough: str) -> DataFrame:
    """g and hub: groups, and the larger group that each joins.

    At every token the largest group of a span of sizes is offered to the others there, so a token costs a row for each group and span, never
    a pair of groups. A group joins the largest one that is offered through half of the tokens that a link takes, unless others join it. Near
    copies of one text, whose stars have different hubs, come together this way, though few of them link.
    """
    sizes = heads_in.groupBy("group").agg(F.count("*").alias("members"))
    at = F.floor(F.log("least") / math.log(100 / min(rules.percent, 99)))  # groups of fitting sizes meet in one of two spans
    placed = matrix.join(sizes.hint("merge"), "group").withColumn("span", F.explode(F.array(at - 1, at)))
    top = F.max(F.struct("members", F.bitwise_not("group").alias("not_hub"), "least", "most")).alias("top")
    tops = placed.groupBy("token", "span").agg(top, F.count("*").alias("groups")).filter("groups > 1").drop("groups")
    fitting = f"group <> ~top.not_hub and {rules.percent} * least <= 100 * top.most and {rules.percent} * top.least <= 100 * most"
    offered = placed.join(tops.hint("merge"), ["token", "span"]).filter(fitting).select("token", "group", F.least("least", "top.least").alias("n"), "top.members", "top.not_hub")
    offers = offered.groupBy("group", "members", "not_hub").agg(F.countDistinct("token").alias("common"), F.min("n").alias("n")).filter(f"2 * common >= {enough}")
    best = offers.groupBy("group").agg(F.max(F.struct("members", "common", "not_hub")).alias("b")).select(F.col("group").alias("g"), F.bitwise_not("b.not_hub").alias("hub"))
    best = materialize(best, "jaccard-offers")
    return best.join(best.select(F.col("hub").alias("g")).distinct(), "g", "left_anti")


def jaccard_components(docs: DataFrame, rules: JoinRules = JoinRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id, the least key reachable by links, of every row.

    1. Rows with the same set are one class, whose least key, the head, stands for it. 2. Heads that link share prefix tokens
    (in one order, common ones last). The head that draws most others through such tokens is their hub; a hub and those
    that it draws form a group of similar sets, and each is compared with its hub. Groups then join larger ones that share
    tokens with them, so that near copies of one text are one group, of any size, and not many that meet in pairs. 3. The token-group matrix holds, for every prefix token, the
    groups with it, once each, and the sizes of their sets that have it. Two groups whose unions share enough tokens between sets of fitting sizes
    meet, unless all of both is in one component by now: the members of the smaller one are queries for the other, and those of a group that
    is not in one component are for their own. The union of a block of members bounds a query's overlap with any; only a block that
    reaches the bound is opened. 4. All links found give the components.

    Texts of any length are read whole. Null or empty text, or one without words: no shingles, its own component. A null key takes part in no links and its
    component is null. Rows that share a key count as one: a link of either joins both. Other columns are ignored; an empty table gives none.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = materialize(signatures(d, frequency_classes(d.select("text"), rules), rules), "jaccard-signed")
    heads, copied = heads_of(signed)
    copies = copied.select(F.col("doc_id").alias("u"), F.col("head").alias("v"))
    entries = materialize(token_lists(heads, rules), "jaccard-lists")
    enough = f"greatest(1, ceil({rules.more} * ceil({rules.percent} * n / 100) / 100))"
    shared = entries.filter("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count("*").alias("common"), F.first("n").alias("n")).filter(f"2 * common >= {enough}")
    shared = materialize(shared, "jaccard-hubs")
    drawn = shared.groupBy("hub").agg(F.count("*").alias("drawn")).withColumnRenamed("hub", "h")
    choice = F.max(F.struct("drawn", "common", (-F.col("hub")).alias("hub")))
    best = materialize(shared.join(drawn, F.col("hub") == F.col("h")).groupBy("doc_id").agg(choice.alias("b")).select(F.col("doc_id").alias("query"), (-F.col("b.hub")).alias("group")), "jaccard-best")
    hubs = best.select("group").distinct()
    near = materialize(_verified(d, best, hubs.select(F.col("group").alias("doc_id"), "group", F.lit(0).cast("long").alias("block")), rules), "jaccard-near")

    linked = components(near).selectExpr("node as n1", "component")
    stars = best.join(hubs.withColumnRenamed("group", "hub"), F.col("query") == F.col("hub"), "left_anti").selectExpr("query as q1", "group")
    heads_in = entries.select("doc_id").distinct().join(stars, F.col("doc_id") == F.col("q1"), "left").join(linked, F.col("doc_id") == F.col("n1"), "left")
    heads_in = materialize(heads_in.select("doc_id", F.coalesce("group", "doc_id").alias("group"), F.coalesce("component", "doc_id").alias("component")), "jaccard-groups")
    matrix = materialize(token_groups(entries, heads_in), "jaccard-matrix")
    for _ in range(rules.draws):
        moves = materialize(moves_up(matrix, heads_in, rules, enough), "jaccard-moves")
        if moves.isEmpty():
            break
        moved = lambda df: df.join(moves, F.col("group") == F.col("g"), "left").withColumn("group", F.coalesce("hub", "group")).drop("g", "hub")  # noqa: E731, B023
        heads_in = materialize(moved(heads_in), "jaccard-groups")
        matrix = materialize(moved(matrix).groupBy("token", "group").agg(F.min("least").alias("least"), F.max("most").alias("most")), "jaccard-matrix")
    one = heads_in.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    one = materialize(one.select(F.col("group").alias("g"), "members", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("only")), "jaccard-sizes")
    other = matrix.select(F.col("token").alias("t"), F.col("group").alias("other"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    fitting = F.expr(f"token = t and group < other and {rules.percent} * least <= 100 * most2 and {rules.percent} * least2 <= 100 * most")
    pairs = matrix.join(other, fitting).groupBy("group", "other").agg(F.count("*").alias("common"), F.min(F.least("least", "least2")).alias("n")).filter(f"common >= {enough}")
    a, b = (one.select(*[F.col(c).alias(c + x) for c in one.columns]) for x in "12")
    pairs = pairs.join(a, F.col("group") == F.col("g1")).join(b, F.col("other") == F.col("g2")).filter("only1 is null or only2 is null or only1 <> only2")
    # the smaller group asks, the larger one is opened
    small = F.col("members1") < F.col("members2")
    pairs = pairs.select(F.when(small, F.col("group")).otherwise(F.col("other")).alias("asks"), F.when(small, F.col("other")).otherwise(F.col("group")).alias("opens"))
    across = pairs.join(heads_in, F.col("asks") == F.col("group")).select(F.col("doc_id").alias("query"), F.col("opens").alias("group"))
    within = heads_in.join(one, F.col("group") == F.col("g")).filter("members > 1 and only is null").select(F.col("doc_id").alias("query"), "group")
    candidates = across.unionByName(within)
    candidates = materialize(candidates, "jaccard-candidates")
    members = heads_in.select("doc_id", "group").join(candidates.select("group").distinct(), "group", "left_semi")
    many = members.groupBy("group").agg(F.ceil(F.count("*") / rules.block).alias("blocks")).withColumnRenamed("group", "g")
    members = members.join(many, F.col("group") == F.col("g")).select("doc_id", "group", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"))
    links = near.unionByName(_verified(d, candidates, members, rules)).unionByName(copies)
    found = components(links).withColumnRenamed("node", "n0")
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("n0"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


@shielded
def one_of_each(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """One row of docs of each component: that of the least key, then the least hash of its text; null keys come last.

    Rows are told apart by a number of their own where keys repeat or are null, so that only what a row's text links to counts. A row
    without words, which links to none, stays. Texts of any length are read whole; other columns stay; an empty table gives none.
    """
    key = F.col("doc_id").cast("long")
    if docs.groupBy(key.alias("k")).count().filter("count > 1 or k is null").limit(1).count() == 0:
        gone = jaccard_components(docs, rules).filter("doc_id <> component_id").select(F.col("doc_id").alias("tw_gone"))
        return docs.join(gone, key == F.col("tw_gone"), "left_anti").select(*docs.columns)
    # written first: the numbers must be the same in each use
    d = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "jaccard-rows")
    found = materialize(jaccard_components(d, rules, key=ROW).select("doc_id", "component_id"), "jaccard-found")
    several = found.filter("doc_id <> component_id").select("component_id").distinct()
    linked = found.join(several, "component_id", "left_semi").select(F.col("doc_id").alias("tw_member"), "component_id")
    order = d.select(ROW, F.struct(key.isNull().alias("a"), key.alias("b"), F.sha2(F.col("text").cast("string"), 256).alias("c"), F.col(ROW).alias("row")).alias("order"))
    members = materialize(linked.join(order, F.col("tw_member") == F.col(ROW)).select("component_id", "tw_member", "order"), "jaccard-members")
    kept = members.groupBy("component_id").agg(F.min("order").alias("least")).select(F.col("least.row").alias("tw_kept"))
    gone = members.select("tw_member").join(kept, F.col("tw_member") == F.col("tw_kept"), "left_anti")
    return d.join(gone, F.col(ROW) == F.col("tw_member"), "left_anti").select(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM w
), n AS (
  SELECT doc_id, CAST(coalesce(len(shingles), 0) AS BIGINT) AS n FROM s
), t AS (
  SELECT DISTINCT doc_id, unnest(shingles) AS token FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)
), r(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
