"""Exact substring deduplication by blockwise suffix sorting with a difference cover.

Every window of `length` bytes has an anchor: the least hash among its 32-byte strings, the leftmost on a tie. Equal windows
have equal anchors at equal offsets, so the anchor's hash and the offset name the suffix bucket of a window, and only suffixes
of one bucket are ever compared. Neighbouring windows with one anchor form a context, and equal contexts
are settled by their hash alone. What remains, contexts that share an anchor and differ, is sorted bucket by bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.runtime import materialize, ship, table

from .bytetext import U64, Rolling, mix, pieces, spans_of, text_bytes
from .rows import PART, with_part

GRAM = 32
#: A difference cover: every difference modulo 16 is one of two of its members.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
PIECE = 4 << 20
#: Suffixes that are sorted at once.
BUCKETS = 400_000
OPEN = "kind int, doc long, part int, at int, windows int, anchor int, gram long, context long"
NAMES = ["kind", "doc", "part", "at", "windows", "anchor", "gram", "context"]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
COVERED, ASKED = 0, 1


@dataclass
class Contexts:
    """Runs of windows with one anchor: row, first start in the row, number of windows, anchor's distance from it, and hashes of anchor and bytes."""

    row: np.ndarray
    at: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    context: np.ndarray


def contexts_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Contexts:
    reach = length - GRAM + 1  # anchors of a window
    e = np.empty(0, np.int64)
    rolling = Rolling(data)
    starts = np.arange(max(0, len(data) - GRAM + 1))
    if len(data) < length:
        return Contexts(e, e, e, e, e, e)
    grams = rolling.of(starts, starts + GRAM)
    bits = U64(32)  # of the place; as many of the hash decide, in every piece alike, so that equal windows choose alike
    least = ((grams >> bits) << bits) | starts.astype(U64)
    span = 1
    while span * 2 <= reach:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    anchors = (least & ((U64(1) << bits) - U64(1))).astype(np.int64)  # of the window at each start
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchors)]
    inside = np.arange(len(anchors)) + length <= offsets[row + 1]
    first = inside & np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])))
    at = np.flatnonzero(first)
    total = np.concatenate(([0], np.cumsum(inside)))
    ends = np.concatenate((at[1:], [len(inside)])) if len(at) else at
    windows = total[ends] - total[at]
    row, anchor = row[at], anchors[at]
    with np.errstate(over="ignore"):
        context = mix(rolling.of(at, at + windows + length - 1) + (anchor - at).astype(U64) * U64(0x9E3779B97F4A7C15))
    return Contexts(row, at - offsets[row], windows, anchor - at, grams[anchor].view(np.int64), context.view(np.int64))


def later_than_first(order_keys: list[np.ndarray], *group: np.ndarray) -> np.ndarray:
    """True for all but the first, by the order keys, of each group."""
    n = len(group[0])
    order = np.lexsort((*reversed(order_keys), *reversed(group)))
    same = np.ones(n, dtype=bool)
    for g in group:
        same[1:] &= g[order][1:] == g[order][:-1]
    same[:1] = False
    out = np.zeros(n, dtype=bool)
    out[order] = same
    return out


def sampled_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, over `depth` bytes at least, of the suffixes at the cover's places; others hold -1.

    A sample at i has one at i + PERIOD, so ranks double in depth by pairing with themselves.
    """
    n = len(text)
    where = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    high, low = words_at(text, where), words_at(text, where + 8)
    rank = np.full(n + 2 * depth + PERIOD, -1, np.int64)
    _, inner = np.unique(low, return_inverse=True)
    _, outer = np.unique(high, return_inverse=True)
    rank[where] = np.unique(outer.astype(np.int64) * (len(low) + 1) + inner, return_inverse=True)[1]
    span = PERIOD
    while span < depth:
        rank[where] = np.unique((rank[where] + 1) * (len(where) + 2) + rank[where + span] + 1, return_inverse=True)[1]
        span *= 2
    return rank


def words_at(text: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one big-endian number; zeros stand past the end."""
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    out = np.zeros(len(where), U64)
    where = np.minimum(where, len(text))
    for i in range(8):
        out = (out << U64(8)) | padded[where + i].astype(U64)
    return out


def sort_buckets(texts: list[bytes], bucket: np.ndarray, anchor: np.ndarray, doc: np.ndarray, part: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of the windows of which an equal one starts earlier in another context.

    Contexts are laid out so that all anchors stand at one place of the period: suffixes of one bucket then have the cover's
    next sample at one distance, the first 16 bytes and that sample's rank order them, and neighbours in this order with
    a common prefix of `length` are one string.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    places = np.zeros(len(texts), np.int64)
    end = 0
    for i, (n, a) in enumerate(zip(lengths.tolist(), anchor.tolist(), strict=True)):
        places[i] = end + (-(end + a)) % PERIOD
        end = places[i] + n + 1
    text = np.zeros(end + length + 16, np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    text[np.repeat(places - np.cumsum(lengths) + lengths, lengths) + np.arange(len(flat))] = flat
    rank = sampled_ranks(text, length)
    step = np.array([min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)])
    windows = lengths - length + 1
    context = np.repeat(np.arange(len(texts)), windows)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
    suffix = places[context] + offset
    to_anchor = (anchor[context] - offset).astype(np.int64)
    keys = [rank[suffix + step[suffix % PERIOD]], words_at(text, suffix + 8), words_at(text, suffix), to_anchor, bucket[context]]
    order = np.lexsort(keys)
    s, c = suffix[order], context[order]
    same = np.zeros(len(s), dtype=bool)
    same[1:] = (bucket[c][1:] == bucket[c][:-1]) & (to_anchor[order][1:] == to_anchor[order][:-1])
    for i in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(same)
        same[live] = words_at(text, s[live] + i) == words_at(text, s[live - 1] + i)
    group = np.cumsum(~same)
    later = later_than_first([doc[c], part[c], at[c] + offset[order]], group)
    return c[later], offset[order][later]


def _batch(columns: list, names: list[str] = NAMES, types: list = TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(batches)
    return pa.Table.from_batches(got) if got else None


def numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc, part and text. part is 0 but for rows that share a key, which it numbers in the order of their texts' hashes; a null key counts as the greatest."""
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("doc"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("doc_id"))
    return with_part(d, "doc", "text").withColumnRenamed(PART, "part")


def repeated_windows(d: DataFrame, length: int) -> DataFrame:
    """doc, part, at, windows: runs of window starts whose string also starts earlier."""
    size = d.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    spark = d.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (8 << 20))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of the texts; in each piece, all but the first of equal ones are settled at once."""
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                data, offsets = text_bytes(piece.column(2))
                c = contexts_of(data, offsets, length)
                doc, part = piece.column(0).to_numpy(), piece.column(1).to_numpy(zero_copy_only=False)
                if len(c.row):
                    doc, part = doc[c.row], part[c.row]
                    late = later_than_first([doc, part, c.at], c.gram, c.context)
                    # what is settled needs no company: it spreads by its own hash
                    yield _batch([np.where(late, COVERED, ASKED), doc, part, c.at, c.windows, c.anchor, np.where(late, c.context ^ c.at, c.gram), c.context])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All but the first of equal contexts are covered; first ones whose anchor has other contexts are asked for."""
        t = _whole(batches)
        if t is None:
            return
        done = t.column("kind").to_numpy() == COVERED
        c = {k: t.column(k).to_numpy()[done] for k in NAMES[1:]}
        yield _batch([np.full(int(done.sum()), COVERED), *c.values()])
        c = {k: t.column(k).to_numpy()[~done] for k in NAMES[1:]}
        late = later_than_first([c["doc"], c["part"], c["at"]], c["gram"], c["context"])
        grams, number = np.unique(c["gram"][~late], return_counts=True)
        asked = ~late & (number[np.searchsorted(grams, c["gram"])] > 1)
        keep = late | asked
        yield _batch([np.where(late, COVERED, ASKED)[keep], *(c[k][keep] for k in NAMES[1:])])

    found = d.select("doc", "part", "text").mapInArrow(gather, OPEN)
    settled = materialize(found.repartition(parts, "gram").mapInArrow(settle, OPEN).drop("context"), "substring-settled")
    covered = settled.filter(f"kind = {COVERED}").select("doc", "part", "at", "windows")

    asks = settled.filter(f"kind = {ASKED}").groupBy("doc", "part").agg(F.collect_list(F.struct("at", "windows", "anchor", "gram")).alias("asked"))
    shape = "gram long, anchor int, doc long, part int, at int, bytes binary"
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, part, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                rows += [(a["gram"], a["anchor"], doc, part, a["at"], raw[a["at"] : a["at"] + a["windows"] + length - 1]) for a in asked]
            for i in range(0, len(rows), 20_000):
                yield _batch(list(zip(*rows[i : i + 20_000], strict=True)), ["gram", "anchor", "doc", "part", "at", "bytes"], kinds)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _whole(batches)
        if t is None:
            return
        gram = t.column("gram").to_numpy()
        order = np.argsort(gram, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], gram[order][1:] != gram[order][:-1], [True])))
        sizes = pa.compute.binary_length(t.column("bytes")).to_numpy()[order] - length + 1
        load = np.concatenate(([0], np.cumsum(sizes)))
        i = 0
        while i + 1 < len(edge):  # as many whole buckets at a time as hold BUCKETS suffixes, one at least
            j = max(i + 1, int(np.searchsorted(load[edge], load[edge[i]] + BUCKETS, "right")) - 1)
            rows = t.take(pa.array(order[edge[i] : edge[j]]))
            c = {k: rows.column(k).to_numpy() for k in ("gram", "anchor", "doc", "part", "at")}
            which, offset = sort_buckets(rows.column("bytes").to_pylist(), c["gram"], c["anchor"].astype(np.int64), c["doc"], c["part"], c["at"].astype(np.int64), length)
            if len(which):
                o = np.lexsort((offset, which))
                which, offset = which[o], offset[o]
                first = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1))))
                runs = np.diff(np.concatenate((first, [len(which)])))
                w = which[first]
                yield _batch([c["doc"][w], c["part"][w], c["at"][w] + offset[first], runs], ["doc", "part", "at", "windows"], [pa.int64(), pa.int32(), pa.int32(), pa.int32()])
            i = j

    fetched = d.select("doc", "part", "text").join(asks, ["doc", "part"]).mapInArrow(fetch, shape)
    return covered.unionByName(fetched.repartition(parts, "gram").mapInArrow(sort, "doc long, part int, at int, windows int"))


def remove_repeats(docs: DataFrame, length: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes, of every row.

    A byte goes if a string of `length` bytes over it also starts earlier: in a row with a smaller key, or earlier in the
    same row. Rows that share a key follow one another in the order of their texts' hashes; a null key comes last. Null or empty text,
    or one shorter than length: nothing is removed. Texts of any length are taken whole. Other columns are ignored; an empty table gives no rows.
    """
    if length < GRAM + 16:
        raise ValueError(f"length must be {GRAM + 16} at least")
    d = numbered(docs, text, key)
    runs = repeated_windows(d, length).groupBy("doc", "part").agg(F.collect_list(F.struct("at", "windows")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (value or "").encode()
                removed = spans = 0
                if found:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    at = np.array([r["at"] for r in found])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array([r["windows"] for r in found]) + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed, spans = int(gone.sum()), len(spans_of(gone)[0])
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    kept = raw
                rows.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield _batch(list(zip(*rows, strict=True)) if rows else [()] * 6, names, [pa.int64()] * 4 + [pa.string(), pa.binary()])

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return d.join(runs, ["doc", "part"], "left").select("doc_id", "text", "runs").mapInArrow(cut, shape)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
