"""Language-model scoring by prediction by partial matching over byte contexts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tarnwick.runtime import materialize, ship, table

from .bytetext import U64, give_back, lowered, pieces, text_bytes, tidied, word_hashes, words_of

#: Codes of words have this bit; contexts with symbols lie below it.
WORD_BIT = 1 << 62
#: Bytes that UTF-8 never has: what stands before a text, and its end, which is a symbol to predict.
BEFORE, END = 0xFF, 0xFE
SYMBOLS = 255
END_WORD = 0x7F6E646F66746578
GRAM, WORD = 0, 1
#: Blocks whose numbers one row of a code lists.
BAND = 64


@dataclass(frozen=True)
class PpmModel:
    """order: bytes of the longest context, at most 6; block_bytes: text that one task scores against its part of the trie; held_codes: codes that a counting task holds at most before it passes them on."""

    order: int = 5
    block_bytes: int = 64 << 20
    piece_bytes: int = 1 << 20
    held_codes: int = 3_000_000


def gram_codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and the end of every row: the context and the symbol as one number, and the row."""
    sizes = np.diff(offsets)
    wide = np.cumsum(sizes + order + 1)
    text = np.full(int(wide[-1]) if len(wide) else 0, BEFORE, np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(data)) + (row + 1) * order + row] = data
    if len(wide):
        text[wide - 1] = END
    code = np.zeros(max(0, len(text) - order), U64)
    for i in range(order + 1):
        code = (code << U64(8)) | text[i : len(text) - order + i].astype(U64)
    owner = np.repeat(np.arange(len(sizes)), sizes + order + 1)[order:]
    real = text[order:] != BEFORE
    return code[real].view(np.int64), owner[real]


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of every row and of its end, and the row."""
    low = lowered(data)
    start, end, row = words_of(low, offsets)
    n = len(offsets) - 1
    hashes = (word_hashes(low, start, end) >> U64(2)).view(np.int64) | WORD_BIT if len(start) else np.empty(0, np.int64)
    return np.concatenate((hashes, np.full(n, END_WORD, np.int64))), np.concatenate((row, np.arange(n)))


def distinct_counts(piece: pa.RecordBatch, learns: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of some texts and their counts in those that learn."""
    data, offsets = text_bytes(piece.column("text"))
    keys, n = [], []
    for code, row in (gram_codes(data, offsets, order), word_codes(data, offsets)):
        place, own = pd.factorize(code)
        keys.append(own)
        n.append(np.bincount(place, learns[row], len(own)).astype(np.int64))
    return np.concatenate(keys), np.concatenate(n)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their counts."""
    if len(parts) == 1 and len(parts[0][0]) < 2:
        return parts[0]
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    del order
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n, at)


def gathered(model: PpmModel):
    """code, block and training count of the distinct codes of each block that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = lambda: sum(len(p[0]) for parts in held.values() for p in parts)

        def flush() -> Iterator[pa.RecordBatch]:
            while held:
                block, parts = held.popitem()
                keys, n = merged(parts)
                del parts
                for i in range(0, len(keys), 1 << 17):
                    k, c = keys[i : i + (1 << 17)], n[i : i + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), block, np.int32)), pa.array(c)], ["code", "block", "c"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks):
                own = batch.filter(pa.array(blocks == block))
                for piece in pieces(own, "text", model.piece_bytes):
                    learns = ~np.asarray(piece.column(1).to_numpy(zero_copy_only=False), dtype=bool)
                    parts = held.setdefault(int(block), [])
                    parts.append(distinct_counts(piece, learns, model.order))
                    if len(parts) >= 6:
                        parts[:] = [merged(parts)]
                        if size() > model.held_codes:
                            yield from flush()
        yield from flush()

    return run


def trie_log10(grams: DataFrame, order: int) -> DataFrame:
    """code and log10 probability of its symbol after its context, from grams (code, c: training count).

    Escapes follow method C: a context that saw d different symbols n times escapes with d / (n + d). A shorter context then leaves
    out the symbols of the longer one. These are its own as well, so their total there (t) and number take the place of a list.
    Unseen contexts pass on without cost; below the empty context all symbols not seen there are alike.
    """
    counts = {order: grams.select(F.col("code").alias("x"), "c")}
    for k in reversed(range(order)):
        counts[k] = counts[k + 1].groupBy(F.col("x").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("x")).agg(F.sum("c").alias("c"))
    whole = lambda gone, known: (F.col("n") - gone + F.col("d") - known).cast("double")

    def below(gone: Column, known: Column) -> Column:
        """Value at a level whose longer context left out symbols of that total and number."""
        fresh = F.col("d") - known
        return F.when(F.col("c") > 0, F.log10(F.try_divide(F.col("c").cast("double"), whole(gone, known)))).otherwise(F.col("rest") + F.when(fresh > 0, F.log10(fresh / whole(gone, known))).otherwise(F.lit(0.0)))

    level = None
    for k in range(order + 1):
        context = W.partitionBy(F.shiftright("x", 8))
        now = counts[k]
        if level is None:
            now = now.withColumn("n", F.sum("c").over(context)).withColumn("d", F.sum((F.col("c") > 0).cast("long")).over(context))
            level = now.withColumn("rest", -F.log10((F.lit(SYMBOLS) - F.col("d")).cast("double")))
            continue
        up = now.select(F.col("x").alias("ux"), F.col("c").alias("uc"))
        up = up.join(level, F.col("ux").bitwiseAND((1 << (8 * k)) - 1) == F.col("x")).drop("x")
        context = W.partitionBy(F.shiftright("ux", 8))
        seen = F.col("uc") > 0
        up = up.withColumn("un", F.sum("uc").over(context)).withColumn("ud", F.sum(seen.cast("long")).over(context)).withColumn("ut", F.coalesce(F.sum(F.when(seen, F.col("c"))).over(context), F.lit(0)))
        level = up.select(F.col("ux").alias("x"), F.col("uc").alias("c"), F.col("un").alias("n"), F.col("ud").alias("d"), below(F.col("ut"), F.col("ud")).alias("rest"))
    return level.select(F.col("x").alias("code"), below(F.lit(0), F.lit(0)).alias("value"))


def placed_texts(docs: DataFrame, held_out: Column, blocks: int, text: str, key: str) -> DataFrame:
    """block, held_out, text and doc_id. A block is a run of rows of one file, so that its rows are read together and counting needs no shuffle; where files are more than blocks several share one, and rows that come of no file fall into blocks by their hash."""
    columns = [held_out.alias("held_out"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(key).cast("long").alias("doc_id")]
    try:
        files = len(docs.inputFiles())
        run = F.floor(F.col("_metadata.row_index") / F.lit(max(1, -(-docs.count() // blocks))))
        place = F.hash("_metadata.file_path", run)
        d = docs.select((place if files <= 2 * blocks else F.pmod(place, F.lit(blocks))).alias("block"), *columns)
        d.schema  # resolves the file's metadata columns, if there are any
    except AnalysisException:
        return docs.select(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int").alias("block"), *columns)
    return d


def score_texts(docs: DataFrame, held_out: Column, model: PpmModel = PpmModel(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    The trie is never in one place. Texts fall into blocks; each block sends the distinct codes that it has, with their training counts; their
    sums over all blocks make the trie; and each block gets back the part that its own codes need. What a task
    holds depends on the block's size only, and what is gathered grows with the texts. The code length adapts to nothing at scoring: it is
    the trained model's. base_score is that of smoothed counts of the training texts' lower-cased words, of which each text's end is one.

    Null or empty text: its end is its only token and symbol. A text of any length is scored whole; one longer than a piece is a piece of its own. A null key stays null. Repeated rows are scored, and learnt from, each. Other
    columns are ignored; with no training text every probability is uniform; an empty table gives no rows.
    """
    if not 1 <= model.order <= 6:
        raise ValueError("order must lie between 1 and 6")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first().n or 0
    blocks = int(1 + size // model.block_bytes)
    d = placed_texts(docs, held_out, blocks, text, key)
    # small partitions are read together, so that a task's distinct codes stay far fewer than its bytes
    parts = d.select("block", "held_out", "text").coalesce(int(1 + size // (model.block_bytes // 8))).mapInArrow(tidied(gathered(model)), "code long, block int, c long")
    # a code's blocks are listed in bands, so that no list grows with the number of blocks; all of a code meets in one exchange
    band, same = F.pmod("block", F.lit(-(-blocks // BAND))), W.partitionBy("code")
    listed = parts.repartition("code").groupBy("code", band.alias("band")).agg(F.sum("c").alias("part"), F.collect_set("block").alias("blocks"))
    listed = listed.withColumn("c", F.sum("part").over(same)).withColumn("places", F.sum(F.size("blocks")).over(same)).withColumn("nth", F.row_number().over(same.orderBy("band")))
    sums = materialize(listed.select("code", "c", "blocks", (F.col("places") > 1).alias("several"), (F.col("nth") == 1).alias("head")), "ppm-sums")
    words = sums.filter(F.col("code") >= WORD_BIT)
    total = words.filter("head").agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = total.n or 0, total.v or 0
    own = sums.filter(F.col("code") < WORD_BIT)
    values = trie_log10(own.filter("head").select("code", "c"), model.order).withColumnRenamed("code", "x")
    grams = own.select("code", "blocks").join(values, F.col("code") == F.col("x")).select(F.explode("blocks").alias("b"), "code", "value")
    # a word of one block only is counted there
    shared = words.filter("several").select(F.explode("blocks").alias("b"), "code", F.col("c").cast("double").alias("value"))
    part = grams.unionByName(shared)
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

    names = [x.split()[0] for x in shape.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in shape.split(", ")]

    def looked_up(texts: pa.Table, values: pa.Table) -> tuple[tuple, tuple]:
        """Sorted codes with values and whether they are known: of symbols in contexts, and of words."""
        code = values.column("code").to_numpy()
        order = np.argsort(code)
        code, value = code[order], values.column("value").to_numpy()[order]
        del order
        edge = int(np.searchsorted(code, WORD_BIT))
        local: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in texts.to_batches():
            for piece in pieces(batch, "text", model.piece_bytes):
                data, offsets = text_bytes(piece.column("text"))
                learns = ~np.asarray(piece.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
                codes, row = word_codes(data, offsets)
                place, keys = pd.factorize(codes)
                local.append((keys, np.bincount(place, learns[row], len(keys)).astype(np.int64)))
                if len(local) >= 6:
                    local[:] = [merged(local)]
        own_words, counts = merged(local) if local else (np.empty(0, np.int64), np.empty(0, np.int64))
        if edge < len(code):
            counts[np.searchsorted(own_words, code[edge:])] = value[edge:].astype(np.int64)
        return (code[:edge], value[:edge], None), (own_words, np.log10((counts + 1) / float(n + v + 1)), counts > 0)

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        """The texts of one block with what the others know of its codes."""
        grams_known, words_known = looked_up(texts, values)
        out = []
        for batch in texts.to_batches():
            for piece in pieces(batch, "text", model.piece_bytes):
                data, offsets = text_bytes(piece.column("text"))
                rows, length = len(offsets) - 1, np.diff(offsets)
                codes, row = gram_codes(data, offsets, model.order)
                place, keys = pd.factorize(codes)
                score = np.bincount(row, grams_known[1][np.searchsorted(grams_known[0], keys)][place], rows)
                codes, row = word_codes(data, offsets)
                place, keys = pd.factorize(codes)
                at = np.searchsorted(words_known[0], keys)
                base, known = np.bincount(row, words_known[1][at][place], rows), np.bincount(row, words_known[2][at][place], rows)
                columns = [piece.column("doc_id"), piece.column("held_out"), np.bincount(row, minlength=rows), known.astype(np.int64), np.full(rows, n), base, score, length, -score / np.log10(2) / np.maximum(1, length)]
                out.append(pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names))
        del grams_known, words_known, texts, values
        give_back()
        return pa.Table.from_batches(out, pa.schema(list(zip(names, types, strict=True))))

    return d.groupBy("block").cogroup(part.groupBy("b")).applyInArrow(score, shape)


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    held_out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"), F.lit(False))
    return score_texts(table(spark, sf_dir, "documents"), held_out)
