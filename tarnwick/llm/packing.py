"""Vector bin packing of tokenized documents into training sequences."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tarnwick.runtime import ship, table

from .bytetext import tidied
from .tokens import tokenizer_path

# Fixed value of the byte-level splitter.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most, and how many sequences a task keeps open."""

    tokens: int = 1024
    segments: int = 128
    loss: int = 1024
    open: int = 32


@dataclass
class Piece:
    """Tokens [start, start + len(ids)) of a document; those before prompt bear no loss."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    prompt: int

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self.ids) - max(self.start, self.prompt))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens, self.prompt), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens, self.prompt)

    def longest(self, tokens: int, loss: int) -> int:
        """The most leading tokens within both limits."""
        return min(len(self.ids), tokens, max(0, self.prompt - self.start) + loss)


class VectorPacker:
    """Places pieces by the dot product of what they need and what an open sequence has left.

    The three dimensions are tokens, segments and loss-bearing tokens, each as a share of its limit. A document's
    full-length parts become sequences of their own. A remainder goes to the open sequence that can hold it with the
    largest dot product; if none can, it opens one, or, with all open, is cut to fill the fullest one.
    At the end the open sequences are refilled one after another, cutting freely, and the rest is cut at powers of two.
    """

    def __init__(self, limits: Limits, emit: Callable[[list[Piece]], None]) -> None:
        self.limits, self.emit = limits, emit
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.left = np.zeros((limits.open, 3))
        self.bins: list[list[Piece] | None] = [None] * limits.open

    def add(self, piece: Piece) -> None:
        while len(piece.ids):
            n = piece.longest(self.limits.tokens, self.limits.loss)
            if n < len(piece.ids) or n == self.limits.tokens:
                full, piece = piece.cut(n)
                if n == self.limits.tokens:
                    self.emit([full])
                else:
                    self.place(full)
            else:
                self.place(piece)
                return

    def place(self, piece: Piece) -> None:
        while len(piece.ids):
            need = np.array([len(piece.ids), 1, piece.loss], np.float64)
            fits = (self.left >= need).all(axis=1)
            if fits.any():
                score = np.where(fits, (self.left / self.capacity**2) @ need, -1)
                self.put(int(score.argmax()), piece)
                return
            if None in self.bins:
                at = self.bins.index(None)
                self.bins[at], self.left[at] = [], self.capacity
                self.put(at, piece)
                return
            can = np.array([piece.longest(int(t), int(x)) if s else 0 for t, s, x in self.left])
            at = int(np.where(can > 0, self.left[:, 0], np.inf).argmin())
            if not can[at]:
                self.close(at)
                continue
            part, piece = piece.cut(int(can[at]))
            self.put(at, part)

    def put(self, at: int, piece: Piece) -> None:
        self.bins[at].append(piece)
        self.left[at] -= (len(piece.ids), 1, piece.loss)
        if self.left[at].min() <= 0:
            self.close(at)

    def close(self, at: int) -> None:
        pieces, self.bins[at], self.left[at] = self.bins[at], None, 0
        if sum(len(p.ids) for p in pieces) == self.limits.tokens:
            self.emit(pieces)
        else:
            self.halve(pieces)

    def halve(self, pieces: list[Piece]) -> None:
        """Emits pieces that are too few for a sequence as sequences whose lengths are powers of two."""
        left = sum(len(p.ids) for p in pieces)
        queue = list(pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            self.emit(self.take(queue, size))
            left -= size

    @staticmethod
    def take(queue: list[Piece], n: int) -> list[Piece]:
        out = []
        while n:
            piece = queue.pop(0)
            if len(piece.ids) > n:
                piece, rest = piece.cut(n)
                queue.insert(0, rest)
            n -= len(piece.ids)
            out.append(piece)
        return out

    def finish(self) -> None:
        queue = [p for b in self.bins if b for p in b]
        self.bins, now, left = [None] * self.limits.open, [], self.capacity.copy()
        while queue:
            piece = queue.pop(0)
            n = piece.longest(int(left[0]), int(left[2])) if left[1] else 0
            if n:
                part, rest = piece.cut(n)
                now.append(part)
                left -= (n, 1, part.loss)
                piece = rest
            if len(piece.ids):
                queue.insert(0, piece)
            if not n or left.min() <= 0:
                (self.emit if left[0] == 0 else self.halve)(now)
                now, left = [], self.capacity.copy()
        if now:
            self.halve(now)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Ids of a text, its special strings as their own id; the vocabulary as ranks is that of the byte-level BPE file."""
    import tiktoken

    with open(tokenizer_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    made = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: made.encode(text, allowed_special="all")


def pack(docs: DataFrame, limits: Limits = Limits(), vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0, text: str = "text", key: str = "doc_id", prompt: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: its place in the document and in its sequence.

    Each task packs what it reads, so nothing is shuffled and a task that runs again packs alike; it holds only its open
    sequences and one batch. sequence_id is the task's partition times 2**32 plus a running number. prompt names a column
    with the number of leading tokens that bear no loss. with_ids adds the token ids.

    Null or empty text is a document of the end id alone. A document of any length is cut into as many pieces as it
    needs. Null keys stay null; repeated rows are packed each; other columns are ignored; an empty table gives no rows.
    """
    if min(limits.tokens, limits.segments, limits.loss, limits.open) < 1:
        raise ValueError("limits must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        rows: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def emit(pieces: list[Piece]) -> None:
            nonlocal number
            at = 0
            for p in pieces:
                rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, number, at, p.loss, *([p.ids.tolist()] if with_ids else [])))
                at += len(p.ids)
            number += 1

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            types = [pa.int64()] * len(names)
            if with_ids:
                names, types = [*names, "ids"], [*types, pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
            rows.clear()
            return out

        packer = VectorPacker(limits, emit)
        for batch in batches:
            ids, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, value in enumerate(batch.column(1)):
                tokens = np.array([*encode(value.as_py() or ""), end_id], dtype="<u4")
                packer.add(Piece(ids[i], 0, tokens, len(tokens), prompts[i] or 0))
                if len(rows) >= 8192:
                    yield flush()
        packer.finish()
        yield flush()

    chosen = docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text", f"cast(`{prompt}` as long) prompt" if prompt else "0L prompt")
    return chosen.mapInArrow(tidied(run), RESULT + ", ids array<long>" * with_ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(table(spark, sf_dir, "documents"))
