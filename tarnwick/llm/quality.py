"""Quality rules from suffix-array repetition: repeated word spans found by LCP intervals of each text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnwick.runtime import ship, table

from .bytetext import tidied
from .suffixes import covered, repeat_lengths, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_chars long, longest_repeat_words long"


@dataclass(frozen=True)
class RepetitionRules:
    """least_words: shortest repeat that counts; most_covered: share of word characters in repeats; longest_words: longest single repeat."""

    least_words: int = 8
    most_covered: float = 0.4
    longest_words: int = 200
    piece_words: int = 1 << 19


def measure(texts: list[str | None], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """One row for each text. Null and empty texts have no words; a text is never cut, however long."""
    n = len(texts)
    words = [WORD.findall(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, n)
    out = {k: np.zeros(n, np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat_words")}
    out["n_words"] = counts
    for i, text in enumerate(texts):
        if not text:
            continue
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            seen: set[str] = set()
            for line in lines:
                if line in seen:
                    out["n_dup_lines"][i] += WORD.search(line) is not None
                seen.add(line)
    at = 0
    while at < n:
        end, total = at, 0
        while end < n and (end == at or total + counts[end] <= rules.piece_words):
            total += counts[end]
            end += 1
        if total:
            flat = [w for ws in words[at:end] for w in ws]
            lengths = np.fromiter(map(len, flat), np.int64, len(flat))
            rows = np.repeat(np.arange(end - at), counts[at:end])
            order, lcp = suffix_array(pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64), rows)
            longest = repeat_lengths(order, lcp)
            out["word_chars"][at:end] = np.bincount(rows, lengths, end - at).astype(np.int64)
            three = np.flatnonzero(longest >= 3)
            cover = covered(three, np.full(len(three), 3), len(flat))
            out["n_repeat_words"][at:end] = np.bincount(rows[cover], minlength=end - at)
            many = np.flatnonzero(longest >= rules.least_words)
            cover = covered(many, longest[many], len(flat))
            out["repeat_chars"][at:end] = np.bincount(rows[cover], lengths[cover], end - at).astype(np.int64)
            np.maximum.at(out["longest_repeat_words"][at:end], rows[many], longest[many])
        at = end
    return out


def verdicts(texts: list[str | None], rules: RepetitionRules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Figures, base_failed and kept of each text."""
    m = measure(texts, rules)
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return m, failed, ~failed & (m["repeat_chars"] <= rules.most_covered * m["word_chars"]) & (m["longest_repeat_words"] <= rules.longest_words)


def quality_rules(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Figures and verdict of every row, in one pass without a shuffle.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. kept: not base_failed,
    and repeats of least_words or more cover at most most_covered of the word characters, the longest at most
    longest_words. Null or empty text: zero figures, base_failed. A text of any length is judged whole; its arrays are what a task holds. A null key stays null; repeated rows give one row each;
    other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                m, failed, kept = verdicts(part.column(1).to_pylist(), rules)
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                columns = [part.column(0), *(pa.array(m[k]) for k in names), pa.array(failed), pa.array(kept), pa.array(m["repeat_chars"]), pa.array(m["longest_repeat_words"])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept", "repeat_chars", "longest_repeat_words"])

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(tidied(run), RESULT)


def keep_clean(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; judged and filtered in the same pass.

    Null, empty and short texts go; texts of any length are judged whole; null keys and repeated rows are judged each; an empty table gives none.
    """
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield part.filter(pa.array(verdicts(part.column(place).to_pylist(), rules)[2]))

    return docs.mapInArrow(tidied(run), docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules(table(spark, sf_dir, "documents"))
