"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer is two machines in a row: a splitter that cuts text into pretokens, and a merger that turns
each pretoken into tokens. Both are compiled, state by state as texts need them, into one deterministic transducer over
characters whose transitions carry the change in the number of emitted tokens. A text is cut into chunks; each chunk becomes
a map from the state it is entered in to the state it is left in and a count, and maps compose, associatively, in a parallel prefix scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tarnwick.runtime import ship, table

from .bytetext import tidied

# Fixed values of the byte-level splitter: contractions are cut off, a blank goes to the run of letters, numbers or others after it.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
CLASSES = ((r"\p{L}", "letter"), (r"\p{N}", "number"), (r"\s", "space"), (r".", "other"))
#: After a blank that follows another character the splitter is in one state, whatever state it came from.
RESET = regex.compile(r"(?<=\S) ")
CHUNK = 1 << 15
#: States that a worker keeps compiled; on reaching it the worker starts afresh, which changes no result.
MOST_STATES = 300_000
#: The state between two pretokens, and that after a reset: (kind, the merger's state or None for its first, characters held).
BETWEEN, BLANK = ("", None, ""), ("space", None, " ")
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MergeTransducer:
    """Transitions (state, byte) -> (state, change in emitted tokens), compiled on first use.

    After any prefix of a pretoken, its last token is the one token t for which the last token before t may stand beside
    t, that is, for which the merges leave the two apart. Which tokens can still end later depends only on the suffixes of
    the prefix that begin a longer token. So a state is the longest such suffix and, for each place where one starts, the last token
    there and the count there relative to the end: finitely many, and shared by all pretokens with the same ending.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if all(c in back for c in t)}
        self.begun = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = (b"", ((0, b"", 0),))
        self.states = [start]
        self.numbers = {start: 0}

    def number(self, state: tuple) -> int:
        found = self.numbers.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        return found

    def merged(self, piece: bytes) -> list[bytes]:
        """The tokens of a short string by the merges themselves: lowest rank first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            least, i = min((self.rank.get(x, len(self.rank)), i) for i, x in enumerate(zip(parts, parts[1:], strict=False)))
            if least == len(self.rank):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, last: bytes, token: bytes) -> bool:
        found = self.beside.get((last, token))
        if found is None:
            found = self.beside[last, token] = self.merged(last + token) == ([last, token] if last else [token])
        return found

    def step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.states[state]
        end = bytes((byte,))
        for back, last, relative in places:
            token = suffix[len(suffix) - back :] + end
            if token in self.tokens and self.fits(last, token):
                break
        else:
            raise ValueError(f"no token ends at byte {byte}")
        change = relative + 1
        longer = [(back + 1, last, relative - change) for back, last, relative in places if suffix[len(suffix) - back :] + end in self.begun]
        suffix = (suffix + end)[len(suffix) + 1 - longer[0][0] :] if longer else b""
        return self.number((suffix, (*longer, (0, token, 0)))), change

    def feed(self, state: int, text: str) -> tuple[int, int]:
        total = 0
        for byte in text.encode():
            state, change = self.step(state, byte)
            total += change
        return state, total


class Row(dict):
    """A state of the whole transducer: by character, the state that follows and the change in emitted tokens, compiled on first use.

    kind is what the open pretoken is: a run of letters, numbers, others or white space, an apostrophe, or "" between two. merge is the merger's state in
    it; held are characters read that the merger has not, as the next one tells to which pretoken they go.
    """

    __slots__ = ("counter", "kind", "merge", "held")

    def __init__(self, counter: TokenCounter, kind: str, merge: int, held: str) -> None:
        super().__init__()
        self.counter, self.kind, self.merge, self.held = counter, kind, merge, held

    def __missing__(self, c: str) -> tuple[Row, int]:
        found = self[c] = self.counter.compiled(self, c)
        return found


class TokenCounter:
    """Counts of texts by one transducer over characters."""

    def __init__(self, path: str) -> None:
        self.fst = MergeTransducer(path)
        self.classes = [(regex.compile(p, regex.S), name) for p, name in CLASSES]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.fst.special, key=len, reverse=True)))) if self.fst.special else None
        self.rows: dict[tuple[str, int, str], Row] = {}

    def row(self, kind: str, merge: int = 0, held: str = "") -> Row:
        found = self.rows.get((kind, merge, held))
        if found is None:
            found = self.rows[kind, merge, held] = Row(self, kind, merge, held)
        return found

    def fed(self, kind: str, merge: int, text: str) -> tuple[Row, int]:
        merge, n = self.fst.feed(merge, text)
        return self.row(kind, merge), n

    def compiled(self, row: Row, c: str) -> tuple[Row, int]:
        """The transition from a state by a character."""
        kind, merge, held = row.kind, row.merge, row.held
        own = next(name for p, name in self.classes if p.match(c))
        if kind == "apostrophe":
            so_far = "'" + held + c
            if so_far in CONTRACTIONS:
                return self.row(""), self.fst.feed(merge, held + c)[1]
            if any(x.startswith(so_far) for x in CONTRACTIONS):
                return self.row(kind, merge, held + c), 0
            if held:  # the apostrophe stands alone, letters follow
                after, n = self.fed("letter", 0, held)
                to, more = after[c]
                return to, n + more
            kind = "other"
        if kind == own == "space":  # the last of white space is held
            merge, n = self.fst.feed(merge, held)
            return self.row("space", merge, c), n
        if kind == own:
            return self.fed(kind, merge, c)
        if own == "space":
            return self.row("space", 0, c), 0
        if kind == "space":
            if held == " ":
                return self.fed(own, 0, " " + c)
            n = self.fst.feed(0, held)[1]
            to, more = self.row("")[c]
            return to, n + more
        return self.fed("apostrophe" if c == "'" else own, 0, c)

    def ended(self, row: Row) -> int:
        """What the end of the text adds in a state: a white run is one pretoken, letters held after an apostrophe are one."""
        return self.fst.feed(row.merge if row.kind == "space" else 0, row.held)[1] if row.held else 0

    def entered(self, state: tuple) -> Row:
        """The row of a state that is given apart from the numbers of the merger's states, which do not outlive clear()."""
        if len(self.rows) > MOST_STATES or len(self.fst.states) > MOST_STATES:
            for row in self.rows.values():
                row.clear()
            self.rows.clear()
            self.fst.clear()
        kind, merge, held = state
        return self.row(kind, 0 if merge is None else self.fst.number(merge), held)

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The state that a text is left in, and the tokens counted, if it is entered in that state."""
        row, total = self.entered(state), 0
        for c in text:
            row, change = row[c]
            total += change
        return (row.kind, self.fst.states[row.merge], row.held), total

    def state_map(self, chunk: str) -> tuple[str, int, tuple | None]:
        """(head, count, exit): the map of a chunk. Up to its first reset, where head ends, it depends on the state that it is entered in; from there on it counts and is left in the same state from all.

        Without a reset the map is (chunk, 0, None): the run of the chunk itself.
        """
        first = RESET.search(chunk)
        if first is None:
            return chunk, 0, None
        left, count = self.run(BLANK, chunk[first.end() :])
        return chunk[: first.end()], count, left

    def compose(self, x: tuple[str, int, tuple | None], y: tuple[str, int, tuple | None]) -> tuple[str, int, tuple | None]:
        """The map of x and then y: y is entered in the state that x is left in."""
        if x[2] is None:
            return x[0] + y[0], y[1], y[2]
        state, count = self.run(x[2], y[0])
        return x[0], x[1] + count + y[1], state if y[2] is None else y[2]

    def segment(self, text: str) -> int:
        """Tokens of a text without special strings: its chunks' maps in an up-sweep of pairwise compositions, applied to the state between pretokens."""
        if len(text) <= CHUNK:
            row, total = self.entered(BETWEEN), 0
            for c in text:
                row, change = row[c]
                total += change
            return total + self.ended(row)
        maps = [self.state_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, left = maps[0]
        state, first = self.run(BETWEEN, head)
        return first + count + self.ended(self.entered(left or state))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return sum(map(self.segment, parts)) + len(parts) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def tokenizer_path(name: str) -> str:
    """Resolved where it is used, so that each executor finds its own installed copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, in one pass without a shuffle.

    Counts equal the library's for the whole text, however long. Null or empty text: 0 bytes, 0 tokens, not over the limit. Null keys
    stay null, repeated rows give a row each, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path(tokenizer)).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.fromiter(map(count, texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode()) if t else 0 for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(tidied(run), RESULT)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return count_tokens(table(spark, sf_dir, "documents"))
