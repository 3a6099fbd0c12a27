"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.runtime import ship, table

from .bytetext import tidied

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = len(KINDS) + 1
Span = tuple[int, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A match never starts inside a digit run: what fails at its first digit fails at the others.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MENTION = re.compile(r"(?<![^\s@])[^\s@]*+@[^\s@]*+|\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
#: One number of a row of numbers.
NUMBER = re.compile(r"[0-9](?:[().-]{0,2}[0-9])*+")
#: What skip links are taken to show before any is counted: so many that agree in each label, and that differ in each pair.
AGREE, DIFFER = 2.5, 0.05
MAYBE = re.compile(r"[0-9@]")
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out: list[Span] = []
    if not MAYBE.search(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


@dataclass
class Field:
    """The random field of one text: mentions as nodes, and the links between them."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    signs: list[str] = field(default_factory=list)
    known: list[int] = field(default_factory=list)  # label of a mention that a base span covers, else -1
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def field_of(text: str, base: list[Span]) -> Field:
    """Nodes are number-like and address-like mentions; a row of more digits than any number has counts as its numbers. Neighbours form
    the chain; a skip link joins a mention to the next one of the same or a similar form.

    Forms: an address in lower case, or a number's digits; similar: the last nine digits. Linking each to the next keeps
    links linear in mentions, and messages pass along them.
    """
    out = Field()
    spans = sorted((s, e, k) for k, s, e in base)
    latest: dict[str, int] = {}
    at = 0
    for start, end in mentions(text):
        i, own = len(out.spans), text[start:end]
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        over, j = -1, at
        while over < 0 and j < len(spans) and spans[j][0] < end:
            over = spans[j][2] if spans[j][1] > start else -1
            j += 1
        digits = re.sub(r"[^0-9]", "", own)
        mail = "@" in own
        out.spans.append((start, end))
        out.known.append(over)
        marks = "".join(c for c in "().- " if c in own)
        local, _, domain = own.partition("@")
        out.signs.append(f"@{'l' * bool(local)}{'d' * ('.' in domain.strip('.,;:'))}" if mail else f"{min(len(digits), 20)}{marks}{'L' * (13 <= len(digits) <= 19 and luhn(digits))}")
        if i:
            out.chain.append((i - 1, i))
        forms = [own.strip(".,;:!?()<>\"'").lower()] if mail else [digits, digits[-9:]] if 9 <= len(digits) <= 19 else []
        for j in sorted({latest[f] for f in forms if f in latest}):
            out.skip.append((j, i))
        latest.update(dict.fromkeys(forms, i))
    return out


def mentions(text: str) -> Iterator[tuple[int, int]]:
    for m in MENTION.finditer(text):
        if "@" not in m[0] and sum("0" <= c <= "9" for c in m[0]) > 19:
            yield from (x.span() for x in NUMBER.finditer(text, *m.span()))
        else:
            yield m.span()


def tally(texts: list[str | None]) -> Counter:
    """Counts that the potentials are made of: labels by sign, and label pairs by kind of link, where both ends are labelled by base spans or by none."""
    out: Counter = Counter()
    for text in texts:
        if text and MAYBE.search(text):
            f = field_of(text, base_spans(text))
            label = [OTHER if k < 0 else k for k in f.known]
            out.update(("sign", s, y, -1) for s, y in zip(f.signs, label, strict=True))
            for kind, links in (("chain", f.chain), ("skip", f.skip)):
                out.update((kind, "", label[a], label[b]) for a, b in links)
    return out


@dataclass(frozen=True)
class Potentials:
    """Log potentials: unary by sign, and of the two kinds of link."""

    unary: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray
    unseen: np.ndarray


def potentials(counts: list[tuple[str, str, int, int, int]]) -> Potentials:
    """From counts over all texts: smoothed label shares of each sign, which are the likeliest weights for one feature per sign; for the chain, how much more often two labels meet than by chance; for skip links, the log odds of agreeing."""
    signs: dict[str, np.ndarray] = {}
    pairs = {"chain": np.ones((LABELS, LABELS)), "skip": np.full((LABELS, LABELS), DIFFER) + AGREE * np.eye(LABELS)}
    for kind, sign, a, b, n in counts:
        if kind == "sign":
            signs.setdefault(sign, np.full(LABELS, 0.5))[a] += n
        else:
            pairs[kind][a, b] += n
    chain = pairs["chain"]
    chain = np.log(chain * chain.sum() / np.outer(chain.sum(1), chain.sum(0)))
    skip = pairs["skip"]
    agree = np.trace(skip[:OTHER, :OTHER])
    odds = float(np.log(agree / (skip[:OTHER, :OTHER].sum() - agree)))
    return Potentials({s: np.log(v / v.sum()) for s, v in signs.items()}, np.clip(0.5 * (chain + chain.T), -2, 2), np.eye(LABELS) * np.clip(odds, 0.0, 8.0), np.log(np.where(np.arange(LABELS) == OTHER, 0.5, 0.5 / OTHER)))


def marginals(f: Field, p: Potentials, rounds: int = 60, damping: float = 0.3) -> np.ndarray:
    """Loopy sum-product messages along chain and skip links until they settle."""
    n = len(f.spans)
    unary = np.array([p.unary.get(s, p.unseen) for s in f.signs])
    for i, k in enumerate(f.known):
        if k >= 0:
            unary[i] = np.where(np.arange(LABELS) == k, 0.0, -50.0)
    links = np.array(f.chain + f.skip, dtype=np.int64).reshape(-1, 2)
    if not len(links):
        return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))
    both = np.array([p.chain] * len(f.chain) + [p.skip] * len(f.skip))
    source, target = np.concatenate((links[:, 0], links[:, 1])), np.concatenate((links[:, 1], links[:, 0]))
    pair = np.concatenate((both, both.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(links)) + len(links), np.arange(len(links))))
    message = np.zeros((len(source), LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, message)
        new = np.logaddexp.reduce((belief[source] - message[back])[:, :, None] + pair, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        change = float(np.abs(new - message).max())
        message = damping * message + (1 - damping) * new
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, target, message)
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))


def all_spans(text: str, p: Potentials, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds: free mentions with a skip link whose label is some kind with at least that probability.

    A mention that no other resembles gets no span, whatever else stands in the text; those that do share what they show.
    """
    if not MAYBE.search(text):
        return [], []
    base = base_spans(text)
    f = field_of(text, base)
    linked = {i for link in f.skip for i in link}
    if all(f.known[i] >= 0 for i in linked):
        return base, []
    m = marginals(f, p)
    return base, [(int(y), *f.spans[i]) for i, y in enumerate(m.argmax(axis=1)) if i in linked and f.known[i] < 0 and y != OTHER and m[i, y] >= sure]


def train(docs: DataFrame, text: str = "text") -> Potentials:
    """Counts over every text; what comes back is one row per sign and label, some hundreds however large the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            total.update(tally(batch.column(0).to_pylist()))
        columns = list(zip(*((*k, n) for k, n in total.items()), strict=True)) or [()] * 5
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["kind", "sign", "a", "b", "n"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tidied(run), "kind string, sign string, a long, b long, n long")
    return potentials([tuple(r) for r in parts.groupBy("kind", "sign", "a", "b").agg(F.sum("n").alias("n")).collect()])


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(docs: DataFrame, model: Potentials | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans of every row as kind:start:end in code points; n_added of them come from the field.

    Null or empty text: no spans, the hash of an empty string. A text of any length is one field, whose nodes and links grow with its mentions. A
    tie between labels goes to the first kind. Null keys stay null; repeated rows give a row each; other columns are ignored; an empty table gives no rows.
    """
    p = model or train(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                base, added = all_spans(value, p) if value else ([], [])
                n = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(tidied(run), RESULT)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by its first kind in angle brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, model: Potentials | None = None) -> DataFrame:
    """docs with personal data in text replaced and n_chars, if there, made to fit.

    Null and empty texts stay as they are; texts of any length are read whole; null keys, repeated rows and other columns stay; an empty table gives none.
    """
    p = model or train(docs)
    names = docs.columns
    place, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(place).to_pylist()
            new = [masked(t, sum(all_spans(t, p), [])) if t else t for t in old]
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.schema.field(place).type)
            if chars is not None:
                columns[chars] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[chars].to_pylist(), old, new, strict=True)], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidied(run), docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return find_pii(table(spark, sf_dir, "documents"))
