"""Main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.runtime import materialize, ship, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MARKS = ("class", "id", "role")
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements without main text, and words that tell the same of others where a whole word of class, id or role is one, or hyphened ones only.
ASIDE = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "canvas", "object", "menu", "dialog", *RAW}
ASIDE_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "contentinfo", "complementary", "comment", "comments", "disqus", "replies", "respond", "share", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "login", "signup", "search", "dialog", "alert"}
#: Only outside the article.
PAGE_HEAD, PAGE_HEAD_WORDS = {"header"}, {"header", "masthead", "banner", "topbar"}
#: Never aside for their own words.
HOLDERS = {"html", "body", "main", "article"}


@dataclass(frozen=True)
class Block:
    """A stretch of text between block tags: where it stands and whether an article or main element, or one without main text, holds it."""

    path: str
    text: str
    inside: bool
    aside: bool


@dataclass(frozen=True)
class TemplateRules:
    """A class is valid with `tokens` tokens at least that occur on `pages` pages and that share of a host's pages."""

    tokens: int = 3
    pages: int = 3
    share: float = 0.3


def worded(marks: dict[str, str], words: set[str]) -> bool:
    return any(words.issuperset(w.replace("_", "-").split("-")) for v in marks.values() for w in v.split())


def blocks_of(page: str) -> tuple[list[Block], list[str], dict[str, tuple[str, str]]]:
    """Text blocks in page order, the path of every opening tag, and by path of a block element the path around it and its tag; unclosed and stray tags are tolerated.

    What the page's first article or main element lies in is not aside for a word of class, id or role.
    """
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, path, inside, aside by an element, aside by a word
    held_by: set[str] = set()
    out: list[Block] = []
    tags: list[str] = []
    around: dict[str, tuple[str, str]] = {}
    held: list[str] = []
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            _, path, inside, aside, by_word = stack[-1] if stack else ("", "", False, False, False)
            out.append(Block(path, text, inside, aside or by_word))

    while at < len(page):
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if page[m.start()] != "<" or m[0] == "<":
                held.append(m[0])
            continue
        if name in BLOCKS or name in ASIDE:
            flush()
        if name == "br":
            held.append(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        marks = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(m[3]) if k.lower() in MARKS}
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or name in BLOCKS:  # a new block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or (stack[i][0] == name and name in ("li", "td", "th", "tr", "dt", "dd")):
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        holder = marks.get("role") if marks.get("role") in ("main", "article") else name
        if holder in ("main", "article") and holder not in held_by:
            held_by.add(holder)
            stack[:] = [(*x[:4], False) for x in stack]
        _, path, inside, aside, by_word = stack[-1] if stack else ("", "", False, False, False)
        label = name + "".join(f".{marks[k]}" for k in ("class", "id") if marks.get(k))
        by_word = by_word or (holder not in HOLDERS and bool(marks) and worded(marks, ASIDE_WORDS if inside else ASIDE_WORDS | PAGE_HEAD_WORDS))
        aside = aside or name in ASIDE or (not inside and name in PAGE_HEAD)
        inside = inside or name in ("article", "main") or holder in ("main", "article")
        if name in BLOCKS or name in ASIDE:
            outer, path = path, f"{path}/{label}"
            around[path] = outer, f"{path}<{name}"
        tags.append(f"{path}<{name}")
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
            closing = page.find(">", at)
            at = closing + 1 if closing >= 0 else len(page)
        elif name not in VOID and not m[3].rstrip().endswith("/"):
            stack.append((name, path, inside, aside, by_word))
    flush()
    return out, tags, around


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def chain(path: str, around: dict[str, tuple[str, str]]) -> Iterator[str]:
    """The tags of the elements that hold a path, from the inmost on."""
    while path in around:
        path, tag = around[path]
        yield tag


def occurrences(page: str) -> dict[int, list[int]]:
    """By token, which is a tag or a whole block of text, told apart by its path: how often it is on the page, and for a tag the characters of text and the headings that its element holds, and its depth. Token 0 is the page.

    Text in elements without main text does not count.
    """
    blocks, tags, around = blocks_of(page)
    named: dict[str, list[int]] = {}
    for x in tags:
        named.setdefault(x, [0, 0, 0, 0])[0] += 1
    whole = [1, 0, 0, 0]
    texts: dict[int, list[int]] = {}
    for b in blocks:
        texts.setdefault(number("b", b.path, b.text), [0, 0, 0, 0])[0] += 1
        if not b.aside:
            holders = list(chain(b.path, around))
            heads = int(any(x.endswith("<h1") for x in holders))
            whole[1], whole[2] = whole[1] + len(b.text), whole[2] + heads
            for depth, x in enumerate(reversed(holders)):
                n = named[x]
                n[1], n[2], n[3] = n[1] + len(b.text), n[2] + heads, depth
    return {0: whole} | texts | {number("t", x): n for x, n in named.items()}


def wrapped(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def deduce_templates(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """host, template, the tokens of its valid equivalence classes, spread, on how many pages each of them is, and main, the tag whose slot holds the articles.

    Tokens of a host are equivalent if they occur equally often on each of its pages. A vector of occurrences is never
    built: its image is the sum over pages of the page's number times the occurrences, which adds up in any order, so that a host of
    any size is spread over tasks and pre-aggregated in them. Classes nest by their pages: a valid class whose pages are
    all the host's is the frame; one with fewer lies in its slots. Elements of the template that are on a page once at most
    nest as well. main is the inmost of them that holds over half of the host's text and, where there are any, of its first-level
    headings; it is null where the template has none. Elements with over half of the text hold each other, so at most one is inmost.
    """
    names = ["host", "token", "image", "pages", "n", "chars", "heads", "depth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for key, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                host, image = host_of(url), number("page", key, url)
                for token, (n, chars, heads, depth) in (occurrences(page) if page else {0: [1, 0, 0, 0]}).items():
                    s = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0])
                    s[:] = wrapped(s[0] + image * n), s[1] + 1, s[2] + n, s[3] + chars, s[4] + heads, max(s[5], depth)
            columns = [[k[0] for k in sums], [k[1] for k in sums], *([v[i] for v in sums.values()] for i in range(6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names)

    # images add up modulo 2**64: as two halves, whose sums cannot pass a long
    found = pages.mapInArrow(run, "host string, " + ", ".join(f"{x} long" for x in names[1:]))
    halves = found.select("host", "token", *names[3:], F.col("image").bitwiseAND(0xFFFFFFFF).alias("lo"), F.shiftrightunsigned("image", 32).alias("hi"))
    sums = halves.groupBy("host", "token").agg(*(F.sum(x).alias(x) for x in ("lo", "hi", *names[3:7])), F.max("depth").alias("depth"))
    sums = materialize(sums.select("host", "token", *names[3:], ((F.col("hi") + F.shiftright("lo", 32)).bitwiseAND(0xFFFFFFFF)).alias("hi"), F.col("lo").bitwiseAND(0xFFFFFFFF).alias("lo")).filter("token = 0 or pages > 1"), "page-tokens")
    hosts = sums.filter("token = 0").select("host", *(F.col(x).alias(f"all_{x}") for x in ("pages", "chars", "heads")))
    tokens = sums.filter("token <> 0").join(hosts, "host").filter(f"pages >= {rules.pages} and pages >= {rules.share} * all_pages")
    holds = F.expr("n = pages and 2 * chars > all_chars and (all_heads = 0 or 2 * heads > all_heads)")
    inmost = F.max(F.when(holds, F.struct((-F.col("chars")).alias("chars"), "depth", "token"))).alias("inmost")
    classes = tokens.groupBy("host", "pages", "hi", "lo").agg(F.collect_list("token").alias("tokens"), inmost).filter(F.size("tokens") >= rules.tokens)
    spread = F.array_repeat("pages", F.size("tokens"))
    found = classes.groupBy("host").agg(F.collect_list(F.struct("tokens", spread.alias("pages"))).alias("c"), F.max("inmost").alias("inmost"))
    return found.select("host", F.flatten("c.tokens").alias("template"), F.flatten("c.pages").alias("spread"), F.col("inmost.token").alias("main"))


def repeated_article(blocks: list[Block], known: list[int | None]) -> set[int]:
    """The places of an article's blocks that the template may take: those of its classes of most pages, as long as they hold half of the text at most.

    known: on how many pages the template has a block. Copies of one article on a host form a class too, but one that holds most of the article.
    """
    most, gone = sum(len(b.text) for b in blocks) / 2, set()
    for n in sorted({n for n in known if n is not None}, reverse=True):
        level = gone | {i for i, x in enumerate(known) if x == n}
        if sum(len(blocks[i].text) for i in level) > most:
            break
        gone = level
    return gone


def slot_of(blocks: list[Block], around: dict[str, tuple[str, str]], main: int | None) -> list[Block]:
    """The blocks that the host's main tag holds; none where the page lacks it."""
    if main is None:
        return []
    held = {path: any(number("t", x) == main for x in chain(path, around)) for path in {b.path for b in blocks}}
    return [b for b in blocks if held[b.path]]


def main_text(page: str, template: frozenset[int], spread: dict[int, int] | None = None, main: int | None = None) -> str:
    """The blocks of the page's main slot, one per line, but for those that its host's template has and those of elements without main text.

    Of a slot that is not the whole page the template takes no more than repeated_article allows. A page without the slot, whose host has no such
    tag or lays it out in another way, gives all its slots. An article or main element, where a page has one, then bounds what stays; a slot that
    misses it is not used. spread: on how many pages each token of the template is; main: the tag whose slot holds the articles.
    """
    blocks, _, around = blocks_of(page)
    slot = slot_of(blocks, around, main)
    marked = any(b.inside for b in blocks)
    whole = True
    if slot and (not marked or any(b.inside for b in slot)):
        blocks, whole = slot, len(slot) == len(blocks)
    kept = [b for b in blocks if not b.aside and (b.inside or not marked)]
    tokens = [number("b", b.path, b.text) for b in kept]
    if marked or not whole:
        gone = repeated_article(kept, [(spread or {}).get(t, 0) if t in template else None for t in tokens])
    else:
        gone = {i for i, t in enumerate(tokens) if t in template}
    return "\n".join(b.text for i, b in enumerate(kept) if i not in gone)


def extract_text(pages: DataFrame, rules: TemplateRules = TemplateRules(), most_broadcast: int = 32 << 20, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A host's template goes to its pages by broadcast while all templates fit most_broadcast bytes, else by a join on the host, whose
    large partitions Spark splits. Null or empty html: empty text. Html of any length is read whole, one page at a time. Pages without a host share one. A null key stays null; repeated rows
    give a row each; other columns are ignored; an empty table gives no rows.
    """
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    templates = materialize(deduce_templates(p, rules), "page-templates")
    size = templates.agg(F.sum(F.size("template") * 16 + F.octet_length("host") + 32).alias("n")).first().n or 0
    host = F.lower(F.substring_index(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", 1), "@", -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[frozenset[int], dict[int, int], int | None]] = {}
        for batch in batches:
            hosts, lists, counts, mains = batch.column(3).to_pylist(), batch.column(4), batch.column(5), batch.column(6)
            texts = []
            for i, html_ in enumerate(batch.column(2).to_pylist()):
                if hosts[i] not in known:
                    if len(known) > 1000:
                        known.clear()
                    spread = dict(zip(lists[i].as_py() or (), counts[i].as_py() or (), strict=True))
                    known[hosts[i]] = frozenset(spread), spread, mains[i].as_py()
                texts.append(main_text(html_, *known[hosts[i]]) if html_ else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = p.withColumn("host", host).join(F.broadcast(templates) if size <= most_broadcast else templates, "host", "left")
    return joined.select("page_id", "url", "html", "host", "template", "spread", "main").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return extract_text(table(spark, sf_dir, "pages"))
