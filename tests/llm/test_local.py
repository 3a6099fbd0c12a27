"""Parts that need no session, against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarnwick.llm import pages, pii, quality, suffixes, tokens
from tarnwick.llm.packing import Limits, Piece, VectorPacker

path = pytest.importorskip("public_tokenizers").path


def test_suffix_array_and_lcp():
    rng = random.Random(1)
    for _ in range(200):
        rows = sorted(rng.randrange(3) for _ in range(rng.randrange(1, 40)))
        symbols = [rng.randrange(3) for _ in rows]
        order, lcp = suffixes.suffix_array(np.array(symbols), np.array(rows))
        suffix = [(rows[i], [s for s, r in zip(symbols[i:], rows[i:], strict=True) if r == rows[i]]) for i in range(len(rows))]
        assert [suffix[i] for i in order] == sorted(suffix)
        for k in range(1, len(order)):
            a, b = suffix[order[k - 1]], suffix[order[k]]
            n = 0
            while a[0] == b[0] and n < min(len(a[1]), len(b[1])) and a[1][n] == b[1][n]:
                n += 1
            assert lcp[k] == n


def test_maximal_repeats():
    found = suffixes.maximal_repeats(np.array([1, 2, 3, 9, 1, 2, 3, 8, 2, 3]), 2)
    assert (3, [0, 4]) in found and (2, [1, 5, 8]) in found and (2, [0, 4]) not in found


def test_quality_verdicts():
    word = [f"w{i}" for i in range(400)]
    clean, short = " ".join(word), "one two"
    half = " ".join(word[:100] + word[:100])
    m, failed, kept = quality.verdicts([clean, short, None, "", half, "x " * 5000], quality.RepetitionRules())
    assert kept.tolist() == [True, False, False, False, False, False]
    assert m["n_repeat_words"][4] == 200 and m["longest_repeat_words"][4] == 100
    text = "a b\n\na b\n \n a $\n"
    m, _, _ = quality.verdicts([text], quality.RepetitionRules())
    assert (m["n_words"][0], m["n_dup_lines"][0], m["n_symbols"][0]) == (6, 1, 1)


def test_quality_figures_against_plain_counts():
    rng = random.Random(9)
    for _ in range(150):
        lines = [" ".join(rng.choice("abcd") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 8))]
        text = "\n".join(lines + rng.choices(lines, k=2)) + rng.choice(["", " $#", "\t*"])
        rules = quality.RepetitionRules(least_words=rng.choice([2, 4, 8]))
        m, failed, kept = quality.verdicts([text], rules)
        w = text.split()
        seen, repeated = {}, [False] * len(w)
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            for i in at if len(at) > 1 else ():
                repeated[i : i + 3] = [True] * 3
        longest = [max((n for j in range(len(w)) if j != i for n in [next((k for k in range(len(w)) if i + k >= len(w) or j + k >= len(w) or w[i + k] != w[j + k]), len(w))]), default=0) for i in range(len(w))]
        cover = [False] * len(w)
        for i, n in enumerate(longest):
            if n >= rules.least_words:
                cover[i : i + n] = [True] * n
        split = text.split("\n")
        assert (m["n_words"][0], m["word_chars"][0], m["n_repeat_words"][0]) == (len(w), sum(map(len, w)), sum(repeated))
        assert m["n_dup_lines"][0] == sum(1 for i, x in enumerate(split) if x.split() and x in split[:i]) and m["n_symbols"][0] == sum(c in "#*$%&|<>" for c in text)
        chars, most = sum(len(x) for x, c in zip(w, cover, strict=True) if c), max((n for n in longest if n >= rules.least_words), default=0)
        assert (m["repeat_chars"][0], m["longest_repeat_words"][0]) == (chars, most)
        bad = len(w) < 50 or 100 * sum(repeated) > 50 * len(w)
        assert failed[0] == bad and kept[0] == (not bad and chars <= rules.most_covered * sum(map(len, w)) and most <= rules.longest_words)


def test_packed_ids_are_the_library_s():
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path("byte_bpe_50k.json"))
    from tarnwick.llm.packing import encoder

    rng = random.Random(11)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "it's I'd 'S", "\x00\x1f\x85 a", "🙂🙃 é", "-" * 500, " " * 40 + "x"] + ["".join(rng.choices("ab cd'\n\t 12é日 🙂.,!<|>", k=rng.choice([5, 50, 500]))) for _ in range(300)]
    encode = encoder("byte_bpe_50k.tiktoken")
    assert [encode(t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_pii_base_against_patterns():
    rng = random.Random(2)

    def plain(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
        return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    for _ in range(5000):
        t = "".join(rng.choices("0123456789..--@@+ ab()%\n", k=rng.choice([8, 30, 80])))
        assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_field_carries_a_label_to_a_repeated_mention():
    p = pii.potentials([(*k, n) for k, n in pii.tally(["call +1 (504) 555-2652 x +1 (504) 555-2652", "order 12 and 13"] * 40).items()])
    t = "Call +1 (504) 555-2652, later 504-555-2652, room 12."
    base, added = pii.all_spans(t, p)
    assert [(k, t[s:e]) for k, s, e in added] == [(3, "504-555-2652")]
    assert pii.masked(t, base + added) == "Call <phone>, later <phone>, room 12."
    assert pii.all_spans("room 504-555-2652 and 12", p) == ([], [])


def test_field_finds_what_repeats_and_leaves_what_does_not():
    card = "4465758382889437"
    p = pii.potentials([(*k, n) for k, n in pii.tally([f"paid by {card} to us"] * 40 + ["number 9870157079875996 here"] * 40 + ["write to ann@example.com or bob@example.org"] * 200).items()])
    t = f"ramiar, {card} {card} then"
    assert pii.base_spans(t) == [] and [(k, t[s:e]) for k, s, e in pii.all_spans(t, p)[1]] == [(2, card)] * 2
    assert pii.all_spans("9870157079875996 and 9870157079875996", p) == ([], [])
    t = "ann@example.com wrote to user@host"
    base, added = pii.all_spans(t, p)
    assert [t[s:e] for _, s, e in base] == ["ann@example.com"] and added == []
    long = "1 " * 50_000 + "a" * 100_000 + " " + "b@" * 20_000
    assert len(list(pii.mentions(long))) > 50_000 and pii.all_spans(long, p)[1] == []


def test_marginals_against_all_labellings():
    from itertools import product

    rng = np.random.default_rng(7)
    for loops in (False, True):
        for _ in range(30):
            n = int(rng.integers(2, 6))
            chain = [(i - 1, i) for i in range(1, n)]
            skip = [(0, n - 1)] if loops and n > 2 else []
            f = pii.Field([(i, i + 1) for i in range(n)], ["s%d" % i for i in range(n)], [-1] * n, chain, skip)
            p = pii.Potentials({f"s{i}": np.log(rng.dirichlet(np.ones(pii.LABELS))) for i in range(n)}, 0.5 * rng.normal(size=(pii.LABELS, pii.LABELS)), np.eye(pii.LABELS), np.zeros(pii.LABELS))
            want = np.zeros((n, pii.LABELS))
            for y in product(range(pii.LABELS), repeat=n):
                w = np.exp(sum(p.unary[f"s{i}"][y[i]] for i in range(n)) + sum(p.chain[y[a], y[b]] for a, b in chain) + sum(p.skip[y[a], y[b]] for a, b in skip))
                want[range(n), y] += w
            want /= want.sum(axis=1, keepdims=True)
            assert np.abs(pii.marginals(f, p) - want).max() < (0.08 if skip else 1e-3)


def test_token_counts_equal_the_library(monkeypatch):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["", "a" * 3000, " " * 300 + "x", "<|endoftext|>", "a<|endoftext|> b", "it's they'll I'd 'S", "\x00\x1f\x85 a b", "🙂🙃" * 40 + " é", "-" * 3000]
    texts += ["".join(rng.choices("ab cd'\n\t 12é日 🙂.,!<|>", k=rng.choice([5, 50, 500]))) for _ in range(300)]
    want = [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]
    count = tokens.TokenCounter(path("byte_bpe_50k.json"))
    assert [count.count(t) for t in texts] == want
    monkeypatch.setattr(tokens, "CHUNK", 16)
    assert [count.count(t) for t in texts] == want
    assert count.count(None) == 0


def test_state_maps_compose_associatively():
    count = tokens.TokenCounter(path("byte_bpe_50k.json"))
    a, b, c = (count.state_map(t) for t in ("some text here", "and", " then more of it"))
    left, right = count.compose(count.compose(a, b), c), count.compose(a, count.compose(b, c))
    assert left == right


def test_state_maps_give_what_the_run_gives(monkeypatch):
    count = tokens.TokenCounter(path("byte_bpe_50k.json"))
    rng = random.Random(8)
    parts = ["'", "'r", "'re", "'ll", "s", "t", " ", "  ", "\n", "\t", "\xa0", "a", "é", "7", "²", "!", "--", "日本", "🙂", "the", "'S"]
    for n in range(300):
        entry, a, b, c = ("".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(4))
        state, _ = count.run(tokens.BETWEEN, entry)
        for text in (a, a + b, a + b + c):
            head, inner, left = count.state_map(text)
            after, first = count.run(state, head)
            assert (left or after, first + inner) == count.run(state, text), (entry, text)
        maps = [count.state_map(x) for x in (a, b, c)]
        head, inner, left = count.compose(maps[0], count.compose(maps[1], maps[2]))
        after, first = count.run(state, head)
        assert (left or after, first + inner) == count.run(state, a + b + c)
        monkeypatch.setattr(tokens, "MOST_STATES", 300_000 if n % 2 else 5)


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 20, 2), Limits(16, 1, 16, 1)])
def test_packer_keeps_limits_and_every_token(limits):
    rng = random.Random(4)
    out = []
    packer = VectorPacker(limits, lambda pieces: out.append(list(pieces)))
    docs = [np.arange(rng.choice([1, 3, 40, 1500]), dtype="<u4") for _ in range(150)]
    for i, ids in enumerate(docs):
        packer.add(Piece(i, 0, ids, len(ids), rng.randrange(10)))
    packer.finish()
    for pieces in out:
        n = sum(len(p.ids) for p in pieces)
        assert n == limits.tokens or n & (n - 1) == 0
        assert len(pieces) <= limits.segments and sum(p.loss for p in pieces) <= limits.loss and n <= limits.tokens
    for i, ids in enumerate(docs):
        own = sorted((p for pieces in out for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert np.array_equal(np.concatenate([p.ids for p in own]), ids)
        assert all(zlib.crc32(p.ids.tobytes()) == zlib.crc32(ids[p.start : p.start + len(p.ids)].tobytes()) for p in own)


def test_main_text():
    none = frozenset()
    page = '<html><head><title>x</title></head><body><nav><li>Menu</nav><div class="ad">Buy</div><article><h1>T &amp; t</h1><p><b>One  two<br>three<p>four<div class="comments"><p>bad</div></article><footer>f'
    assert pages.main_text(page, none) == "T & t\nOne two three\nfour"
    assert pages.main_text("<div><p>a<b>b</b> c</p>tail</div><script>1<2</script>z &lt; <", none) == "ab c\ntail\nz < <"
    block = pages.number("b", "/html/body/div", "Site")
    assert pages.main_text("<html><body><div>Site</div><div>own</div>", frozenset([block])) == "own"
    for odd in ("", "<", "</p></p>", "<a href='x>y", "<!-- open", "<script>", "plain"):
        pages.main_text(odd, none)


def test_main_text_of_marked_articles():
    none = frozenset()
    inner = '<article class="post comments-open" data-role="search"><p data-id="comments">one<p title=\'x id="ads"\'>two<div class="comments">bad</div><div class="cookie-notice">bad</div></article>'
    for page in ('<body class="single has-sidebar search">{}</body>', '<div id="search-wrapper">{}</div>', '<div class="search">{}</div>', '<main class="social-studies social">{}</main>', '<div class="widget"><div role="main" id="search">{}</div></div>'):
        assert pages.main_text(page.format(inner), none) == "one\ntwo", page
    assert pages.main_text(f'{inner}<div class="related"><article>other</article></div>', none) == "one\ntwo"


def test_arrow_bytes_of_slices_and_nulls():
    from tarnwick.llm.bytetext import text_bytes, words_of

    column = pa.array(["skip", "a b", None, "", "é\tc"]).slice(1)
    data, offsets = text_bytes(column)
    assert bytes(data) == "a bé\tc".encode() and offsets.tolist() == [0, 3, 3, 3, 7]
    start, end, row = words_of(data, offsets)
    assert [bytes(data[s:e]).decode() for s, e in zip(start, end, strict=True)] == ["a", "b", "é", "c"] and row.tolist() == [0, 0, 3, 3]
