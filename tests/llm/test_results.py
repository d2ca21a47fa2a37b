"""Each operator and its query against a brute-force version or a held-out measure, on the small tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction
from itertools import islice
from math import log, log10

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import brown, cws, decontam, html, langid, mixing, queries, repeats, secrets, simhash, suffix, tokens
from tarn.llm.common import components


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def run(spark, small, name):
    return queries.QUERIES[name](spark, small).collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


# ---- op1


def norm(s):
    return " ".join(re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", s.lower()).split())


def test_op1_finds_exact_copies_and_nothing_else(spark, small, texts):
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, s in items.items() if s and f" {s} " in f" {norm(t)} "}
    assert {(r.doc_id, r.item_id) for r in run(spark, small, "op1_decontamination")} == want and want


def test_op1_finds_edited_copies(texts):
    rng = random.Random(1)
    pool = [w for t in list(texts.values())[:50] for w in t.split()]
    own = [" ".join(rng.choice(pool) + str(i) for i in range(30)) for _ in range(20)]
    items = decontam.Items(list(range(20)), own)
    items.weigh(100, np.ones(len(items.grams), np.int64))
    for k, text in enumerate(own):
        edited = [rng.choice(pool) if j % 6 == 3 else w for j, w in enumerate(text.split())]
        host = " ".join(pool[:200] + edited + pool[200:400])
        assert [m[1] for m in decontam.matches(items, [host])] == [k]
    assert decontam.matches(items, [" ".join(pool)]) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=15))
def test_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    assert decontam.align(np.array(a, int), np.array(b, int))[0] == h.max()


def test_op1_many_items_that_share_a_phrase():
    rng = random.Random(14)
    phrase = "choose the best of these answers"
    own = [phrase + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(1000)]
    items = decontam.Items(list(range(1000)), own)
    items.weigh(100, np.ones(len(items.grams), np.int64))
    text = " ".join([phrase] * 300 + own[7].split() + [phrase] * 20)
    start = time.perf_counter()
    found = decontam.matches(items, [text, phrase])
    assert time.perf_counter() - start < 30
    assert [(d, i) for d, i, s, *_ in found if s == 1] == [(0, 7)] and {d for d, *_ in found} == {0}


def test_op1_slices_of_hits_change_nothing(texts, monkeypatch):
    own = [" ".join(t.split()[:20]) for t in list(texts.values())[:60]]
    items = decontam.Items(list(range(60)), own)
    items.weigh(100, np.ones(len(items.grams), np.int64))
    whole = decontam.matches(items, list(texts.values()))
    monkeypatch.setattr(decontam, "HITS", 50)
    monkeypatch.setattr(decontam, "CELLS", 500)
    assert decontam.matches(items, list(texts.values())) == whole and whole


# ---- op2


def test_op2(spark, small):
    for r in run(spark, small, "op2_html_extraction"):
        assert r.n_chars == len(r.text) and "<" not in r.text.replace("<3", "")
    page = """<html><head><title>t</title></head><body><header><a href=x>Home</a> Site of the day</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site and you have to agree with it.</div><main><h1>A title &amp; more</h1><p>The cat is on the mat   and it was
    a <b>long</b> day for the dog that was in the house.<p>Short.<script>var a = "<p>no</p>";</script><div class="ad">Buy it now for the best of all</div>
    <form><p>Name of the user</p></form><aside>More of the same</aside></main><div id="comments"><p>I like this and that is all that I have to say about it here.</p></div><footer>The end</footer>"""
    assert html.extract(page) == "A title & more\nThe cat is on the mat and it was a long day for the dog that was in the house.\nShort."
    plain = "<div>" + "".join(f"<p>The {w} is on the way to the town and it is a long way for all of us to go there today.</p><p>{w}!</p>" for w in ("man", "dog")) + "<div><a href=1>the next one of these</a> <a href=2>and this</a></div></div>"
    assert html.extract(plain).count("\n") == 2


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><p>Article text.</p>", "Article text."),
        ("<html><head><title>t</title><meta name=a><p>Article text.</p>", "Article text."),
        ("<head><title>t</title></head><p>Article text.</p>", "Article text."),
        ("<p>One.</p><svg width=1 /><p>Two.</p><p>Three.</p>", "One.\nTwo.\nThree."),
        ("<p>One.</p><svg><text>no</text></svg><video src=x><p>Two.</p>", "One.\nTwo."),
        ("<p>One.</p><script>var a = '<p>no</p>'", "One."),
    ],
)
def test_op2_reads_on_after_omitted_end_tags(page, text):
    assert html.extract(page) == text


_SENTENCES = {
    "en": "The %s was in the house and it is said that all of them were on the way to the town with the %s.",
    "fr": "Le %s est dans la maison et il se dit que les autres sont sur le chemin de la ville avec une %s.",
    "de": "Der %s war in dem Haus und es ist nicht klar, ob die anderen auf dem Weg in die Stadt mit der %s waren.",
    "es": "El %s estaba en la casa y se dice que los otros son como una parte de la ciudad con el %s.",
}
_LINKS = "".join(f'<li><a href="/{i}">Section number {i} of the site</a>' for i in range(8))


def _article(rng, lang):
    """(blocks of an article, their html) of a title, running text, lists and short lines."""
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(3, 9)))
    line = lambda: _SENTENCES[lang] % (word(), word())
    texts, markup = [f"{word()} & {word()} {word()}"], []
    markup.append(f"<h1>{texts[0].replace('&', '&amp;')}</h1>")
    for _ in range(rng.randrange(2, 7)):
        kind = rng.choice(["p", "p", "open", "list", "quote", "bold"])
        if kind == "list":
            items = [line() for _ in range(3)]
            markup.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            texts += items
        else:
            t = " ".join(line() for _ in range(rng.randrange(1, 4)))
            texts.append(t)
            shown = t.replace(" ", rng.choice([" ", "  ", "\n", " <!-- x -->"]), 1)
            markup.append({"p": f"<p>{shown}</p>", "open": f"<p>{shown}", "quote": f"<blockquote>{shown}</blockquote>", "bold": f"<p><b>{shown}</b><script>var a = '<p>no</p>';</script></p>"}[kind])
    return "\n".join(texts), "".join(markup)


def _page(rng, number):
    lang = rng.choice(list(_SENTENCES))
    text, article = _article(rng, lang)
    other = lambda n: " ".join(_SENTENCES[lang] % ("reader", "site") for _ in range(n))
    side = f'<div class="sidebar"><p>{other(1)}</p><ul>{_LINKS}</ul></div>'
    comments = f'<div id="comments"><ol class="comment-list"><li><article class="comment"><p>{other(4)}</p></article></li></ol></div>'
    body = [
        f'<article class="post-{number} post category-legal tag-search has-sidebar">{article}</article>',
        f'<article class="category-social">{article}</article>{side}{comments}',
        f'<div class="content-sidebar-wrap"><main>{article}</main>{side}</div>',
        f'<div class="content-sidebar-wrap"><div class="entry">{article}</div>{side}</div>',
        f'<div id="layout-sidebar-right"><div class="text">{article}</div>{side}</div>',
        f'<form id="aspnetForm" method="post"><div class="menu">{_LINKS}</div><div class="text">{article}</div>{side}<input type="hidden" value=">"></form>',
        f'<div class="text">{article}</div><div class="related-posts"><p>{other(1)}</p></div>{comments}',
        f'<div class="content-sidebar-wrap"><article>{article}</article>{side}</div>{comments}',
        f'<div class="nav-layout"><div class="nav-body">{article}</div></div>',
        f"<article>{article}</article><aside><p>{other(2)}</p></aside>",
        f'<div class="page"><div class="story">{article}</div></div>',
    ][number % 11]
    head = rng.choice([f"<head><title>{other(1)}</title></head>", f"<head><title>{other(1)}</title>", f"<head><title>{other(1)}</title><meta charset=utf-8>", ""])
    top = rng.choice(["", f"<nav><ul>{_LINKS}</ul></nav>", f'<header><a href="/">Home</a> {other(1)}</header>', f'<div class="cookie-banner" role="dialog"><p>{other(1)}</p><button>Yes</button></div>', f'<ul class="nav">{_LINKS}</ul>'])
    foot = rng.choice(["", f"<footer><p>{other(1)}</p></footer>", f'<div id="footer"><p>{other(1)}</p></div>', f'<form class="newsletter"><p>{other(1)}</p><label>Mail</label></form>', f'<div class="ad-slot"><p>{other(1)}</p></div>'])
    return f"<!DOCTYPE html><html>{head}<body>{top}{body}{foot}", text


def test_op2_on_known_articles(spark):
    rng = random.Random(9)
    made = [_page(rng, i) for i in range(330)]
    pages = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    assert [i for i, (_, t) in enumerate(made) if got[i] != t] == []


@pytest.mark.parametrize("part", ["<div>", '<a "', '<a ="', "<b>", "</b>", "<p", "<!", "<a>x", "<div class=nav>x", "<svg>", "<i></div>", "&lt;<"])
def test_op2_takes_time_in_proportion_to_the_page(part):
    start = time.perf_counter()
    html.extract(part * 200_000)
    assert time.perf_counter() - start < 30


# ---- op3


def repeated(data, length):
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_op3(spark, small, texts):
    ids = sorted(texts)
    gone = dict(zip(ids, repeated([texts[i].encode() for i in ids], 200)))
    for r in run(spark, small, "op3_suffix_dedup"):
        data, g = texts[r.doc_id].encode(), gone[r.doc_id]
        runs = int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), int(g.sum()), runs)
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(data, np.uint8)[~g].tobytes()).hexdigest()


def test_op3_on_periods_and_copies(spark):
    base = "".join(random.Random(2).choice("abcdefgh ") for _ in range(900))
    given_ = [base, base[300:800], "z" * 500, "ab" * 300, "q" + base[100:299], base[100:300], "é" * 150, "é" * 100, None, ""]
    df = spark.createDataFrame(list(enumerate(given_)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(df).collect()}
    for i, g in enumerate(repeated([(t or "").encode() for t in given_], 200)):
        assert got[i] == (int(g.sum()), int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)))


@pytest.mark.parametrize("hot", [500, 3000, 20_000])
def test_op3_hot_anchors_are_split_exactly(spark, hot):
    rng = random.Random(15)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = own(260)
    shorter = own(190)
    tails = [own(30) for _ in range(3)]
    given_ = [own(150) + shared + rng.choice(tails)[: rng.randrange(31)] + own(150) for _ in range(60)]
    given_ += [own(100) + shorter + rng.choice(tails) + own(100) for _ in range(60)]
    given_ += [given_[3], given_[70][40:], "z" * 700, "z" * 300, "ab" * 400]
    df = spark.createDataFrame(list(enumerate(given_)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, hot=hot).collect()}
    for i, g in enumerate(repeated([t.encode() for t in given_], 200)):
        kept = np.frombuffer(given_[i].encode(), np.uint8)[~g].tobytes()
        assert got[i] == (int(g.sum()), int(np.count_nonzero(np.diff(g.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest())


def test_op3_spills_and_recurses_through_the_operator(spark, monkeypatch):
    spilt = []
    plain = suffix.Queue._spill
    monkeypatch.setattr(suffix.Queue, "_spill", lambda self: (spilt.append(1), plain(self)))
    rng = random.Random(16)
    zones_ = ["".join(rng.choice("ab") for _ in range(250)).encode() for _ in range(8)]
    zones_ += [zones_[0][20:] + b"x", b"y" + zones_[1][:230]]
    masks = repeats.repeated_starts(zones_, [len(z) - 199 for z in zones_], room=50)
    assert spilt
    for mask, gone in zip(masks, repeated(zones_, 200)):
        edge = np.zeros(len(gone) + 1, int)
        for i in np.flatnonzero(mask):
            edge[i] += 1
            edge[i + 200] -= 1
        assert ((np.cumsum(edge[:-1]) > 0) == gone).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.sampled_from([3, 10, 1 << 20]))
def test_suffix_array(values, room):
    text = np.array([*values, 0], np.uint8)
    order, shared = suffix.suffix_array(text, 200, room)
    b = bytes(text)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    assert order.tolist() == want
    for x, y, n in zip(want, want[1:], shared[1:].tolist()):
        assert b[x : x + n] == b[y : y + n] and b[x + n : x + n + 1] != b[y + n : y + n + 1]


# ---- op4


def test_op4(spark, small, texts):
    counts = Counter()
    for d, t in texts.items():
        if fold(d, 5) != 1:
            counts.update([*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    held = []
    for r in run(spark, small, "op4_brown_lm"):
        line = [*words(texts[r.doc_id]), ""]
        base = sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in line)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 5) == 1, len(line), sum(counts[w] > 0 for w in line), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        if r.held_out:
            held.append((r.score, r.base_score))
    assert sum(a for a, _ in held) > sum(b for _, b in held)


def test_op4_rare_words_meet_their_counts_in_the_join(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sides = []
    for head in (50, brown.HEAD):
        model, counts, least = brown.train(docs, head=head)
        sides.append({r.id: (r.n_known, round(r.base_score, 6)) for r in brown.score(docs, model, counts, least).collect()})
    assert sides[0] == sides[1]


@pytest.mark.parametrize("head", [30, brown.HEAD])
def test_op4_classes_words_by_their_neighbours_not_their_spelling(spark, monkeypatch, head):
    monkeypatch.setattr(brown, "WORDS", 8)
    rng = random.Random(3)
    nouns, verbs = [f"n{chr(97 + i // 26)}{chr(97 + i % 26)}ab" for i in range(60)], [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}ab" for i in range(60)]
    line = lambda: f"the {rng.choice(['house', 'road', *nouns[:]])} must {rng.choice(['walk', 'turn', *verbs[:]])} and the house may walk the road can turn"
    df = spark.createDataFrame([(i, " ".join(line() for _ in range(4))) for i in range(400)], "doc_id long, text string").repartition(3)
    model, counts, least = brown.train(df, head=head)
    got = {bytes(r.word).decode(): (r.c, r["class"]) for r in counts.collect()}
    want = Counter(w for r in df.collect() if fold(r.doc_id, 5) != 1 for w in [*words(r.text), ""])
    assert {w: c for w, (c, _) in got.items()} == want
    assert {got[w][1] for w in nouns}.isdisjoint({got[w][1] for w in verbs})
    assert model.mass.sum() == sum(want.values()) and model.kinds.sum() == len(want)


def test_op4_ranks_endings_over_all_words(spark):
    counts = spark.createDataFrame([(b"the", 90), *[(f"w{i}xy".encode(), 1) for i in range(20)], (b"pqz", 15)], "word binary, c long")
    assert brown.endings_of(counts, {b"the": 0}, 1) == [b"xy"]


def test_op4_places_words_with_few_logarithms(monkeypatch):
    rng, k, words = np.random.default_rng(5), 16, 1500
    table = rng.integers(0, 400, (k, k)).astype(float)
    homes = rng.integers(0, k, words)
    keys = np.unique(rng.integers(0, words * 2 * k, 30_000))
    word, cell, n = keys // (2 * k), keys % (2 * k), rng.integers(1, 4, len(keys))
    f = lambda x: x * log(x) if x > 0 else 0.0
    want = []
    for w in range(words):
        mine = [(int(c), int(m)) for c, m in zip(cell[word == w], n[word == w])]
        total = sum(m for c, m in mine if c < k)
        gains = []
        for j in range(k):
            own = lambda x, m: max(x - m, 0.0) if j == homes[w] else x  # noqa: B023, E731
            gain = 0.0
            for c, m in mine:
                x = own(table[c, j] if c < k else table[j, c - k], m)
                gain += f(x + m) - f(x)
            for side in (table[:, j].sum(), table[j].sum()):
                gain -= f(own(side, total) + total) - f(own(side, total))
            gains.append(gain)
        best = int(np.argmax(gains))
        want.append(best if gains[best] > gains[homes[w]] + 1e-9 else homes[w])
    seen, plain = [], brown._information
    monkeypatch.setattr(brown, "_information", lambda x: (seen.append(np.size(x)), plain(x))[1])
    assert brown.place(table, homes, word, cell, n).tolist() == want
    assert sum(seen) < len(keys) * k  # twice this and more when each entry has its own


def test_op4_tally_passes_on_whole_counts(monkeypatch):
    monkeypatch.setattr(brown, "_PENDING", 50)
    monkeypatch.setattr(brown, "_CELLS", 30)
    rng, tally, got, want = random.Random(2), brown.Tally(), Counter(), Counter()
    for _ in range(200):
        keys = [int(rng.paretovariate(0.5)) % 90 for _ in range(rng.randint(0, 20))]
        want.update(keys)
        if tally.add(np.array(keys, np.int64)):
            got.update(dict(zip(*(x.tolist() for x in tally.merged()))))
            tally.clear()
        assert tally.pending <= 50
    got.update(dict(zip(*(x.tolist() for x in tally.merged()))))
    assert got == want


def test_op4_words_whose_rows_span_batches(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60).repartition(7).cache()
    want = Counter(w for r in docs.collect() if fold(r.doc_id, 5) != 1 for w in [*words(r.text), ""])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        model, counts, _ = brown.learn(docs, head=40)
        rows = counts.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = {bytes(r.word): r["class"] for r in brown.learn(docs, head=40)[1].collect()}
    assert len(rows) == len(want) and {bytes(r.word).decode(): r.c for r in rows} == want
    assert {bytes(r.word): r["class"] for r in rows} == whole


# ---- op5

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_op5(spark, small, texts, tmp_path):
    for r in run(spark, small, "op5_secret_scan"):
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest()
    tricky = [
        'é🙂 Password = "abcdef" secret:token = "ghijkl" api_key:"A/b+c=.-_" apikey=12345 TOKEN:x token=token=token',
        "AKIA" + "A1" * 8 + " AKIASHORT xAKIA" + "Z" * 16 + " deadbeef" * 4 + " " + "0123456789abcdef" * 3,
        "-----BEGIN RSA PRIVATE KEY----- " + "ghp_" + "aB3" * 12,
    ]
    spark.createDataFrame([(i, t, "en", f"s{i}") for i, t in enumerate(tricky)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in run(spark, str(tmp_path), "op5_secret_scan")}
    for i, t in enumerate(tricky):
        assert got[i].base_sha256 == hashlib.sha256(base_spans(t).encode()).hexdigest()
    assert "private_key:0:31" in got[2].spans and "vendor:32:" in got[2].spans


BEGIN, END = (rf"-----{x} [A-Z ]{{0,40}}PRIVATE KEY-----" for x in ("BEGIN", "END"))
KINDS = {
    "assign": ASSIGN,
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
    "private_key": re.compile(secrets.FURTHER["private_key"]),
    "vendor": re.compile(secrets.FURTHER["vendor"]),
    "jwt": re.compile(secrets.FURTHER["jwt"]),
    "opaque": re.compile(secrets.FURTHER["opaque"]),
}


def all_spans(t):
    """(start, kind's number, end, kind, value) of every span of a text, in order."""
    out = []
    for o, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(t):
            value = m[2] if kind == "assign" else re.sub(rf"{BEGIN}|{END}|\s|\\[nr]", "", m[0]) or m[0] if kind == "private_key" else m[0]
            if {"assign": len(value) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24, "opaque": all(re.search(x, m[0]) for x in ("[0-9]", "[A-Z]", "[a-z]"))}.get(kind, True):
                out.append((m.start(), o, m.end(), kind, value))
    return sorted(out)


def test_op5_ownership_by_brute_force(spark, small, tmp_path):
    rng = random.Random(5)
    shape = "doc_id long, text string, lang string, source string"
    own = [(i, f"page {i} of a handbook that was written by hand holds token = \"{rng.getrandbits(80):x}\" and {'aB3' * 12}{i}", f"l{i % 3}", f"s{i % 40}") for i in range(120)]
    wide = [(200 + i, f"page {i} of another handbook: password: \"changeme99\" AKIA{'EXAMPLE0' * 2} {'Zz9' * 14}", f"l{i % 3}", f"s{i}") for i in range(30)]
    copied = [(300 + i, "one page, mirrored by many others as it is, with secret=mirrored-value in it and some more", "l1", f"s{i}") for i in range(20)]
    keys = [(400 + i, f"a key of {i}:\n-----BEGIN RSA PRIVATE KEY-----\n{('kEy%02d' % (i % 2)) * 16}\n-----END RSA PRIVATE KEY-----\n", "l0", f"s{i}") for i in range(9)]
    rows = own + wide + copied + keys + [(500, None, None, None), (501, "", "l1", None)]
    spark.createDataFrame(rows, shape).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    most = max(2, -(-len({r[3] for r in rows}) // 100))
    places = {}
    for doc, text, lang, source in rows:
        copy = text if text is not None and len(text) >= secrets.COPY_CHARS else (lang, source)
        for *_, value in all_spans(text or ""):
            places.setdefault(value, {}).setdefault(copy, set()).add((source, (source, lang)))
    # of a mirrored text's owners any one may count: their number is what brute force can tell
    live = {v: len(by) <= most if any(len(x) > 1 for x in by.values()) else min(len({s for x in by.values() for s, _ in x}), len({r for x in by.values() for _, r in x})) <= most for v, by in places.items()}
    got = {r.doc_id: r for r in run(spark, str(tmp_path), "op5_secret_scan")}
    assert len(got) == len(rows) and 0 < sum(live.values()) < len(live)
    for doc, text, *_ in rows:
        found = all_spans(text or "")
        alive = [x for x in found if live[x[4]]]
        assert got[doc].spans == ",".join(f"{k}:{a}:{b}" for a, o, b, k, v in found if o < 3 or live[v])
        assert (got[doc].n_live, got[doc].n_example) == (len(alive), sum(o < 3 and not live[v] for _, o, _, _, v in found))


def test_op5_takes_time_in_proportion_to_the_spans(spark):
    text = " ".join("deadbeef" * 3 + f"{i:08x}" for i in range(20_000)) + " token=é🙂token=abcdefg"
    df = spark.createDataFrame([(1, text, "en", "a")], "doc_id long, text string, lang string, source string")
    start = time.perf_counter()
    r = secrets.scan(df).first()
    assert time.perf_counter() - start < 60
    assert [(x.s, x.e, x.kind) for x in r.base] == [(a, b, k) for a, o, b, k, _ in all_spans(text) if o < 3]
    assert secrets.redact(df).first().text == " ".join(["<SECRET>"] * 20_000) + " token=é🙂<SECRET>"


# ---- op6


def test_op6(spark, small, texts):
    encode = tokens.Counter().encoding.encode_ordinary
    for r in run(spark, small, "op6_token_counts"):
        t = texts[r.doc_id]
        a, b, new = tokens.sample_edit(t)
        assert (r.n_tokens, r.edited_n_tokens) == (len(encode(t)), len(encode(t[:a] + new + t[b:])))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t'sdlve re12,.é漢", max_size=300), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 40), st.text(alphabet=" 'slab1.\n", max_size=9)), max_size=4))
def test_token_tree(text, edits):
    count = tokens.Counter() if not hasattr(test_token_tree, "count") else test_token_tree.count
    test_token_tree.count = count
    tree = tokens.TokenTree(text * 3, count)
    for at, size, new in edits:
        at = min(at, len(tree.text))
        tree.replace(at, min(len(tree.text), at + size), new)
        assert tree.n_tokens == len(count.encoding.encode_ordinary(tree.text)) and tree.chars[1] == len(tree.text)


# ---- op7


def test_op7(spark, small):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = run(spark, small, "op7_language_id")
    held = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean(held) > 0.97


def plain_language(model, text):
    """(language, share) of a text, a word at a time, by the definition."""
    logs = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        grams, _, _ = langid.word_grams([word], model.bits)
        logs.append([float(sum(model.table[g, j] for g in grams)) for j in range(len(model.languages))])
    if not logs:
        return "und", 0.0

    def fitted(members):
        pi = {j: 1 / len(members) for j in members}
        for _ in range(langid.ROUNDS):
            sums = dict.fromkeys(members, 0.0)
            for w in logs:
                top = max(w)
                part = {j: pi[j] * np.exp(max(w[j] - top, -300.0)) + 1e-300 for j in members}
                for j in members:
                    sums[j] += part[j] / sum(part.values())
            pi = {j: sums[j] / len(logs) for j in members}
        return pi, sum(max(w) + np.log(sum(pi[j] * np.exp(max(w[j] - max(w), -300.0)) for j in members) + 1e-300) for w in logs)

    every = list(range(len(model.languages)))
    first = max(every, key=lambda j: (sum(w[j] for w in logs), -j))
    best = (2 * sum(w[first] for w in logs), {first: 1.0})
    order = sorted(every, key=lambda j: (-fitted(every)[0][j], j))
    for k in range(2, len(every) + 1):
        pi, value = fitted(order[:k])
        if 2 * value - (k - 1) * np.log(len(logs)) > best[0]:
            best = (2 * value - (k - 1) * np.log(len(logs)), pi)
    lead = max(best[1], key=lambda j: (best[1][j], -j))
    return model.languages[lead], best[1][lead]


def test_op7_by_brute_force(spark, small, texts):
    model = langid.learn(spark.read.parquet(f"{small}/documents.parquet"))
    rng = random.Random(8)
    ids = sorted(d for d in texts if len(texts[d]) < 1500)[:40]
    mixed = [texts[a][:200] + " " + texts[b][:200] for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(15))]
    for text in [texts[d] for d in ids] + mixed + ["", "12 !", "a"]:
        (lang, share, _, _), (want, want_share) = model.predict([text])[0], plain_language(model, text)
        assert lang == want and abs(share - want_share) < 1e-6


def test_language_stage_rejects_what_no_learnt_language_explains(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    strange = ["Это русский текст о погоде и о доме", "漢字だけの文章です。これは日本語。", "zxqj kjwq vvkx qqzz xxjk wvwv", "1234 !", None]
    more = spark.createDataFrame([(10**6 + i, t, None, "s", 1) for i, t in enumerate(strange)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), small).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


# ---- op8


def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closed(nodes, linked):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_op8(spark, small, texts):
    prints = {d: fingerprint(t) for d, t in texts.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = closed(prints, links)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, small, "op8_simhash_near_dedup")} == {d: (f"{prints[d]:016x}", groups[d]) for d in prints}


@pytest.mark.parametrize("count, tile", [(2, 8), (10**6, 8), (10**9, 10**6)])
def test_op8_blocks_and_tiles_lose_no_link(spark, count, tile):
    rng = random.Random(count)
    values = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        x = rng.choice(values)
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << b
        values.append(x)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.close_links(df, count, tile=tile).collect()]
    want = [(signed[i], signed[j]) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    assert set(found) <= {p for a, b in want for p in ((a, b), (b, a))}
    assert closed(signed, found) == closed(signed, want)


def shingles(text, width=5):
    w = words(text)
    return frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_texts_by_brute_force(spark, small, texts):
    rng = random.Random(12)
    given_ = dict(texts)
    for d in rng.sample(sorted(d for d in texts if len(texts[d].split()) > 60), 40):  # edited copies
        w = texts[d].split()
        for i in range(0, len(w), rng.choice([60, 80, 150])):
            w[i] = f"other{rng.randrange(99)}"
        given_[len(given_) + 1000] = " ".join(w)
    df = spark.createDataFrame(list(given_.items()), "doc_id long, text string").repartition(5)
    group = {r.id: r.group for r in simhash.near_texts(df).collect()}
    sets = {d: shingles(t) for d, t in given_.items()}
    ids = sorted(sets)
    pairs = {(a, b): alike(sets[a], sets[b]) for a in ids for b in ids if a < b and (group[a] == group[b] or 5 * len(sets[a] & sets[b]) > 3 * max(len(sets[a]), len(sets[b])))}
    surely, maybe = closed(ids, [p for p, s in pairs.items() if s >= 0.85]), closed(ids, [p for p, s in pairs.items() if s >= 0.55])
    close = [p for p, s in pairs.items() if s >= 0.8]
    assert len(close) > 40 and sum(group[a] == group[b] for a, b in close) >= 0.97 * len(close)
    assert all(group[a] == group[b] for a, b in pairs if surely[a] == surely[b])
    assert all(maybe[a] == maybe[b] for a, b in pairs if group[a] == group[b])
    kept = sorted(r.doc_id for r in simhash.keep_first(df).collect())
    assert kept == sorted({g: min(d for d in ids if group[d] == g) for g in group.values()}.values())


def test_keep_rows_sent_or_sorted(spark, tmp_path):
    spark.range(1000).selectExpr("id", "'text ' || id AS word").repartition(7).write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    picked = simhash.numbered(source).filter("kept.id % 3 = 1").select("row")
    expected = [(i, f"text {i}") for i in range(1, 1000, 3)]
    for most in (simhash.WORDS_HELD, 0):
        assert sorted(tuple(r) for r in simhash.keep_rows(source, picked, most).collect()) == expected
    assert simhash.keep_rows(source, picked.limit(0)).count() == 0


def test_near_texts_tiles_lose_no_link(spark):
    rng = random.Random(13)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(i, " ".join([*base[: i % 90], f"own{i}", *base[i % 90 + 1 :]])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len({r.group for r in simhash.near_texts(df, tile=16).collect()}) == 1


def test_rows_of_one_id_are_judged_each_for_itself(spark):
    long = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(1, long("a")), (1, long("b")), (2, long("a")), (3, long("b")), (1, long("a")), (None, long("a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[:1]) for r in simhash.keep_first(df).collect()) == [(0, "a"), (1, "a"), (1, "b")]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closed({x for e in edges for x in e}, edges)
    assert got == {x: c for x, c in want.items() if any(x in e and e[0] != e[1] for e in edges)}


# ---- op9


def test_op9(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    told = con.sql(mixing.ORACLE)
    got = [r.asDict() for r in run(spark, small, "op9_source_mix")]
    want = [dict(zip(told.columns, r)) for r in told.fetchall()]
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)


def test_slots_are_those_of_a_plain_earliest_deadline_first():
    rng = random.Random(6)
    for _ in range(30):
        parts = {str(i): rng.randrange(1, 60) for i in range(rng.randrange(1, 7))}
        blocks = {s: rng.randrange(0, 25) for s in parts}
        total, done, slot, want = sum(parts.values()), dict.fromkeys(parts, 0), 0, []
        while any(done[s] < blocks[s] for s in parts):
            ready = [(-(-(done[s] + 1) * total // parts[s]), i, s) for i, s in enumerate(x for x in parts if blocks[x]) if done[s] < blocks[s] and done[s] * total // parts[s] <= slot]
            if ready:
                deadline, _, s = min(ready)
                want.append((s, done[s], done[s] * total // parts[s], deadline, slot))
                done[s] += 1
            slot += 1
        assert list(mixing.slots(parts, blocks)) == want


def test_op9_weights_of_zero_and_rows_of_one_id(spark):
    df = spark.createDataFrame([(i % 3, f"t{i}", "a" if i % 2 else "b") for i in range(200)], "doc_id long, text string, source string")
    got = mixing.interleave(df, {"a": 1.0, "b": 0.0}, block=1)
    order = [r.source for r in got.orderBy("mix_order").collect()]
    assert order[:1] + order[2:101] == ["a"] * 100 or order[:100] == ["a"] * 100 and len(order) == 200
    again = mixing.interleave(df.repartition(5), {"a": 1.0, "b": 0.0}, block=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(1e-4, 1000), min_size=1, max_size=25))
def test_slots_deviate_by_less_than_a_block_from_the_weights_themselves(weights):
    parts = mixing.exact({str(i): w for i, w in enumerate(weights)})
    total = sum(Fraction(w) for w in weights)
    had = dict.fromkeys(parts, 0)
    for source, _, release, deadline, slot in islice(mixing.slots(parts, dict.fromkeys(parts, 10**9)), 3000):
        assert release <= slot < deadline
        had[source] += 1
    assert slot == 2999 and all(abs(had[str(i)] - Fraction(w) / total * 3000) < 1 for i, w in enumerate(weights))


@pytest.mark.parametrize("weights", [None, {"0": 0.9996, "1": 0.0004}])
def test_op9_deviates_by_less_than_a_block_beyond_a_cycle(spark, weights):
    n = 20 if weights is None else 2
    df = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % n).cast("string").alias("source"))
    got = sorted((r.mix_slot, r.source) for r in mixing.interleave(df, weights, block=1).collect())
    had, left = Counter(), Counter(s for _, s in got)
    for slot, source in got:
        had[source] += 1
        for s in left:
            w = weights[s] if weights else 1 / n
            assert had[s] == left[s] or abs(had[s] - w * (slot + 1)) < 1 + 1e-6


# ---- op10


def jaccard(a, b):
    a, b = Counter(words(a)), Counter(words(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_op10(spark, small, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in run(spark, small, "op10_weighted_fingerprints")}
    errors, prints = [], {}
    for i, d in enumerate(ids):
        text, after, r = texts[d], texts[ids[(i + 1) % len(ids)]], got[d]
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
        errors.append(r.near_edited - jaccard(text, new))
        errors.append(r.near_next - jaccard(text, after))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


def test_op10_collisions_of_weights():
    sampler = cws.Sampler(2000)
    a, b = Counter({b"x": 5, b"y": 1, b"z": 2}), Counter({b"x": 2, b"y": 3, b"w": 1})
    sampler.learn([*a, *b])
    want = sum((a & b).values()) / sum((a | b).values())
    assert abs(cws.likeness(sampler.sample(a), sampler.sample(b)) - want) < 0.05


def test_op10_words_beyond_the_room_are_taken_in_slices():
    words = Counter({f"w{i}".encode(): 1 + i % 4 for i in range(5000)})
    small, large = cws.Sampler(64, room=300), cws.Sampler(64, room=10_000)
    large.learn(words)
    assert (small.sample(words) == large.sample(words)).all() and len(small.seeds) == 300


# ---- pipeline


def test_pipeline(spark, small, texts):
    got = corpus_pipeline.run(spark, small).collect()
    groups: dict = {}
    for r in simhash.near_texts(spark.read.parquet(f"{small}/documents.parquet")).collect():  # itself tested by brute force
        if any(c.isalpha() for c in texts[r.id]):
            groups.setdefault(r.group, []).append(r.id)
    firsts = {min(x) for x in groups.values()}
    items = [s for s in (norm(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()) if s]
    want = {d for d in firsts if not any(f" {s} " in f" {norm(texts[d])} " for s in items)}
    assert {r.doc_id for r in got} == want
    assert all(r.text == texts[r.doc_id] or "<SECRET>" in r.text for r in got)
    assert len({r.mix_order for r in got}) == len(got)
