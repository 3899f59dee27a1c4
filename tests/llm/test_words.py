"""Operators 11 to 13 against plain versions of their contracts, on edge rows, and against known structure."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quillspark.llm import divergence, html, spelling, toxicity

R = random.Random(13)
WORDS = ["".join(R.choice("abcdeéß") for _ in range(R.randint(5, 9))) for _ in range(60)]
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, word string, block int"


def typo(w):
    i, c = R.randrange(len(w)), R.choice("abcdeé")
    return R.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w])


def text(n):
    return " ".join(typo(w) if R.random() < 0.2 else w for w in (R.choice(WORDS[: R.choice((5, 60))]) for _ in range(n)))


def rows():
    out = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n9_[", None, "a"), (4, "Ünder ÜNDER under×under", "en", "a"), (None, text(40), "en", "b"), (5, "x" * 40 + " " + "é" * 33, "de", "z")]
    out += [(6, "rare words", "zz", "a"), (7, "", "zz", "b"), (8, None, "zz", None)]
    out += [(10 + i, text(R.randint(1, 90)).upper() if i % 7 == 0 else text(R.randint(1, 90)), R.choice(("en", "de", "fr")), R.choice("abc")) for i in range(150)]
    out += [(200, text(12000), "en", "c"), (201, "q" * 3000 + " " + "q" * 3001, "en", "c")] + [out[30]] * 3
    return out


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with the names that the operators use inside
    return spark.createDataFrame([(*r, 7, "t", "w", 1) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# operator 12


def brute_divergence(rows, least):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {x for x, _ in count}:
        kept = {t for t, n in seen[lang].items() if n >= least}
        own = {s: {t: count[lang, s][t] for t in kept} for x, s in count if x == lang}
        own[None] = {t: sum(o[t] for o in own.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(o.values()) + 5 * len(kept)) for t, n in o.items()} for s, o in own.items()}
        for s in own.keys() - {None}:
            found = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own.keys() - {None, s}], "term": [(t, p[s][t] - p[None][t]) for t in kept if own[s][t] and p[s][t] > p[None][t]]}
            for part, items in found.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[: 50 if part == "term" else None]
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(ranked)]
    return sorted(out)


def test_divergence(docs, none):
    for least, cells in ((3, 200_000), (30, 40)):  # many blocks of few cells as well
        got = sorted(tuple(r) for r in divergence.divergence_report(docs, least, cells).collect())
        assert got == brute_divergence(ROWS, least)
    assert {r[0] for r in got if r[2] == "pair" and r[4] == 0}  # a lang without kept terms
    assert divergence.divergence_report(none).count() == 0


def test_slice_hashes_are_xxhash():
    raw = np.frombuffer(bytes(R.randrange(256) for _ in range(6000)) + b" " * 9, np.uint8)
    first = np.array([R.randrange(5800) for _ in range(2000)])
    last = first + np.array([R.randint(0, 70) for _ in range(2000)])
    got = divergence.slice_hashes(raw, first, last)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[i:j].tobytes()) for i, j in zip(first, last)]


def test_equal_hashes_are_verified(monkeypatch):
    texts = [b"one two one", b"two three four", b"", b"one"]
    of = np.array([0, 0, 1, 1])
    right = sorted(zip(*(x.tolist() if hasattr(x, "tolist") else x for x in divergence.term_groups(texts, of))))
    monkeypatch.setattr(divergence, "slice_hashes", lambda raw, first, last: np.zeros(len(first), np.uint64))
    assert sorted(zip(*(x.tolist() if hasattr(x, "tolist") else x for x in divergence.term_groups(texts, of)))) == right
    raw = np.frombuffer(b"abcdefghijk abcdefghijk abcdefghijX" + b" " * 9, np.uint8)
    assert divergence.same_bytes(raw, np.array([0, 0, 0]), np.array([12, 24, 24]), np.array([11, 11, 10])).tolist() == [True, False, True]


def test_shares_of_large_counts(spark):
    cases = [(0, 5, 1), (7, 10**15, 40), (8 * 10**15, 8 * 10**15 + 3, 10), (123456789012, 999999999999, 3)]
    want = [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in cases]
    assert divergence.share(np.array([n for n, _, _ in cases]), np.array([t + 5 * v for _, t, v in cases])).tolist() == want
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases, "n long, t long, v long").select("n", divergence.share_column(F.col("n"), F.col("t"), F.col("v")).alias("p"))
    assert {r.n: r.p for r in df.collect()} == dict(zip([c[0] for c in cases], want))


# operator 13


def brute_variants(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        by = sorted((-n[x], x) for x in n if near(w, x))
        form = by[0][1] if by and -by[0][0] >= 5 * n[w] else None
        out[w] = [form, None, n[w], len(by), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def test_variants(docs, none):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}
    want = brute_variants([r[:2] for r in ROWS])
    assert got == want
    assert sum(x[0] is not None for x in want.values()) > 10
    assert spelling.spelling_variants(none).count() == 0


def test_chains_of_forms(spark):
    # each word's form is the next one; exchanged neighbours aren't near
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "bacdef": 5, "abcdefg": 5, "abcdex": 25}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_variants(rows)
    assert got["abcdef"][:2] == ("abcdeg", "abjihg")  # of equal counts the smaller form
    assert got["bacdef"][:2] == (None, "bacdef")


# operator 11

PLAIN = "the house of a river and some green hills where people live by many roads near old towns".split()
NAMES = ["women", "men", "muslim", "christian"]


def sentence(bad, name):
    words = [R.choice(PLAIN) for _ in range(20)]
    words += [R.choice(("vilexo", "vilera", "grumpol"))] * bad + [name] * bool(name)
    R.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def marked(spark):
    """Toxic words mark the toxic texts; one identity term stands mostly in toxic texts, its counterpart in others."""
    data, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        name = ("women" if R.random() < 0.6 else "") if bad else ("women" if R.random() < 0.03 else "men" if R.random() < 0.5 else "")
        # some toxic texts have no toxic word, so that the term is of use for the plain fit
        data.append((i, sentence(bad and R.random() < 0.7, name)))
        labels.append((i, 1, int(bad)))
    data += [(5000, None), (5001, ""), (None, "vilexo"), (5002, sentence(True, "") * 300), (5003, sentence(False, ""))] + [data[8]] * 2
    return spark.createDataFrame([(*r, "x", 0.5) for r in data], "doc_id long, text string, lang string, score double").repartition(3).cache(), spark.createDataFrame([*labels, (8, 0, 0), (None, 1, 1), (5003, 1, None)], "doc_id long, quality int, toxic int").cache()


def test_toxicity(marked, none):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    by = {r.doc_id: r for r in out}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    with_word = [r for r in held if re.search("vile|grumpol", texts[r.doc_id])]
    assert len(with_word) > 20 and all(r.predicted for r in with_word)
    assert not any(r.predicted for r in held if r.doc_id % 4)
    assert by[5002].predicted == 1 and by[None].predicted == 1 and by[5000].score == by[5001].score and by[5000].predicted == 0
    assert len([r for r in out if r.doc_id == 8]) == 3
    assert toxicity.scored(none, model).count() == 0
    empty = toxicity.fit(none, labels)
    assert not any(r.predicted for r in toxicity.scored(docs, empty).collect())


def test_swaps_keep_the_score(marked):
    docs, labels = marked
    pair = [f"{n} live near some green hills" for n in ("women", "men")]

    def gap(model):
        columns = toxicity.Columns(model.hashes)
        a, b = model.scores([x.encode() for x in pair], columns)
        return abs(a - b)

    plain, fair = toxicity.fit(docs, labels, counterfactual=0.0), toxicity.fit(docs, labels)
    assert fair.pairs > 500
    assert gap(plain) > 0.05 and gap(fair) < gap(plain) / 5


def test_held_out_labels_are_not_read(marked):
    docs, labels = marked
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.hashes.tolist() == b.hashes.tolist() and a.weights.tolist() == b.weights.tolist() and a.shift == b.shift


# operator 10, markup


def brute_tokens(page):
    """Text and tags of a page, a character at a time; raw elements aren't taken out."""
    out, text, i = [], "", 0
    loose = False
    while i < len(page):
        rest = page[i:]
        name = re.match(r"</?[a-zA-Z]", rest)
        if page[i] != "<" or ">" not in rest or not (name or rest.startswith(("<!", "<?", "</"))):
            text, i = text + page[i], i + 1
            continue
        if rest.startswith("<!--"):
            end = rest.find("-->", 2)
            end = len(rest) if end < 0 else end + 3
        else:
            quote, end, k = "", 0, 1
            while name and not loose and k < len(rest):
                c = rest[k]
                if quote:
                    quote = "" if c == quote else quote
                elif c in "\"'" and k >= len(re.match(r"</?[a-zA-Z][a-zA-Z0-9:-]*", rest)[0]):
                    quote = c
                elif c == ">":
                    end = k + 1
                    break
                k += 1
            if not end:
                loose = loose or bool(name)
                end = rest.index(">") + 1
        tag = re.match(r"</?([a-zA-Z][a-zA-Z0-9:-]*)", rest)
        out.append((text, tag[1].lower() if tag else "", bool(tag) and rest[1] == "/"))
        text, i = "", i + end
    return [*out, (text, "", False)]


def test_markup_by_characters():
    r = random.Random(10)
    pieces = ["<p>", "</p>", "<a href='x>y'>", '<b title="', '"', "'", "<", ">", "text", " a=b ", "<!-- c -->", "<!--", "-->", "<!doctype html>", "</", "/>", "<br/>", "1 < 2", "<?x?>", "<i"]
    for _ in range(4000):
        page = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert [(t, g, e) for t, g, e, _, _ in html.tokens(page)] == brute_tokens(page), page


def test_attributes_are_read_by_name():
    text = lambda inside: html.content_of(html.lines(f"<article><p>Story.</p>{inside}</article>"))
    for inside in (
        '<div style="overflow:hidden">Kept.</div>', '<div data-hidden="false">Kept.</div>', '<p title="the hidden truth">Kept.</p>', '<a href="/hidden/valley">Kept.</a>', '<p data-class="ads">Kept.</p>', "<p aria-hidden=false>Kept.</p>",
        '<p class="comment-on-policy">Kept.</p>', '<p class="related-work">Kept.</p>', '<p class="commentary">Kept.</p>', '<p class="ad-hoc">Kept.</p>', '<div class="content-with-sidebar">Kept.</div>', "<svg/>Kept.", '<p class="x" class="ads">Kept.</p>', '<p data-x="a>b">Kept.</p>',
    ):
        assert text(inside) == "Story. Kept.", inside
    for inside in (
        "<p hidden>x</p>", '<p HIDDEN="">x</p>', '<div aria-hidden="true">x</div>', '<div style="color:red; display: none">x</div>', '<div class="user-comments-list">x</div>', "<ol class=commentlist>x</ol>", '<div class="article-comments-section">x</div>',
        '<div class="post-share-tools">x</div>', '<ins class="adsbygoogle">x</ins>', '<div class="sidebarLeft">x</div>', "<div id=cookieBanner>x</div>", '<div class="related-posts">x</div>', '<p id="a"class="ads">x</p>', "<div class=comment-17>x</div>",
    ):
        assert text(inside) == "Story.", inside


def test_pages_take_linear_time():
    n = 20_000
    pages = ["<b>" * n + "</i>" * n, '<a "' * n, "<div " * n, "<a '" * (n + 1) + ">", '<a ">" ' * n, "<script>" + "</script " * n, "<div>" * n + "</div>" * n, "<div>" * n + "</p>" * n, "<!--" * n, "<" * n + ">", "</" * n + ">", "<p " + "a=b " * n + ">", "<p " + "=" * n + ">", "<p " + "/ " * n + ">"]
    for page in pages:
        began = time.process_time()
        html.lines(page)
        assert time.process_time() - began < 2, page[:30]
