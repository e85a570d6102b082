"""Periodic runs, main texts of pages and ranked search against brute force, planted cases and awkward rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textledger.llm import periodic, ranked, templates
from textledger.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_of(words, least=12):
    """All runs, period by period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def planted_words(doc_id, text):
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def digest_row(words):
    runs = runs_of(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def test_runs_of_random_shards():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            letters = rng.choice([1, 2, 3, 5, 40])
            t = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(90))]
            while t and rng.random() < 0.6:
                piece = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
                at = rng.randrange(len(t))
                t[at:at] = [piece[k % len(piece)] for k in range(rng.randrange(5, 60))]
            texts.append(t)
        offsets, found, collapsed = periodic.collapse(texts)
        for k, t in enumerate(texts):
            want = runs_of(t)
            assert [tuple(map(int, x)) for x in found[:, offsets[k] : offsets[k + 1]].T] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert collapsed[k] == b" ".join(w for i, w in enumerate(t) if i not in gone)


def test_runs_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert set(got) == set(docs)
    asked = [i for i, t in docs.items() if len(t or "") < 8000]
    assert len(asked) > 150 and sum(got[i][0] > 0 for i in asked) > 10
    for i in asked:
        assert got[i] == digest_row(planted_words(i, docs[i]))


def test_runs_of_awkward_rows(spark):
    long = [f"w{k % 977}" for k in range(60_000)]
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x" * 3), (5, "  a b " * 20), (6, "y " * 5000), (7, " ".join(long)), (1, "z\x0b" * 30), (8, "c d e f " * 3), (8, "c d e f " * 3)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, runs string")
    got = periodic.periodic_runs(docs).collect()
    want = sorted((str(i), len(WORD.findall(t or "")), str(runs_of(WORD.findall(t or "")) if len(t or "") < 20_000 else [(0, 60_000, 977)])) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs])) for r in got) == want
    assert next(r for r in got if r.doc_id == 7).collapsed == " ".join(long[:977])
    assert next(r for r in got if r.doc_id is None).collapsed == "a b"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


SITE = """<!DOCTYPE html><html><head><title>t{k}</title><style>p{{}}</style></head><body class="has-sidebar"><header>Site name</header><div id="cookieNotice">We use cookies {k}</div>
<nav><ul><li><a href="/{k}">menu {k}</a><li><a href=x>other</a></ul></nav><main><article class="post"><header><h1>Title {k} &amp; more</h1></header><p>First <b>pa</b>ra&shy;graph{k}&nbsp;&#8212; x &lt; y.
<p>Second<br>line {k}<div class="ad-box">buy {k}</div><ul><li>one {k}<li>two {k}</ul><form><p>Join<input></form><p>Share this page with all your friends</p><script>var a="</p><p>no";</script>
<section class="comments"><article class="comment"><p>nice {k}</p></article></section></article></main><aside><p>side {k}</p></aside><footer><p>&copy; {k}</p></footer></body></html>"""


def want_text(k, shared=True):
    more = " Share this page with all your friends" if shared else ""
    return f"Title {k} & more First para­graph{k} — x < y. Second line {k} one {k} two {k}{more}"


def test_main_texts_of_a_site(spark):
    """What stands on every page in the article, too, is template; on hosts with few pages it can't be known."""
    rows = [(k, f"https://Big.example/p/{k}", SITE.format(k=k)) for k in range(12)] + [(100 + k, f"http://small.example:80/{k}", SITE.format(k=k)) for k in range(2)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r.text for r in templates.main_texts(pages).collect()}
    assert got == {k: want_text(k, False) for k in range(12)} | {100 + k: want_text(k) for k in range(2)}


def test_main_texts_without_an_article(spark):
    """Menus that are no marked element are told by their links, notices by standing on each page."""
    body = "<div class=c{k}><div><p><a href=1>home page</a> <a href=2>all about us</a></p></div><div><p>Welcome to the site of all sites</p></div><table><tr><td>Text {k} of the page<td>goes on {k}</table></div>"
    pages = spark.createDataFrame([(k, "http://h.example/", body.format(k=k).replace(f"c{k}", "c")) for k in range(6)], "page_id long, url string, html string")
    assert {r.text for r in templates.main_texts(pages).collect()} == {f"Text {k} of the page goes on {k}" for k in range(6)}


def test_copies_keep_their_text(spark):
    """Pages that are copies of each other, or of one article, aren't taken for a template."""
    rows = [(k, "http://h.example/", SITE.format(k=1)) for k in range(9)] + [(20 + k, "http://i.example/", SITE.format(k=1).replace("/1", f"/{k}")) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in templates.main_texts(pages).collect()} == {want_text(1)}


def test_main_texts_of_awkward_pages(spark):
    rows = [
        (1, None, "<p>no url</p>", "no url"), (None, "u", None, ""), (2, "u", "", ""), (3, "u", "no markup &amp; 1 < 2", "no markup & 1 < 2"), (3, "u", "no markup &amp; 1 < 2", "no markup & 1 < 2"), (4, "http://x.y", "<article>a<!-- gone", "a"),
        (5, "http://x.y", "<script>all gone", ""), (6, "http://x.y", "<nav>only menu</nav>", ""), (7, "http://x.y", "<p>" + "word " * 50_000, ("word " * 50_000).strip()), (8, "http://x.y", "<div>" * 3000 + "deep", "deep"),
        (9, "http://x.y", '<a "' * 3000, None), (10, "http://x.y", "<p title='a>b'>q</p></div></p>r", "q r"),
    ]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text) for r in templates.main_texts(pages).collect())
    assert [(i, t) for i, t in got if i != "9"] == sorted((str(r[0]), r[3]) for r in rows if r[0] != 9)
    assert templates.main_texts(pages.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    import html

    pages = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    for r in templates.op12_main_text(spark, SF).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?b>", "", x)) for x in re.split(r"</?p>|<br>|</?h1>", inner))
        assert r.text == " ".join(text.split()) and r.n_chars == len(r.text)


def test_shared_terms_are_sums():
    """What lists are made of stays the same, and pairs that stood in several lists are in them once."""
    rng = random.Random(2)
    for _ in range(50):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(12)]
        made = [list(x) for x in lists]
        parts = {node: (a, b) for node, a, b in ranked.shared_terms(made, 40)}
        flat = lambda n: [n] if n < 40 else flat(parts[n][0]) + flat(parts[n][1])
        assert [[y for n in x for y in flat(n)] for x in made] == lists
        pairs = [p for x in made for p in zip(x, x[1:])]
        assert len(pairs) == len(set(pairs))


@pytest.mark.parametrize("block_bytes", [60, 1 << 22])
def test_ranked_search_against_plain_scores(spark, block_bytes):
    """Blocks, copies of items, repeated terms, ties and ids that repeat or lack."""
    import math

    rng = random.Random(8)
    word = lambda: f"w{min(rng.randrange(30), rng.randrange(30))}"
    docs = [(rng.choice([None, k // 2, k]), " ".join(word() for _ in range(rng.randrange(0, 40)))) for k in range(120)] + [(500, None), (501, "..."), (502, "W1 w1-W2,w3é")]
    items = [(k % 9 or None, " ".join(word() for _ in range(rng.randrange(0, 12)))) for k in range(20)] + [(50, None), (51, "unseen"), (52, "W1 w1 w1"), (53, "w1 W1_w1")]
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {t: sum(t in w for _, w in held) for _, w in held for t in w}
    want = []
    for item, text in items:
        scores = []
        for i, w in held:
            m = 25 + 75 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if t in w)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        want += [(str(item), r, str(i), -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:10], 1)]
    frames = [spark.createDataFrame([(*x, 1) for x in rows], f"{name} long, text string, rank int").repartition(3) for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = [(str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in ranked.ranked_search(*frames, block_bytes=block_bytes).collect()]
    assert sorted(got) == sorted(want)
    for k in (0, 1):
        assert ranked.ranked_search(*[f.limit(0) if j == k else f for j, f in enumerate(frames)]).select(F.lit(1)).count() == 0
