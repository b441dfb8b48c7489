import random
import time

import numpy as np

from tidewire.llm import html as H
from tidewire.llm import langid as L

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head&amp;</h1></header><p><b>Lead   text<br>more &eacute;&#8364;<p>Second <i>in</i>line</p><aside>Side</aside><form><p>Sign up</p></form><div id="share-buttons">Share</div><ul><li>One</li><li>Two</li></ul><noscript>no</noscript>
<p hidden>gone</p></article><section class="comments"><article><p>A reader says</p></article></section><footer>&copy; x</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string")


def test_article_page(spark):
    rows = [("http://a.b/1", PAGE), ("http://a.b/1", PAGE), (None, None), ("http://a.b/2", ""), ("x", "just text &lt;b&gt;"), ("http://c.d/", "<p>cut off <b>here <p")]
    got = {r.page_id: (r.text, r.n_chars) for r in H.op9_html(pages(spark, rows)).collect()}
    want = "Head&\nLead text more é€\nSecond inline\nOne\nTwo"
    assert got == {0: (want, len(want)), 1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("just text <b>", 13), 5: ("cut off here", 12)}
    assert H.op9_html(pages(spark, rows).limit(0)).count() == 0


def test_repeats_of_a_host_go_where_there_is_no_article(spark):
    rng = random.Random(3)
    body = lambda: " ".join(f"word{rng.randrange(9999)}" for _ in range(30))
    own = [body() for _ in range(8)]
    rows = [(f"https://host.example/{i}", f"<body><div>Welcome to our great site today</div><p>{own[i]}</p><div>All rights belong to someone here</div></body>") for i in range(8)]
    rows += [("https://other.example/", "<body><div>Welcome to our great site today</div><p>alone</p></body>"), ("https://host.example/copy", rows[0][1]), ("https://mirror.example/1", f"<article><p>{own[0]}</p></article>"), ("https://mirror.example/2", f"<article><p>{own[0]}</p></article>")]
    got = {r.page_id: r.text for r in H.op9_html(pages(spark, rows)).collect()}
    assert [got[i] for i in range(1, 8)] == own[1:]
    assert got[8] == "Welcome to our great site today\nalone"  # another host doesn't count
    assert own[0] in got[0] and got[0] == got[9]  # nothing of a copied page is its own, so it keeps its text
    assert got[10] == got[11] == own[0]


def test_class_names_are_a_prior_only():
    of = lambda page: [t for k, t in H._main_role(page, H.blocks(page)) if k != H.CHROME]
    assert of('<article><div class="comment-free notice-board">Story of the day</div></article>') == ["Story of the day"]
    assert of('<main><div class="replies-enabled article-body">' + "text " * 200 + '</div><p>By me</p></main>') == [("text " * 200).strip(), "By me"]
    long_talk = '<section class="comments"><p>' + "a reader says much " * 90 + "</p></section>"
    story = " ".join(f"w{i}" for i in range(100))
    assert of(f"<article><p>{story}</p></article>{long_talk}") == [story]
    assert of("if x <y then stop here and the rest of it") == ["if x <y then stop here and the rest of it"]
    assert of("a < b <! c and so on") == ["a < b <! c and so on"]
    assert of('<p>one</p><a href="x') == ["one"] and of('<p title="odd>two</p>') == ["two"]


def plain_covered(streams: list[list[int]], need: int, least: int) -> list[list[bool]]:
    """Places in runs of least tokens that stand on need or more pages, by counting every run."""
    on: dict[tuple, set] = {}
    for i, x in enumerate(streams):
        for j in range(len(x) - least + 1):
            on.setdefault(tuple(x[j : j + least]), set()).add(i)
    out = []
    for x in streams:
        hit = [False] * len(x)
        for j in range(len(x) - least + 1):
            if len(on[tuple(x[j : j + least])]) >= need:
                hit[j : j + least] = [True] * least
        out.append(hit)
    return out


def test_comments_and_class_names():
    of = lambda page: [t for k, t in H._main_role(page, H.blocks(page)) if k != H.CHROME]
    short = "<article><p>" + "word " * 10 + "</p></article>"
    assert of(f'{short}<section id="comments" class="comments">' + "<p>a reader says much</p>" * 30 + "</section>") == [("word " * 10).strip()]
    halves = of("<article><p>" + "one " * 60 + '</p><div class="promotion-law-history">' + "two " * 60 + "</div></article>")
    assert halves == [("one " * 60).strip(), ("two " * 60).strip()]
    for name in ("ad-slot", "comment-list", "cookie-notice", "share-buttons", "widget_recent_entries", "site-footer"):
        assert of(f'<div>{"text " * 30}</div><div class="{name}">not this</div>') == [("text " * 30).strip()], name


def test_scanning_is_linear():
    began = time.process_time()
    n = 40_000
    for page in ('<a "' * n, "<div>" * n + "</b>" * n, "<a " * n, "<a " * n + '"', "<!" * n, "<span class=ad>" * n + "<div>" * n, "<a '\"" * n, '<div class="ad">x' * n):
        H.blocks(page)
    assert time.process_time() - began < 20  # a quadratic scan takes minutes for each


def test_a_hosts_size_changes_no_text(spark):
    """Two pages with a common line lose it whatever else the host holds, and however its pages are dealt."""
    rng = random.Random(5)
    body = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    line = " ".join(f"common{i}" for i in range(12))
    rows = [("http://h/1", f"<p>{line}</p><p>{body(7)}</p>"), ("http://h/2", f"<p>{line}</p><p>{body(7)}</p>")]
    rows += [(f"http://h/a{i}", f"<article><p>{line} and more</p><p>{body(40)}</p></article>") for i in range(14)] + [(f"http://h/b{i}", f"<article><p>{body(40)}</p></article>") for i in range(6)]
    rows += [("http://h/3", rows[0][1]), ("http://h/4", rows[5][1].upper())] + [(f"http://small/{i}", f"<p>{body(9)}</p>") for i in range(3)]
    df = pages(spark, rows)
    small = {r.page_id: r.text for r in H.main_text(df).collect()}
    assert len(small[0].split()) == len(small[1].split()) == 7 and all("common" not in small[i] for i in range(2, 16))
    for size in (200, 700, 3000):
        assert {r.page_id: r.text for r in H.main_text(df, part_bytes=size).collect()} == small


def test_suffix_array_and_cover_against_plain_versions():
    rng = random.Random(8)
    for _ in range(60):
        passage = [rng.randrange(9) for _ in range(12)]
        streams = [[rng.randrange(rng.choice([2, 30])) for _ in range(rng.randrange(0, 40))] + (passage if rng.random() < 0.5 else []) for _ in range(rng.randrange(1, 7))]
        flat = np.array([t for x in streams for t in x], np.int64)
        sizes = np.array([len(x) for x in streams])
        end, page = np.repeat(sizes.cumsum(), sizes), np.repeat(np.arange(len(streams)), sizes)
        order, lcp = H.suffix_array(flat, end)
        suffix = [flat[i : end[i]].tolist() for i in order.tolist()]
        assert suffix == sorted(suffix)
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp.tolist() == [shared(a, b) for a, b in zip(suffix, suffix[1:])]
        for need, least in ((2, 3), (3, 6)):
            want = [x for hit in plain_covered(streams, need, least) for x in hit]
            assert [x.tolist() for x in H.covered(flat, page, end, [need], least)] == [want]


def plain_main(pages: list[str], least: int) -> list[str]:
    found = [[x for x in H._main_role(p, H.blocks(p)) if x[0] != H.CHROME] for p in pages]
    streams = [[0] + [t for _, text in f for t in [*text.lower().split(), 0]] for f in found]
    once = [list(x) for x in dict.fromkeys(map(tuple, streams))]
    half = max(H.ARTICLE_PAGES, -(-len(once) // 2))
    hits = {need: dict(zip(map(tuple, once), plain_covered(once, need, least))) for need in (H.OPEN_PAGES, half)}
    out = []
    for f, x in zip(found, streams):
        at, kept, lost, total = 1, [], 0, 0
        for kind, text in f:
            words = text.split()
            hit = hits[H.OPEN_PAGES if kind == H.OPEN else half][tuple(x)][at : at + len(words)]
            if kind == H.OPEN:
                kept.append(" ".join(w for w, h in zip(words, hit) if not h))
            else:
                kept.append("" if all(hit) else text)
                lost, total = lost + len(words) * all(hit), total + len(words)
            at += len(words) + 1
        kept = [t for t in kept if t]
        out.append("\n".join(kept if kept and 2 * lost <= total else [t for _, t in f]))
    return out


def test_random_hosts_against_a_plain_version(spark):
    """Open blocks and articles with passages that pages share; the suffix array changes what is kept."""
    rng = random.Random(11)
    said = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows, removed = [], 0
    for h in range(6):
        shared = [said(rng.randrange(1, 12)) for _ in range(6)]
        for k in range(rng.choice([1, 4, 12])):
            parts = [f"<p>{said(rng.randrange(3, 30))}</p>" for _ in range(4)] + [f"<p>{said(2)} {x}</p>" if rng.random() < 0.3 else f"<p>{x}</p>" for x in shared if rng.random() < 0.7]
            rng.shuffle(parts)
            body = "".join(parts)
            rows.append((f"http://h{h}.example/{k}", f"<body>{body}</body>" if h % 2 else f"<nav>menu</nav><article>{body}</article>"))
    rows += rows[3:6]
    got = {r.page_id: r.text for r in H.op9_html(pages(spark, rows)).collect()}
    for h in range(6):
        ids = [i for i, (u, _) in enumerate(rows) if u.startswith(f"http://h{h}.")]
        assert [got[i] for i in ids] == plain_main([rows[i][1] for i in ids], H.LEAST)
    off = {r.page_id: r.text for r in H.main_text(pages(spark, rows), least=10**6).collect()}
    changed = [len(rows) > i and "article" in rows[i][1] for i in got if got[i] != off[i]]
    assert any(changed) and not all(changed)


def test_a_large_host_is_dealt_into_parts(spark):
    """Repeats count within a part; what most pages share goes in every part, and equal pages meet."""
    rng = random.Random(12)
    own = [" ".join(f"u{i}_{rng.randrange(9999)}" for _ in range(30)) for i in range(60)]
    rows = [(None if i % 2 else "https://big.example/x", f"<div>Welcome to our great site today</div><p>{t}</p>") for i, t in enumerate(own)]
    got = {r.page_id: r.text for r in H.main_text(pages(spark, rows), part_bytes=3000).collect()}
    assert [got[i] for i in range(60)] == own
    words = " ".join(f"long{i}" for i in range(100_000))  # a very long page
    (r,) = H.op9_html(pages(spark, [("http://l.example/", f"<p>{words}</p>")])).collect()
    assert r.text == words


SEEDS = {"en": "the of and that with for was this from have which", "de": "der die und nicht mit ein auf für sich über ist", "fr": "le la les des est que pour dans une avec qui", "es": "el los las del que por una con para más está"}


def corpus(spark, n=160):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(SEEDS[k].split()) for _ in range(rng.choice([8, 40]))), k, "s") for i in range(n) for k in [list(SEEDS)[i % 4]]]
    rows += [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "12 34 !!", "fr", "s"), (1003, "der und nicht über", None, "s"), (None, "les des que pour", "fr", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    df = corpus(spark)
    got = L.op10_langid(df).collect()
    truth = {r.doc_id: r.lang for r in df.collect()}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(got) == 165 and len(held) > 20
    assert all(r.lang_pred == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[1003] == "de" and by[None] == "fr"


def test_labels_of_held_out_rows_dont_matter(spark):
    from pyspark.sql import functions as F

    df = corpus(spark).where("doc_id is not null")
    swapped = df.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "en").otherwise(F.col("lang")))
    assert sorted(map(tuple, L.op10_langid(df).collect())) == sorted(map(tuple, L.op10_langid(swapped).collect()))


def test_no_labels(spark):
    df = corpus(spark).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert {r.lang_pred for r in L.op10_langid(df).collect()} == {"und"}
    assert L.op10_langid(df.limit(0)).count() == 0
