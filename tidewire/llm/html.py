"""Main text of web pages: structure as a prior, then a suffix array of each host's token streams.

A page becomes a stream of text blocks, each marked as chrome (menus, headers, footers, adverts, ... by tag, role or
class), as part of an article, or as open. The streams of a host's pages, words and block bounds, are concatenated and their
suffixes sorted; neighbours with a common prefix of LEAST tokens or more on distinct pages show what the host repeats. The union of these spans
is boilerplate: in open blocks where two pages share it, in articles only where most pages of the host do and a whole block is
covered, since articles are quoted and mirrored. What is not covered, the page's unique runs, stays.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, slices, staged

CHROME, ARTICLE, OPEN = 0, 1, 2
#: Tokens (words and block bounds) that a repeat needs; distinct pages that share it, in open blocks and in articles; share of the host's pages in articles.
LEAST, OPEN_PAGES, ARTICLE_PAGES, ARTICLE_SHARE = 6, 2, 3, 0.5
#: Bytes of html whose streams one suffix array holds: the pages of a larger host are dealt into parts by hash.
PART_BYTES = 1 << 20
#: Large hosts that are broadcast, at most.
FEW_HOSTS = 100_000
#: Words outside an element, or share of its own, up to which its class names can't make it chrome.
FEW_WORDS, FEW_SHARE = 20, 0.05

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp".split())
DROPPED = frozenset("nav footer aside form button select option label fieldset menu dialog svg canvas object audio video head datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
PARAGRAPH_ENDS = BLOCK - {"html", "body"}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset(
    """ad ads adv advert adverts alert alerts advertisement advertisements advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies disclaimer disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification
    overlay pager pagination paywall popup promo promotion promotions recommended related replies reply respond share sharing sidebar signup social sponsor sponsored
    subscribe subscription syndication toolbar widget widgets""".split()
)
DROPPED_NAMES = frozenset("header site-header page-header top-header global-header side-bar skip-link skip".split())
#: Words of a class name that say what kind of box it is, not what it holds.
BOX_WORDS = frozenset(
    """area article articles author avatar bar block body bottom box btn button buttons card cards center closed col column container content count date desktop entries entry fixed form group head
    heading holder icon icons id image inline inner input item items large left level link links list lists main media message meta mobile module more narrow open outer panel popular post
    posts primary read recent right row section sections secondary site slot small spacer stories story tag tags text thread time title top tree unit user wide wrap wrapper zone""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())

INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup td th time tt u var".split())

_KNOWN = "|".join(sorted(VOID | RAW | DROPPED | BLOCK | INLINE))
#: What may open a comment, a CDATA section, a declaration or a tag; any other < is text. A known tag may be cut off by the end.
_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))", re.I)
_CUT_OFF = re.compile(rf"</?(?:{_KNOWN})(?:\s+[-\w:.]+\s*=[^>]*)?\s*/?\Z", re.I)
_SPECIAL = re.compile("[>\"']")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _drops(tag: str, attrs: str, in_article: bool) -> int:
    """2: never main text, by its tag, role or being hidden. 1: not by its class or id, a prior; -1: as that of comments. 0: nothing against it."""
    if tag in DROPPED or tag == "header" and not in_article:
        return 2
    if tag in ("html", "body", "main") or not attrs:
        return 0
    got = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTR.findall(attrs)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower():
        return 2
    if got.get("role", "").lower() in DROPPED_ROLES:
        return 2
    names = f"{got.get('class', '')} {got.get('id', '')}".lower().split()
    against = int(any(n in DROPPED_NAMES for n in names) and not (tag == "header" and in_article))
    for name in names:
        parts = [p for p in _SPLIT.split(name) if p and not p.isdigit()]
        # a part counts only in a name that says nothing else: 'comment-list', not 'comment-culture'
        if not DROPPED_WORDS.isdisjoint(parts) and all(p in DROPPED_WORDS or p in BOX_WORDS for p in parts):
            against = max(against, 1 if COMMENT_WORDS.isdisjoint(parts) else -1, key=abs)
            if not COMMENT_WORDS.isdisjoint(parts):
                return -1
    return against


class _Ends:
    """Where tags end: at the first > outside quotes, or at the first > if a quote is never closed. Each place is looked at a bounded number of times, whatever the page."""

    def __init__(self, page: str):
        self.page = page
        self.special = (0, -1)  # from here up to there no place is special but the last one
        self.gt = (0, -1)
        self.after_quote: dict[int, int] = {}  # where the tag ends that has this quote outside other quotes; -1 if nowhere

    def _next(self, at: int) -> int:
        first, found = self.special
        if not first <= at <= found:
            m = _SPECIAL.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.special = (at, found)
        return found

    def first_gt(self, at: int) -> int:
        first, found = self.gt
        if not first <= at <= found:
            found = self.page.find(">", at)
            found = len(self.page) if found < 0 else found
            self.gt = (at, found)
        return found if found < len(self.page) else -1

    def of(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at this place; -1 if none does."""
        start, passed = at, []
        while True:
            here = self._next(at)
            if here == len(self.page):
                end = -1
            elif self.page[here] == ">":
                end = here
            elif here in self.after_quote:
                end = self.after_quote[here]
            else:
                passed.append(here)
                close = self.page.find(self.page[here], here + 1)
                if close >= 0:
                    at = close + 1
                    continue
                end = -1
            break
        for quote in passed:
            self.after_quote[quote] = end
        return end if end >= 0 else self.first_gt(start)


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, in page order. Unclosed and stray tags do no harm; a < that opens no tag is text.

    Class names make an element chrome unless hardly any of the page's other text is outside of it; names of comments do so wherever text that nothing speaks against stands
    before it. The work grows with the page's length.
    """
    out: list[tuple[bool, int, bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, what is against it, whether it is an article
    soft: list[int] = []  # numbers of the open elements that class names speak against
    above = [0]  # for each of them the one around it; 0 is none
    talk: set[int] = set()  # those of them that are named comments
    held: dict[str, int] = {}  # open tags by name
    dropped = article = doubted = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((dropped > 0, soft[-1] if soft else 0, article > 0, joined))

    def leave(to: int) -> None:
        nonlocal dropped, article
        while len(stack) > to:
            name, against, art = stack.pop()
            held[name] -= 1
            dropped -= against == 2
            article -= art
            if against in (1, -1):
                soft.pop()

    at, n, ends = 0, len(page), _Ends(page)
    while at < n:
        m = _OPEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        comment, section, other, slash, tag = m.groups()
        if comment or section:
            end = page.find("-->" if comment else "]]>", m.end())
            stop = n if end < 0 else end + 3
        else:
            end = ends.first_gt(m.end()) if other else ends.of(m.end())
            stop = end + 1
            if end < 0:
                if other or not _CUT_OFF.match(page, m.start()):
                    text.append(page[at : m.end()])
                    at = m.end()
                    continue
                stop = n
        if m.start() > at:
            text.append(page[at : m.start()])
        at = stop
        if tag is None or end < 0:
            continue
        tag, rest = tag.lower(), page[m.end() : end]
        if slash:
            if tag in BLOCK:
                flush()
            for i in () if not held.get(tag) else range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(x[1] for x in stack[i:]):
                        flush()
                    leave(i)
                    break
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            if tag in PARAGRAPH_ENDS and held.get("p"):  # an open paragraph ends here
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        leave(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
        elif tag in ("br", "td", "th", "img"):
            text.append(" ")
        if tag in VOID or rest.endswith("/"):
            continue
        against = _drops(tag, rest, article > 0)
        art = tag == "article" and against != 2
        if against:
            flush()
        if tag in BLOCK or against:
            stack.append((tag, against, art))
            held[tag] = held.get(tag, 0) + 1
            dropped += against == 2
            article += art
            if against in (1, -1):
                doubted += 1
                above.append(soft[-1] if soft else 0)
                soft.append(doubted)
                if against < 0:
                    talk.add(doubted)
    flush()
    words = [len(t.split()) for *_, t in out]
    whole = sum(w for (hard, *_), w in zip(out, words) if not hard)
    plain = next((i for i, (hard, doubt, *_) in enumerate(out) if not hard and not doubt), len(out))
    inside, first = [0] * (doubted + 1), [len(out)] * (doubted + 1)
    for i, ((hard, doubt, *_), w) in enumerate(zip(out, words)):
        if not hard:
            inside[doubt] += w
            first[doubt] = min(first[doubt], i)
    for x in range(doubted, 0, -1):  # an element comes after the one around it
        inside[above[x]] += inside[x]
        first[above[x]] = min(first[above[x]], first[x])
    chrome = [False] * (doubted + 1)
    for x in range(1, doubted + 1):
        w = inside[x]
        chrome[x] = chrome[above[x]] or x in talk and plain < first[x] or not (2 * w > whole and whole - w <= max(FEW_WORDS, FEW_SHARE * w))
    return [(CHROME if hard or chrome[doubt] else ARTICLE if art else OPEN, t) for hard, doubt, art, t in out]


def _main_role(page: str, found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Where a page has article blocks, open blocks outside them are not its main text."""
    if any(k == ARTICLE for k, _ in found):
        return [(CHROME if k == OPEN else k, t) for k, t in found]
    return found


def host_of(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def suffix_array(tokens: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the places of the sorted suffixes, and the tokens that each shares with the next one in order.

    A suffix ends at end, where its page does. Prefix doubling: the numbers of all prefixes of 1, 2, 4, ... tokens, until no more
    suffixes part; the same numbers give the common prefixes.
    """
    n = len(tokens)
    at = np.arange(n)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while n:
        rank, k = levels[-1], 1 << (len(levels) - 1)
        second = np.where(at + k < end, rank[np.minimum(at + k, n - 1)] + 1, 0)
        new = np.unique(rank * (n + 1) + second, return_inverse=True)[1]
        if new.max() == rank.max():
            break
        levels.append(new)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        # a number at this level stands for 2 ** level tokens only if so many are left
        ok = (x + (1 << level) <= end[a]) & (y + (1 << level) <= end[b])
        same = ok & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        lcp += np.where(same, 1 << level, 0)
    if n:  # suffixes that never part are equal to their ends
        lcp = np.where(levels[-1][order[:-1]] == levels[-1][order[1:]], end[order[:-1]] - order[:-1], lcp)
    return order, lcp


def covered(tokens: np.ndarray, page: np.ndarray, end: np.ndarray, needs: list[int], least: int = LEAST) -> list[np.ndarray]:
    """For each of needs: which places lie in a run of least or more tokens that stands on so many distinct pages. page: the page of each place.

    Suffixes with a common prefix of least tokens are an interval of the array. A longer repeat is covered by the intervals of all the places in
    it, so the union of their first least tokens is the union of all repeats.
    """
    n = len(tokens)
    order, lcp = suffix_array(tokens, end)
    if not (lcp >= least).any():
        return [np.zeros(n, bool) for _ in needs]
    interval = np.concatenate([[0], (lcp < least).cumsum()])
    on = np.unique(interval * (int(page.max()) + 1) + page[order]) // (int(page.max()) + 1)
    pages = np.empty(n, np.int64)
    pages[order] = np.bincount(on, minlength=n)[interval]
    whole = np.arange(n) + least <= end
    out = []
    for need in needs:
        at = np.flatnonzero((pages >= need) & whole)
        delta = np.zeros(n + 1, np.int64)
        delta[at] += 1
        delta[at + least] -= 1
        out.append(delta.cumsum()[:-1] > 0)
    return out


def _stream(found: list[tuple[int, str]], number) -> list[int]:
    """A page's words as numbers, block bounds as 0."""
    stream = [0]
    for _, t in found:
        stream.extend(map(number, t.lower().split()))
        stream.append(0)
    return stream


def window_hashes(tokens: np.ndarray, least: int = LEAST) -> np.ndarray:
    """A hash of the least tokens from each place on, the same in any page."""
    count = len(tokens) - least + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = tokens[:count].astype(np.uint64)
    for k in range(1, least):
        out = (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + count].astype(np.uint64)
    return out


def _spread(at: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of n places lie within least places from one of at on."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + least, -1)
    return delta.cumsum()[:-1] > 0


def _text(found: list[tuple[int, str]], gone: list[np.ndarray]) -> str:
    """A page's text without what is covered: gone says which of its stream's places are, in open blocks and in articles."""
    at, kept, whole, lost, total = 1, [], [], 0, 0
    for kind, t in found:
        words = t.split()
        if kind == OPEN:
            away = gone[0][at : at + len(words)]
            left = " ".join(w for w, x in zip(words, away.tolist()) if not x) if away.any() else t
        else:
            all_gone = bool(gone[1][at : at + len(words)].all())
            left = "" if all_gone else t
            lost, total = lost + len(words) * all_gone, total + len(words)
        if left:
            kept.append(left)
        whole.append(t)
        at += len(words) + 1
    # a page that would lose all, or an article that would lose most, is a copy with small changes and keeps its text
    return "\n".join(kept if kept and 2 * lost <= total else whole)


class Part:
    """Some pages of a host: the suffix array of the streams of those that are no mirrors, and how many of them hold each place's window."""

    def __init__(self, pages: list[list[tuple[int, str]]], number, least: int = LEAST):
        self.pages, self.least = pages, least
        streams = [_stream(found, number) for found in pages]
        first: dict[tuple, int] = {}
        self.own = [first.setdefault(tuple(x), i) for i, x in enumerate(streams)]
        self.once = sorted(set(self.own))
        sizes = np.array([len(streams[i]) for i in self.once], np.int64)
        self.ends = sizes.cumsum()
        self.starts = self.ends - sizes
        self.tokens = np.fromiter(chain.from_iterable(streams[i] for i in self.once), np.int64, int(sizes.sum()))
        self.page, self.end = np.repeat(np.arange(len(self.once)), sizes), np.repeat(self.ends, sizes)

    def texts(self) -> list[str]:
        """The main text of each page, if these are all pages of the host."""
        needs = [OPEN_PAGES, article_need(len(self.once))]
        gone = covered(self.tokens, self.page, self.end, needs, self.least) if len(self.once) >= OPEN_PAGES else [np.zeros(len(self.tokens), bool)] * 2
        at = {i: (a, b) for i, a, b in zip(self.once, self.starts.tolist(), self.ends.tolist())}
        # a mirror may be written in other letters, so it keeps its own
        return [_text(found, [g[slice(*at[i])] for g in gone]) for found, i in zip(self.pages, self.own)]

    def common(self) -> np.ndarray:
        """Hashes of the windows on so large a share of the pages as articles need. A window with that share of a host's pages has it in one of its parts."""
        if not len(self.tokens):
            return np.empty(0, np.uint64)
        order, lcp = suffix_array(self.tokens, self.end)
        n = len(self.tokens)
        interval = np.concatenate([[0], (lcp < self.least).cumsum()])
        on = np.unique(interval * len(self.once) + self.page[order]) // len(self.once)
        many = np.bincount(on, minlength=n)[interval] >= ARTICLE_SHARE * len(self.once)
        heads = order[many & np.concatenate([[True], np.diff(interval) > 0])]
        heads = heads[heads + self.least <= self.end[heads]]
        hashes = window_hashes(self.tokens, self.least)
        return np.unique(hashes[heads])


def article_need(pages: int) -> int:
    return max(ARTICLE_PAGES, int(np.ceil(ARTICLE_SHARE * pages)))


class _Numbers(dict):
    """A number from 1 on for each word, in order of their coming."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        return n


def unique_texts(pages: list[list[tuple[int, str]]], least: int = LEAST) -> list[str]:
    """The main text of each page of a host; a page is its blocks that are no chrome. Pages of one stream are mirrors and count once."""
    return Part(pages, _Numbers().__getitem__, least).texts()


def _word_hashes() -> Cache:
    """63-bit numbers of words, the same in any task; 0 stays free for block bounds."""
    return Cache(lambda w: xxhash.xxh64_intdigest(w) >> 1 | 1)


def _packed(body: str) -> bytes:
    """A page's blocks as they travel."""
    return zstandard.compress(body.encode())


def _body(packed: bytes) -> str:
    return zstandard.decompress(packed).decode()


def _found(kinds: bytes | None, packed: bytes) -> list[tuple[int, str]]:
    return list(zip(kinds, _body(packed).split("\n"))) if kinds else []


def main_text(pages: DataFrame, least: int = LEAST, part_bytes: int = PART_BYTES) -> DataFrame:
    """(page_id, url, text): one row for each row of pages.

    A null or empty html has the text ''. A null url is a host of its own, named ''. Equal rows have equal texts: pages of equal streams
    count once. Other columns are left out. An empty table gives an empty table. A task holds a host's pages, up to about
    part_bytes of html; a larger host is dealt into parts by a hash of the page's blocks. Parts exchange hashes and counts of windows of least tokens, so what is
    repeated is judged over the whole host, whatever its size (whole_host); how it is dealt changes no text.
    """
    rows = pages.select("page_id", "url", host_of().alias("host"), F.coalesce("html", F.lit("")).alias("body"))
    large = rows.groupBy("host").agg(F.sum(F.octet_length("body")).alias("held")).where(F.col("held") > part_bytes)
    large = staged(large.select("host", F.ceil(F.col("held") / part_bytes).cast("int").alias("parts")), "hosts")
    few = large.count() <= FEW_HOSTS  # small enough to broadcast; beyond that Spark joins by host, and its skew join splits a hot one
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, own long, kinds binary, body binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body"):
            found = [[x for x in _main_role(t, blocks(t)) if x[0] != CHROME] for t in b.column(3).to_pylist()]
            own = [xxhash.xxh64_intdigest("\n".join(" ".join(t.lower().split()) for _, t in f)) - (1 << 63) for f in found]
            cols = [*b.columns[:3], pa.array(own, pa.int64()), pa.array([bytes(k for k, _ in f) for f in found], pa.binary()), pa.array([_packed("\n".join(t for _, t in f)) for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "own", "kinds", "body"])

    parsed = rows.mapInArrow(parse, schema).join(F.broadcast(large) if few else large, "host", "left")
    parsed = parsed.select("page_id", "url", "host", F.pmod("own", F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.col("parts").isNotNull().alias("large"), "kinds", "body")
    together = parsed.repartition("host", "part").sortWithinPartitions("host", "part")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = _word_hashes()

        def done() -> pa.RecordBatch:
            found = [_found(r[4], r[5]) for r in held]
            some = Part(found, number.__getitem__, least)
            if not held[0][3]:
                texts, common, bodies = some.texts(), [None] * len(held), [None] * len(held)
            else:
                texts, bodies = [None] * len(held), [r[5] for r in held]
                common = [some.common().view(np.int64), *[None] * (len(held) - 1)]
            mirror = [i != own for i, own in enumerate(some.own)]
            cols = [pa.array([r[1] for r in held], arrow), pa.array([r[2] for r in held], pa.string()), pa.array([r[0][0] for r in held], pa.string()), pa.array(mirror), pa.array(common, pa.list_(pa.int64())), pa.array([r[4] for r in held], pa.binary()), pa.array(bodies, pa.binary()), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "mirror", "common", "kinds", "body", "text"])

        for b in batches:
            arrow = b.column(0).type
            page_id, url, host, part, big, kinds, body = (c.to_pylist() for c in b.columns)
            for key, *row in zip(zip(host, part), page_id, url, big, kinds, body):
                if held and held[-1][0] != key:
                    yield done()
                    held.clear()
                held.append((key, *row))
        if held:
            yield done()

    out = together.mapInArrow(extract, f"page_id {kind}, url string, host string, mirror boolean, common array<long>, kinds binary, body binary, text string")
    if not large.head(1):
        return out.select("page_id", "url", "text")
    out = staged(out.withColumn("row", F.monotonically_increasing_id()), "pages")
    return out.where("text is not null").select("page_id", "url", "text").unionByName(whole_host(out.where("text is null"), least))


def whole_host(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, text) of the pages of hosts in several parts: row, page_id, url, host, kinds, body, mirror (of another page), common (of a part, in one of its rows).

    Articles lose windows that stand on half of the host's pages: only those can, that do so in a part, so pages are counted for these alone. Open
    blocks lose windows that a second page has: for hosts that have open blocks all pages' windows meet by hash. Mirrors don't count.
    """
    hosts = rows.groupBy("host").agg(F.count_if(~F.col("mirror")).alias("pages"), F.max(F.contains(F.hex("kinds"), F.lit(f"{OPEN:02X}"))).alias("open"))
    hosts = staged(hosts.withColumn("need", F.greatest(F.lit(ARTICLE_PAGES), F.ceil(F.col("pages") * ARTICLE_SHARE))), "hosts")
    wanted = rows.where("common is not null").select("host", F.explode("common").alias("window")).distinct()
    wanted = staged(wanted.groupBy("host").agg(F.collect_list("window").alias("wanted")), "windows")

    def windows(chosen: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = _word_hashes()
            for b in batches:
                hosts_of, ids, found = [], [], []
                for host, row, kinds, body, only in zip(*(c.to_pylist() for c in b.columns)):
                    tokens = np.array(_stream(_found(kinds, body), number.__getitem__), np.int64)
                    own = np.unique(window_hashes(tokens, least).view(np.int64))
                    own = own[np.isin(own, np.array(only, np.int64))] if chosen else own
                    hosts_of += [host] * len(own)
                    ids += [row] * len(own)
                    found.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(hosts_of, pa.string()), pa.array(ids, pa.int64()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], names=["host", "row", "window"])

        return run

    once = rows.where("not mirror").select("host", "row", "kinds", "body")
    kinds = "host string, row long, window long"
    counted = once.join(wanted, "host").mapInArrow(windows(True), kinds).groupBy("host", "window").agg(F.count("*").alias("pages"))
    # tables, so that Spark broadcasts them where they are small, and the pages needn't meet by host again
    often = staged(counted.join(hosts.select("host", "need"), "host").where("pages >= need").groupBy("host").agg(F.collect_list("window").alias("often")), "often")
    with_open = rows.join(hosts.where("open").select("host"), "host", "left_semi").select("host", "row", "kinds", "body", "mirror")
    every = with_open.select("host", "row", "kinds", "body", F.lit(None).cast("array<long>").alias("only")).mapInArrow(windows(False), kinds)
    # a mirror has the windows of its page, which is the one that counts
    every = every.join(with_open.select("row", "mirror"), "row")
    twice = every.where("not mirror").groupBy("host", "window").agg(F.count("*").alias("pages")).where(F.col("pages") >= OPEN_PAGES).select("host", "window")
    shared = staged(every.select("host", "row", "window").join(twice, ["host", "window"]).groupBy("row").agg(F.collect_list("window").alias("shared")), "shared")
    judged = rows.select("row", "page_id", "url", "host", "kinds", "body").join(often, "host", "left").join(shared, "row", "left").select("page_id", "url", "kinds", "body", "often", "shared")
    kind = rows.schema["page_id"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _word_hashes()
        for b in slices(batches, "body"):
            texts = []
            for blocks_of, body, often, shared in zip(*(c.to_pylist() for c in b.columns[2:])):
                if not often and not shared:  # nothing of the page is repeated
                    texts.append(_body(body))
                    continue
                found = _found(blocks_of, body)
                tokens = np.array(_stream(found, number.__getitem__), np.int64)
                own = window_hashes(tokens, least).view(np.int64)
                gone = [_spread(np.flatnonzero(np.isin(own, np.array(known or [], np.int64))), len(tokens), least) for known in (shared, often)]
                texts.append(_text(found, gone))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return judged.mapInArrow(decide, f"page_id {kind}, url string, text string")


def op9_html(pages: DataFrame) -> DataFrame:
    """The rows of query op9."""
    return main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
