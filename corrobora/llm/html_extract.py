"""Main text of web pages from flat text blocks and a decision tree.

A page is read once from front to back into text blocks, the stretches between block-level tags. A block's features
are its word count and link density, those of its two neighbours, its size beside the page's longest block, and what
its containers are. A decision tree fitted on a small labelled table, the blocks of the pages below, tells main text
from the rest.

Names and kinds of containers are evidence beside the words, not verdicts: one that holds most of a page's running text
is a layout around the article, whatever it is called, and nothing is inherited through it; a name that layouts use as
well (widget, share, banner) counts for less than one that only tells of other parts (advert, comments), and for nothing
where most of the running text stands under it; the header of an article belongs to it, and so do lists of links in it.

Reading takes time in proportion to the page, whatever is unclosed in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds, and words that a class, id or role uses for parts that are not the article.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote center dd details dialog div dl fieldset figure footer form header li main menu nav ol section table td ul".split())
BOILER_TAGS = frozenset("aside dialog fieldset footer form header menu nav".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is not shown. RAW ones run to the end of the page where they are not closed, as in browsers;
#: the others then end at the next block.
RAW = frozenset("script style textarea".split())
UNSEEN = RAW | frozenset("annotation annotation-xml audio button canvas head iframe noscript object optgroup option select svg template title video".split())
HINTS = frozenset("ad ads advert advertisement advertorial adverts alert banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disqus footer form gdpr header login masthead menu nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: Those of them that layouts also use around an article's own parts.
WEAK_HINTS = frozenset("banner header login masthead menu nav navbar navigation notice notification search share sharing social toolbar topbar widget".split())
DISCUSSION = frozenset("comment comments disqus replies reply respond".split())
# Names that tell what a page has or can do (no-sidebar, comments-open), or how it is laid out (sidebar-right).
ABOUT_FIRST, ABOUT_LAST = frozenset("has have is no with without".split()), frozenset("both closed disabled enabled layout left open right wrapper".split())

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[<>\"']")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


BLOCK_AHEAD = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))}|body)\b", re.I)


@dataclass
class Container:
    """An open element that holds blocks; ``running`` counts the words outside links in it and, in the end, below."""

    tag: str
    parent: int
    hints: frozenset[str] = frozenset()
    hint: int = 0
    discussion: bool = False
    running: int = 0
    holds_main: bool = False
    main: bool = False
    article: bool = False
    boiler: bool = False


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    container: int


def _hinted(attributes: str) -> frozenset[str]:
    """The words by which a class, id or role names a part that is not the article."""
    hints: set[str] = set()
    for found in NAMED.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").split():
            parts = [part for part in PART.split(CAMEL.sub(" ", name).lower()) if part]
            if parts and parts[0] not in ABOUT_FIRST and parts[-1] not in ABOUT_LAST:
                hints |= HINTS.intersection(parts)
    return frozenset(hints)


def tags(page: str, at: int = 0) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of tags from ``at`` on; comments and declarations have no name.

    A tag ends at the first ``>`` outside quotes; where a quote does not close, or another tag opens before that, at
    the first one at all. Every place is passed a bounded number of times. The caller may send where to go on.
    """
    last = {c: page.rfind(c) for c in "\"'>"}
    while (start := page.find("<", at)) >= 0 and start < last[">"] or page.startswith("<!--", start):
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            token = start, len(page) if close < 0 else close + 3, "", False, ""
        elif page.startswith(("<!", "<?"), start):
            token = start, page.find(">", start) + 1, "", False, ""
        elif (name := NAME.match(page, start)) is None:
            at = start + 1
            continue
        else:
            end = begin = name.end()
            while (stop := STOP.search(page, end)) and stop[0] in "\"'" and stop.start() < last[stop[0]]:
                end = page.find(stop[0], stop.end()) + 1
            end = stop.start() if stop and stop[0] == ">" else page.find(">", begin)
            token = start, end + 1, name[2].lower(), bool(name[1]), page[begin:end]
        moved = yield token
        at = token[1] if moved is None else moved


def _tag(page: str, tag: str, at: int) -> tuple[bool, int] | None:
    """Whether the next tag of that name closes, and where it ends."""
    found = re.compile(rf"<(/?){tag}\b", re.I).search(page, at)
    end = page.find(">", found.end()) if found else -1
    return (bool(found[1]), end + 1) if end >= 0 else None


def _after_unseen(page: str, tag: str, at: int, absent: set[str]) -> int:
    """Where an element that is not shown, opened before ``at``, ends; ``absent`` gathers what does not come again."""
    if tag == "head":
        stop = None if tag in absent else re.compile(r"</head\b|<body\b", re.I).search(page, at)
        if stop is None:
            absent.add(tag)
            return at
        return page.find(">", stop.end()) + 1 or at if stop[0][1] == "/" else stop.start()
    stop = None if tag in absent else _tag(page, tag, at)
    if stop is None:
        absent.add(tag)
    if tag in RAW:
        while stop and not stop[0]:
            stop = _tag(page, tag, stop[1])
        return stop[1] if stop else len(page)
    if stop and stop[0]:
        return stop[1]
    block = BLOCK_AHEAD.search(page, at)
    return block.start() if block else len(page)


def text_blocks(page: str) -> tuple[list[Block], list[Container]]:
    """The page's non-empty blocks in order, references decoded and white space collapsed, and their containers."""
    found: list[Block] = []
    containers = [Container("", 0)]
    pieces: list[tuple[str, bool]] = []
    stack = [0]
    heading = False
    links = 0

    def close() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, inside in pieces if inside)
                words = text.count(" ") + 1
                found.append(Block(text, words, min(linked, words), heading, stack[-1]))
                containers[stack[-1]].running += words - min(linked, words)
            pieces = []

    at, reader = 0, tags(page)
    moved = None
    open_tags: dict[str, int] = {}
    absent: set[str] = set()
    while True:
        try:
            start, end, tag, ends, attributes = reader.send(moved)
        except StopIteration:
            break
        moved = None
        if start > at:
            pieces.append((page[at:start], links > 0))
        at = end
        if not tag:
            continue
        if tag in UNSEEN:
            if tag in ("head", "title"):
                close()
            if not ends and not attributes.endswith("/"):
                at = moved = _after_unseen(page, tag, at, absent)
            continue
        if tag == "br":
            pieces.append((" ", links > 0))
        elif tag == "a":
            links = max(0, links - 1) if ends else 1
        elif tag in BLOCK_TAGS:
            close()
            links = 0
            heading = tag in HEADINGS and not ends
            if tag not in CONTAINERS:
                continue
            if not ends:
                containers.append(Container(tag, stack[-1], _hinted(attributes)))
                stack.append(len(containers) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
            elif open_tags.get(tag):
                gone = ""
                while gone != tag:
                    gone = containers[stack.pop()].tag
                    open_tags[gone] -= 1
    if at < len(page):
        pieces.append((page[at:], links > 0))
    close()
    _inherit(containers)
    return found, containers


def _inherit(containers: list[Container]) -> None:
    """Sums upwards, then what containers say downwards, but for those that are a layout around the main text."""
    mains = 0
    for k in range(len(containers) - 1, 0, -1):
        own = containers[k]
        above = containers[own.parent]
        above.running += own.running
        own.holds_main |= own.tag in MAIN_TAGS
        mains += own.tag in MAIN_TAGS
        above.holds_main |= own.holds_main
    total = containers[0].running
    under: dict[str, int] = {}
    inside: list[frozenset[str]] = [frozenset()]
    for own in containers[1:]:
        # Words already met on the way down are counted once.
        for word in (own.hints & WEAK_HINTS) - inside[own.parent]:
            under[word] = under.get(word, 0) + own.running
        inside.append(inside[own.parent] | own.hints)
    void = {word for word, words in under.items() if 2 * words >= total}
    for own in containers[1:]:
        above = containers[own.parent]
        own.hint = max([0, *(1 if word in WEAK_HINTS else 2 for word in own.hints - void)])
        own.discussion = not DISCUSSION.isdisjoint(own.hints)
        # A discussion may be longer than the article; it is the page itself only where there is no article but in it.
        around = 2 * own.running >= total and (own.holds_main or not mains) and not (own.discussion and above.running > own.running)
        own.main = above.main or own.tag in MAIN_TAGS
        own.article = above.article or own.tag == "article"
        own.hint = 0 if around else max(own.hint, above.hint * (own.tag != "main"))
        own.boiler = (own.tag in BOILER_TAGS and not (own.tag == "header" and above.article) or (above.boiler and own.tag != "main")) and not around


FEATURES = ("words before", "words", "words after", "links before", "links", "links after", "words beside the longest", "heading", "in main", "in article", "in boilerplate element", "named as no article", "page has main")


def features(blocks: list[Block], containers: list[Container]) -> np.ndarray:
    """One row per block; a missing neighbour has no words and no links."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    links = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    own = [containers[b.container] for b in blocks]
    flags = np.array([[b.heading, c.main, c.article, c.boiler, c.hint] for b, c in zip(blocks, own, strict=True)], float).reshape(-1, 5)
    has_main = np.full(len(blocks), float(any(c.main for c in own)))
    running = words * (1 - links)
    return np.column_stack([words[:-2], words[1:-1], words[2:], links[:-2], links[1:-1], links[2:], words[1:-1] / max(1, running.max()), flags, has_main])


#: The labelled pages. {n} stands for n words and [n] for a link of n words; a block that starts with + is main text.
LABELLED = (
    # an article with a menu, an advert and a footer around it
    "<nav><ul><li>[1]<li>[1]<li>[2]</ul></nav><div class=ad>{9}</div><article><h1>+{9}</h1><p>+{60}</p><p>+{8}</p><p>+{90}</p><h2>+{3}</h2><ul><li>+{6}<li>+{12}</ul><p>+{1}</p></article><footer>{12}</footer>",
    "<header>{2}<ul><li>[1]<li>[1]</ul></header><article><h1>+{5}</h1><p>+{1}</p><p>+{300}</p></article><div class=advert>{30}</div><footer><p>{25} [2]</p><ul><li>[1]<li>[2]</ul></footer>",
    "<nav>[1] [1] [1]</nav><div class=ad>{12}</div><article><h1>+{12}</h1><p>+{4}</p><p>+{3}</p></article><footer>{5} [2]</footer>",
    # a main element with asides, forms, related links and a sign-up in it
    "<header><p>{3}</p></header><main><h1>+{6}</h1><p>+{45}</p><blockquote><p>+{20}</p></blockquote><p>+[5] {2}</p><table><tr><td>+{2}<td>+{1}<tr><td>+{3}<td>+{8}</table><aside><h4>{3}</h4><p>{30}</p></aside><p>+{55}</p><figure><figcaption>+{9}</figcaption></figure><p>+{25} [20]</p>"
    "<div class=related-posts><h3>{2}</h3><ul><li>[6]<li>[5]</ul></div><div class=newsletter-signup><p>{14}</p></div><form><p>{5}</p></form></main><div><p>{40}</p><p>{5}</p></div><footer><p>{60}</p></footer>",
    "<div>[1] [1] [1]</div><main><ul><li>[2]<li>[3]<li>[2]</ul><h1>+{4}</h1><p>+{35}</p><h2>+{2}</h2><p>+{70}</p><ul><li>[4]<li>[3]<li>[5]</ul></main><div><h3>{3}</h3><p>{70}</p></div>",
    "<article><h1>+{4} [1]</h1><p>+{14} [2]</p><p>+{30} [6]</p><p>+{8} [4]</p><ul><li>+{5} [3]<li>+{9} [2]<li>+[3]: {6}</ul><p>+{3} [1]</p><p>+{20} [9]</p></article><div>{14} [2]</div><footer>{9} [3]</footer>",
    "<div>[1] [1] [2]</div><p>+{30} [5]</p><p>+{12} [3]</p><p>+{45} [2]</p><p>+{9} [1] {4}</p><p>+{50}</p><div>[2] [1] {2}</div>",
    # articles that end the page, and texts that are all of it
    "<nav>[1] [1]</nav><article><h1>+{5}</h1><p>+{80}</p><p>+{150}</p></article>", "<main><p>+{40}</p><p>+{6}</p><p>+{70}</p></main>", "<article><p>+{300}</p></article>", "<article><h2>+{4}</h2><p>+{16}</p></article>",
    "<p>+{90}</p><p>+{200}</p><p>+{68}</p>", "<h1>+{6}</h1><p>+{75}</p><p>+{110}</p>", "<ul><li>[1]<li>[2]</ul><p>+{60}</p><p>+{130}</p>", "<p>+{500}</p>", "<h2>+{3}</h2><p>+{35}</p><p>+{20}</p><p>+{100}</p>",
    # a few words between links, at the end and in the middle
    "<div>+{60}</div><div>+{55}</div><div>[4]</div><div>{5}</div><div>[5]</div>", "<div>[3]</div><div>{4}</div><div>[4]</div><div>{6}</div><div>[2]</div><p>+{70}</p><p>+{4}</p><p>+{40}</p><div>[5]</div><div>{3}</div><div>[3]</div>",
    "<div>[3] {1}</div><div>{2}</div><div>[1] [1]</div><h1>+{6}</h1><p>+{25}</p><p>+{7}</p><p>+{31}</p><div>[2]</div><div>{8}</div><div>[3] [3]</div><div>{12}</div>",
    "<main><div class=breadcrumb>[1] {1} [1]</div><h1>+{7}</h1><div class=share>{2} [1]</div><p>+{50}</p><div class=promo><p>{35}</p></div><p>+{2}</p><p>+{65}</p></main>",
    # readers' comments, within the article and after it, some longer than it
    "<article><h1>+{8}</h1><p>+{60}</p><p>+{30}</p><section id=comments><h2>{2}</h2><div class=comment><p>{35}</p></div><div class=comment><p>{4}</p><p>{90}</p></div></section></article>",
    "<article><p>+{40}</p><p>+{6}</p></article><div class=comments><p>{80}</p><p>{50}</p><p>{2}</p></div><footer>{14}</footer>",
    # pages without these elements: running text among menus, headlines and small print
    "<div>[1] [1] [1] [1]</div><div><h1>+{7}</h1><p>+{50}</p><p>+{5}</p><p>+{70}</p></div><div>[2] [2] {1}</div><div>{6}</div>",
    "<div>[2] [1]</div><div>{3}</div><div><p>+{35}</p><p>+{18}</p><p>+{22}</p><p>+{8}</p><p>+{40}</p></div><ul><li>[5]<li>[6]</ul><p>{4} [2]</p>",
    "<table><tr><td>[1]<br>[1]<br>[2]<td><p>+{40}<p>+{80}<p>+{3}<p>+{30}<td>{3} [6]</table>",
    "<div>[8] {2}</div><div>[7]</div><div>[9] {3}</div><h2>+{6}</h2><div>+{90}</div><div>+{45} [4]</div><div>[7]</div><div>[8] {4}</div><div>{9} [1]</div>",
    "<ul><li>[1]<li>[1]</ul><h1>+{3}</h1><div>+{12}</div><div>+{15}</div><div>+{60}</div><h3>+{2}</h3><div>+{25}</div><ul><li>[2]<li>[2]</ul>",
    "<div>[1] [2]</div><p>+{120}</p><div>[2] [1] [1]</div>",
    # short pages of nothing but text, and pages of nothing but links
    "<p>+{4}</p><p>+{3}</p>", "+{2}", "<h1>+{2}</h1><p>+{7}</p>", "<p>+{12}</p><p>+{9}</p><p>+{1}</p>", "<div>+{25}</div>",
    "<ul><li>[1]<li>[1]<li>[2]</ul><div>[3] {1}</div>", "<p>[4]</p>", "<nav>[1] [2]</nav><footer>{8}</footer>",
    # parts that only their names tell
    "<div id=header>{4}</div><div id=menu>[1] [1]</div><div id=content><h1>+{5}</h1><p>+{33}</p><p>+{50}</p><p>+{4}</p></div><div class=sidebar><h3>{2}</h3><p>{25}</p></div><div id=footer><p>{20}</p></div><div class=cookie-banner>{22}</div>",
    "<div class=topbar>{6}</div><div><p>+{28}</p><p>+{60}</p></div><div class=comment-list><p>{30}</p><p>{45}</p></div><div class=notice>{15}</div>",
    # parts of an article that names and links alone would take for something else
    "<nav>[1] [2]</nav><article><header><h1>+{5}</h1><p>+{12}</p></header><p>+{60}</p><div class=text-widget><p>+{60}</p></div><p>+{70}</p><section class=share><p>+{55}</p></section><div class=share>{2} [1]</div><p>+{50}</p></article>",
    "<article><header><h2>+{7}</h2></header><p>+{80}</p><h3>+{1}</h3><ul><li>+[4]<li>+[6]<li>+[2]<li>+[9]</ul><p>+{30}</p><div class=widget>{3} [2]</div><div class=banner><p>+{80}</p></div><div class=banner>{6}</div></article><div class=widget><p>{14}</p></div>",
    "<article><p>+{100}</p><ol><li>+[5]<li>+[3]<li>+[8]</ol><div class=ad><p>{60}</p></div><div class=notice><p>+{65}</p></div><div class=notice>{10}</div><aside><p>{60}</p></aside><div class=related><ul><li>[5]<li>[7]<li>[6]</ul></div><div class=promo>{70}</div></article>",
    "<article><h1>+{3}</h1><p>+[12]</p><p>+{45}</p><p>+[3]</p><p>+{60}</p><form><p>{50}</p></form><div class=social><ul><li>[1]<li>[1]<li>[1]</ul></div><nav><ul><li>[4]<li>[5]<li>[6]<li>[3]</ul></nav><p>+{40}</p><aside><ul><li>[7]<li>[5]<li>[6]</ul></aside><footer><ul><li>[4]<li>[3]</ul></footer></article>",
    # boilerplate elements around running text of a page that has no main one
    "<header><h1>{4}</h1></header><div><p>+{45}</p><p>+{60}</p></div><aside><p>{40}</p></aside><footer><p>{35}</p><p>{3}</p></footer>",
)


def _labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and answers of all blocks of the labelled pages."""
    rows, answers = [], []
    for page in LABELLED:
        page = re.sub(r"\[(\d+)\]", r"<a href=x>{\1}</a>", page)
        page = re.sub(r"\{(\d+)\}", lambda n: " ".join(["w"] * int(n[1])), page)
        blocks, containers = text_blocks(page)
        rows.append(features(blocks, containers))
        answers += [b.text.startswith("+") for b in blocks]
    return np.concatenate(rows), np.array(answers, float)


@dataclass
class Tree:
    """Goes left if the feature is at most the bound; a leaf holds the answer."""

    answer: bool
    feature: int = -1
    bound: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def __call__(self, row: np.ndarray) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.bound else node.high
        return node.answer


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """Splits by Gini impurity until leaves are pure or would hold fewer rows than ``least``; of equal splits the
    first feature's lowest bound is taken."""
    answer = bool(2 * y.sum() >= len(y))
    if depth == 0 or y.min() == y.max():
        return Tree(answer)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            if min(left.sum(), (~left).sum()) < least:
                continue
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(bound)
    if best is None:
        return Tree(answer)
    left = x[:, best[1]] <= best[2]
    return Tree(answer, best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


@lru_cache(1)
def fitted() -> Tree:
    return grow(*_labelled(), least=3)


def main_text(page: str) -> str:
    blocks, containers = text_blocks(page)
    if not blocks:
        return ""
    tree = fitted()
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks, containers), strict=True) if tree(row))


PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            texts = [main_text(page) for page in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), texts, [len(t) for t in texts]], schema=PAGE)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Character references are decoded, white space within a block becomes one space, blocks are trimmed and
    joined by an empty line in page order. A page that is null, empty or without main text has the empty
    text. Unclosed and misnested tags are taken as browsers do where it matters here; an unclosed comment,
    script, style or textarea runs to the end, any other element that is not shown to the next block. Null and repeated identifiers are kept as they come, other columns are
    ignored, an empty table gives no rows.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
