"""HTML extraction with a tree-structured graphical model.

The block-level elements of a page are the nodes of a tree; each is content or boilerplate. Node potentials come from
what an element shows (tag, words of its class, id and role, link density, text length), parent-child potentials
tie neighbours together. Sum-product message passing, once upward and once downward, gives the exact content marginal
of every node. Both kinds of potential are estimated from labelled pages: the small set below, and pages of the corpus itself
that are labelled by the documents which their articles were made from (``training_pages``).
Inline elements belong to the block around them. Text of nodes whose marginal exceeds 1/2 is kept, in page order.

Defined results: a null html counts as empty (empty text); character references are decoded; white space inside a
block becomes one space; an unclosed comment, script or style ends with the page; an empty table gives an empty
result; repeated rows give repeated results; other columns are ignored. Trees of any depth are handled without
recursion and in time linear in the page.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import map_rows

# fixed values: element sorts of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea xmp noembed noframes".split())
HIDDEN = frozenset("head select button object canvas svg audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split()) | frozenset(
    "math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts".split()
)
HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())  # all that may stand in head
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body div article section main aside nav header footer form table ul ol dl blockquote td th li dd figure fieldset details".split())
ENDS = {t: {*SIBLINGS.get(t, ()), *(("p",) if t in CLOSES_P else ())} for t in {*SIBLINGS, *CLOSES_P}}  # what a tag closes, up to a scope
# fixed values: words of class, id and role attributes
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright discussion disqus dialog disclaimer footer "
    "form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup privacy promo promotion promotions recommend recommended "
    "related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar tracking widget".split()
)
#: What HTML itself says of these elements counts as one labelled node.
MEANING = {("tag", t): (0, 1) for t in ("nav", "footer", "aside", "form", "header", "dialog", "menu")} | {("tag", t): (1, 1) for t in ("article", "main")}
SAMPLE = 400  # pages of the corpus that the model is fitted to: distinct ones with the smallest hashes
SAMPLE_CHARS = 200_000  # that such a page, or the document that labels it, may have
ALIGNED = 0.8  # of a document's text, that a page has to hold to be labelled by it
_BUCKETS = 1 << 40
KEY_WORDS = 8  # with which a document begins and some block of its page
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("length", "link", "mark", "parent", "parts", "tag", "words")

    def __init__(self, tag: str, parent: int, words: frozenset, mark: str | None):
        self.tag, self.parent, self.words, self.mark = tag, parent, words, mark
        self.length = self.link = 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, parents first, and the text pieces (node, text) in page order; a piece of one space parts blocks."""
    nodes, pieces = [Node("#root", -1, frozenset(), None)], []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the block each belongs to
    opened: Counter = Counter()  # tags on the stack
    regions, runs = [Counter()], [Counter()]  # tags from each open scope on, and inline tags since each open block
    hidden = links = 0  # depth of hidden and of link elements
    at, size = 0, len(html)

    def text(raw: str) -> None:
        if stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if raw and not hidden:
            raw = html_lib.unescape(raw) if "&" in raw else raw
            node = nodes[stack[-1][1]]
            n = len(raw.strip())
            node.length += n
            node.link += n if links else 0
            pieces.append((stack[-1][1], raw))

    def close(down_to: int) -> None:
        nonlocal hidden, links
        while len(stack) > down_to:
            tag, _ = stack.pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"
            opened[tag] -= 1
            if tag in SCOPES:
                regions.pop()
            else:
                regions[-1][tag] -= 1
            if tag not in INLINE:
                pieces.append((0, " "))
                runs.pop()
            else:
                runs[-1][tag] -= 1

    def top(tags) -> int:
        """The place of the topmost open element of these tags; all above it are about to be closed."""
        depth = len(stack) - 1
        while stack[depth][0] not in tags:
            depth -= 1
        return depth

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html[lt + 1 : lt + 2] in ("!", "?"):
            end = html.find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        m = _NAME.match(html, lt + 1)
        if not m:
            text("<")
            at = lt + 1
            continue
        tag, start = m[1].lower(), m.end()
        end = _ATTRIBUTES.match(html, start).end()
        if end >= size:  # a quote that never closes
            end = html.find(">", start)
            end = end if end >= 0 else size
        attributes, at = html[start:end], end + 1
        if stack[-1][0] == "head" and tag not in HEAD and (html[lt + 1] != "/" or tag in ("body", "html", "br")):
            close(len(stack) - 1)
        if html[lt + 1] == "/":
            if (runs[-1] if tag in INLINE else opened)[tag]:
                close(top((tag,)))
            elif tag == "p":
                pieces.append((0, " "))
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(html, at) if not attributes.rstrip().endswith("/") else None
            if stop:
                end = html.find(">", stop.end())
                at = end + 1 if end >= 0 else size
            elif not attributes.rstrip().endswith("/"):
                at = size
            continue
        if tag in VOID:
            pieces.append((0, " "))
            continue
        ends = ENDS.get(tag, ())
        while any(regions[-1][t] for t in ends):
            close(top(ends))
            if tag != "tr":
                break
        block = stack[-1][1]
        if tag not in INLINE:
            marks = {k.lower(): a or b or c for k, a, b, c in _MARKS.findall(attributes)} if attributes else {}
            mark = marks.pop("data-y", None)
            words = frozenset(_WORDS.findall(_CAMEL.sub(r"\1 \2", " ".join(marks.values())).lower())) if marks else frozenset()
            nodes.append(Node(tag, block, words, mark))
            block = len(nodes) - 1
            pieces.append((0, " "))
        if not attributes.rstrip().endswith("/") or tag not in INLINE:
            stack.append((tag, block))
            hidden += tag in HIDDEN
            links += tag == "a"
            opened[tag] += 1
            if tag in SCOPES:
                regions.append(Counter())
            regions[-1][tag] += 1
            if tag in INLINE:
                runs[-1][tag] += 1
            else:
                runs.append(Counter())
    return nodes, pieces


def clues(nodes: list[Node]) -> list[tuple]:
    """What each node shows; link density is that of its whole subtree."""
    length, link = [n.length for n in nodes], [n.link for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        length[nodes[i].parent] += length[i]
        link[nodes[i].parent] += link[i]
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = n.tag in ("article", "main") or (i > 0 and inside[n.parent])
    out = []
    for i, n in enumerate(nodes):
        density = link[i] / length[i] if length[i] else 0.0
        tag = "header in article" if n.tag == "header" and inside[n.parent] else n.tag
        if n.tag in ("article", "main") and n.words & BOILER_WORDS:
            tag = "marked article"
        out.append((("tag", tag), ("boiler", bool(n.words & BOILER_WORDS)), ("content", bool(n.words & CONTENT_WORDS)), ("links", min(2, int(density * 3))), ("size", 0 if not n.length else 1 if n.length < 80 else 2)))
    return out


# Labelled pages: data-y="1" marks content, "0" boilerplate; children inherit.
LABELLED_PAGES = (
    '<html data-y=0><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class="ad">Buy shoes now.</div><article data-y=1><h1>A storm at sea</h1><p>The ship left the harbour at dawn and met the first waves an hour later, when the wind turned north.</p><p>It held.</p><blockquote>Never again.</blockquote><p>All came home.</p></article><footer>Copyright 2020</footer></body></html>',
    '<html data-y=0><body><header><h1>Daily Paper</h1></header><main data-y=1><h1>City votes</h1><p>Voters went to the polls on Sunday in numbers that nobody had expected to see this year.</p><ul><li>North: 40</li><li>South: 60</li></ul><p>More on Monday.</p><div class="share" data-y=0><a>Tweet</a> <a>Mail</a></div></main><aside class="sidebar"><h2>Most read</h2><ul><li><a>One</a></li></ul></aside><footer><p>Contact us</p></footer></body></html>',
    '<html data-y=0><body><div id="header"><p>Welcome</p></div><div id="menu"><a>a</a><a>b</a></div><div id="content" data-y=1><h2>Bread</h2><p>Mix flour and water, then wait for an hour until the dough has doubled in size and smells sour.</p><pre>500 g flour</pre><table><tr><td>Salt</td><td>10 g</td></tr></table></div><div id="footer">All rights reserved</div></body></html>',
    '<html data-y=0><body><div class="cookie-notice"><p>We use cookies to improve your visit. By going on you accept our policy and that of our partners.</p><button>OK</button></div><article data-y=1><h1>Owls</h1><p>Owls hunt at night.</p><figure><figcaption>An owl</figcaption></figure><p>They hear mice under snow at a distance of many metres, which is why they turn their heads.</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I saw one yesterday near the old mill and it did not fly away when I came close to it!</p></div><form><p>Leave a reply</p></form></section></body></html>',
    '<html data-y=0><body><form class="search"><p>Search the site</p></form><article data-y=1><h1>Trains</h1><div class="entry-text"><p>The line opened in May.</p><p>It runs every hour between both towns and carries some two thousand people on a working day.</p><h2>Fares</h2><ol><li>Adults pay two.</li><li>Children pay one.</li></ol></div><aside class="related" data-y=0><p>Related: Buses</p></aside></article><div class="advert"><p>Cheap tickets, book your trip now and save half of the price on all routes.</p></div></body></html>',
    '<html data-y=0><body><section class="promo"><h2>Offers</h2><p>Subscribe today.</p></section><section data-y=1><h1>Rain</h1><p>It rained.</p><p>By noon the river had risen by a metre and the lower road was closed to all traffic.</p></section><div class="newsletter"><form><p>Your mail</p></form></div><footer><ul><li><a>Imprint</a></li><li><a>Privacy</a></li></ul></footer></body></html>',
    '<html data-y=0><body><nav class="breadcrumbs"><ol><li><a>Home</a></li><li><a>Art</a></li></ol></nav><div class="post" data-y=1><h1>Colour</h1><dl><dt>Red</dt><dd>Warm</dd><dt>Blue</dt><dd>Cold</dd></dl><p>Painters knew.</p></div><div class="sponsored"><p>Paint at half price in all our shops until the end of the month, while stocks last.</p></div><div role="contentinfo"><p>Legal</p></div></body></html>',
    '<html data-y=0><body><header><nav><ul><li><a>x</a></li></ul></nav></header><div><article data-y=1><h1>Wells</h1><section><h2>Depth</h2><p>Ten metres.</p><p>Some reach thirty metres and more, where the ground is sand and the water lies deep below.</p></section><section><h2>Use</h2><p>Daily.</p></section></article></div><div class="social"><a>f</a></div><aside><p>Weather today: mild and dry in most parts of the country, with some fog.</p></aside></body></html>',
    '<html data-y=0><body><h1 data-y=1>Salt</h1><p data-y=1>Salt keeps.</p><p data-y=1>It was mined in the hills for three thousand years and carried to the coast on mules.</p><div class="comments"><div class="comment"><p>My uncle worked there for most of his life and told us many stories about the dark.</p></div></div><footer><p>Made by hand in a small town, with thanks to all the people who read and write here.</p></footer></body></html>',
    '<html data-y=0><body><nav><p>Start</p></nav><article data-y=1><header><h1>Glass</h1></header><p>Sand melts at a great heat, and ash lowers it so that a wood fire will do.</p><aside data-y=0><p>More on crafts</p></aside><p>It cools for a day.</p><form data-y=0><p>Your address</p></form></article><footer><p>Imprint</p></footer></body></html>',
    '<html data-y=0><body><aside><p>Weather</p><p>Rain later.</p></aside><main data-y=1><header><h1>Bees</h1></header><p>A hive holds forty thousand of them in June.</p><aside data-y=0><ul><li><a>Honey</a></li></ul></aside><blockquote><p>They know the way.</p></blockquote></main><form><p>Your name</p></form></body></html>',
    '<html data-y=0><body><header><p>The Post</p></header><article data-y=1><h1>Tide</h1><p>Twice a day.</p><form data-y=0><p>Get the tables by mail every week, at no cost to you, from our office.</p></form><p>The moon pulls the sea towards it, and the land keeps it back.</p><nav data-y=0><a>Next</a></nav></article></body></html>',
)


def _group(node: Node) -> int:
    """Parents that only hold a page together, and parents that say what is in them."""
    return int(not (node.tag in ("#root", "html", "body", "div", "section", "main") and not node.words & (BOILER_WORDS | CONTENT_WORDS)))


def marked(nodes: list[Node]) -> list[int]:
    """Labels by the marks of a page; children inherit."""
    labels: list[int] = []
    for node in nodes:
        labels.append(int(node.mark) if node.mark is not None else labels[node.parent] if labels else 0)
    return labels


def own_texts(nodes: list[Node], pieces: list[tuple[int, str]]) -> list[str]:
    """The text of each node itself, without that of the nodes in it."""
    parts: list[list[str]] = [[] for _ in nodes]
    last = 0
    for at, text in pieces:
        if text == " " and at == 0:
            parts[last].append(" ")
        else:
            parts[at].append(text)
            last = at
    return [" ".join("".join(p).split()) for p in parts]


def aligned_labels(nodes: list[Node], texts: list[str], document: str) -> list[int] | None:
    """Labels of a page that was made from ``document`` (its words parted by single spaces); None if it does not hold ALIGNED of it.

    The innermost element with ALIGNED of the page's text that is of the document is content. In it, what is of the document is
    content, the headings before its first block too, and an element without text of its own if most of the text in it
    is. All else is boilerplate.
    """
    held = f" {document} "
    of_it = [bool(t) and f" {t} " in held for t in texts]
    good, every = [len(t) if ok else 0 for t, ok in zip(texts, of_it)], [len(t) for t in texts]
    for i in range(len(nodes) - 1, 0, -1):
        good[nodes[i].parent] += good[i]
        every[nodes[i].parent] += every[i]
    if not document or good[0] < ALIGNED * len(document):
        return None
    common = max(i for i, g in enumerate(good) if g >= ALIGNED * good[0])  # nodes are numbered from the outside
    common = nodes[common].parent if of_it[common] and nodes[common].parent > 0 else common
    inside = [False] * len(nodes)
    inside[common] = True
    for i in range(common + 1, len(nodes)):
        inside[i] = inside[nodes[i].parent]
    first = min(i for i, ok in enumerate(of_it) if ok and inside[i])
    labels = []
    for i, node in enumerate(nodes):
        heading = node.tag in ("h1", "h2") and i < first
        own = bool(texts[i]) and (of_it[i] or heading) or not texts[i] and 2 * good[i] > every[i]
        labels.append(int(i == common or inside[i] and own))
    return labels


def training_pages(pages: DataFrame, documents: DataFrame, sample: int = SAMPLE, html_col: str = "html") -> list[tuple]:
    """(nodes, labels) of up to ``sample`` distinct pages of which some block begins like a document of ``documents`` (text).

    Pages and documents longer than SAMPLE_CHARS are not drawn. The driver holds the sample and the documents that
    label it.
    """
    short = pages.where(F.length(html_col) <= SAMPLE_CHARS).select(html_col, F.pmod(F.xxhash64(html_col), F.lit(_BUCKETS)).alias("h"))
    share = min(_BUCKETS, 2 * sample * _BUCKETS // max(1, pages.count()) + 1)  # about twice as many as are wanted reach the last step
    drawn = short.where(F.col("h") < share).distinct().orderBy("h", html_col).limit(sample).collect()
    drawn = [r[html_col] for r in drawn]
    read = []
    for html in drawn:
        nodes, pieces = parse(html)
        texts = own_texts(nodes, pieces)
        read.append((nodes, texts, {" ".join(t.split(" ")[:KEY_WORDS]) for t in texts if t.count(" ") >= KEY_WORDS - 1}))
    keys = sorted(set().union(*(k for *_, k in read)))
    if not keys:
        return []
    spark = pages.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in keys], "key string"))  # blocks of the sample
    begin = F.regexp_replace(F.regexp_extract("text", rf"^\s*((?:\S+\s+){{{KEY_WORDS - 1}}}\S+)", 1), r"\s+", " ")
    begun = documents.where(F.length("text") <= SAMPLE_CHARS).select(begin.alias("key"), "text").join(wanted, "key")
    begun = begun.groupBy("key").agg(F.min("text").alias("a"), F.max("text").alias("b")).collect()  # copies may differ
    known = {r.key: {" ".join(t.split()) for t in (r.a, r.b)} for r in begun}
    out = []
    for nodes, texts, own in read:
        found = [aligned_labels(nodes, texts, d) for k in sorted(own & set(known)) for d in sorted(known[k])]
        found = [x for x in found if x]
        if found:
            out.append((nodes, max(found, key=sum)))
    return out


class Model:
    """Log potentials from labelled pages: node clues given the label, and child given parent and parent's group."""

    SMOOTHING = 0.5
    PAIR_SMOOTHING = ((0.2, 0.2), (5.0, 0.2))  # by parent, then child: articles often hold adverts, forms and comments

    def __init__(self, pages=LABELLED_PAGES, aligned=()):
        """From ``pages`` with marks, and ``aligned`` ones: (nodes, their labels).

        Pages of a corpus are of few templates: all of them together weigh as much as one page with marks, which is one too.
        """
        pairs = [[list(row) for row in self.PAIR_SMOOTHING] for _ in range(2)]
        counts, totals = [Counter(), Counter()], [0, 0]
        own = [(nodes, marked(nodes), 1.0) for nodes, _ in map(parse, pages)]
        share = sum(len(n) for n, *_ in own) / len(own) / max(1, sum(len(n) for n, _ in aligned)) if own else 1.0
        for nodes, labels, weight in [*own, *((n, y, min(1.0, share)) for n, y in aligned)]:
            for node, shown, y in zip(nodes, clues(nodes), labels):
                for c in shown:
                    counts[y][c] += weight
                totals[y] += weight
                if node.parent >= 0:
                    pairs[_group(nodes[node.parent])][labels[node.parent]][y] += weight
        self.pair = [[[math.log(x / sum(row)) for x in row] for row in group] for group in pairs]
        s = self.SMOOTHING
        for clue, (y, n) in MEANING.items():
            counts[y][clue] += n
        # clues of one node are not independent: those that all sorts of elements share count half
        weigh = lambda c: 1.0 if c in MEANING or c[0] in ("boiler", "content") else 0.5
        self.clue = {c: weigh(c) * (math.log((counts[1][c] + s) / (totals[1] + 2 * s)) - math.log((counts[0][c] + s) / (totals[0] + 2 * s))) for c in {*counts[0], *counts[1]}}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Content probability of every node by sum-product over the tree; the root is boilerplate."""
        n, get = len(nodes), self.clue.get
        pair = [self.pair[_group(nodes[x.parent])] if x.parent >= 0 else None for x in nodes]
        own = [sum(get(c, 0.0) for c in shown) for shown in clues(nodes)]
        belief = own[:]  # log odds of the node and all below it
        to_parent = [0.0] * n
        for i in range(n - 1, 0, -1):
            b, (p0, p1) = belief[i], pair[i]
            to_parent[i] = _logsum(p1[0], p1[1] + b) - _logsum(p0[0], p0[1] + b)
            belief[nodes[i].parent] += to_parent[i]
        out = [0.0] * n
        full = [-30.0] + [0.0] * (n - 1)
        for i in range(1, n):
            p0, p1 = pair[i]
            above = full[nodes[i].parent] - to_parent[i]  # the parent without what this node told it
            full[i] = belief[i] + _logsum(p0[1], p1[1] + above) - _logsum(p0[0], p1[0] + above)
            out[i] = 1 / (1 + math.exp(-max(-700.0, min(700.0, full[i]))))
        return out


def _logsum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def main_text(html: str, model: Model) -> str:
    nodes, pieces = parse(html)
    content = [p > 0.5 for p in model.marginals(nodes)]
    content[0] = len(nodes) == 1  # a page without elements is its text
    return " ".join("".join(text if text == " " or content[node] else " " for node, text in pieces).split())


def extract(pages: DataFrame, documents: DataFrame | None = None, labelled=LABELLED_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page; with ``documents`` the model is also fitted to pages that they label."""
    model = Model(labelled, training_pages(pages, documents, html_col=html_col) if documents is not None else ())

    def make():
        def one(key, url, html):
            text = main_text(html or "", model)
            return key, url, text, len(text)

        return one

    return map_rows(pages, [id_col, url_col, html_col], f"{id_col} long,{url_col} string,text string,n_chars long", make)
