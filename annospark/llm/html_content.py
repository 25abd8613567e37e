"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that can hold text is a node with two states, content or not.
Its own features (tag, names, text, links, place) give node potentials; every
edge to its parent has a potential by the kind of the child.  Sum-product
messages go up from the leaves and down from the root; a node's marginal says
whether the text directly in it is content.  The parameters maximise the
likelihood of labelled trees; its gradient is labels minus marginals, from
the same messages.

Labelled pages: a bounded sample of the table's pages whose markup gives labels,
spread over their hosts (others say nothing about content), marked by their
semantic elements (text inside an article or main element, outside of
navigation, asides, forms, page headers and footers, is content).  Each is used
as it is and in changed copies: with boilerplate blocks put in at random
places, and with semantic elements renamed to plain ones, so that the model
also learns names, links and texts where a page says nothing else.

Defined results: null, empty and markup-free html give the text of the page as one block
(none if blank); rows that repeat are read alike; an empty table gives no
rows and trains on the built-in pages only; unclosed, crossed and stray tags
are repaired as browsers do for paragraphs and lists; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pages that the model learns from (by least hash); changed copies of each; passes over them.
SAMPLE, COPIES, PASSES, RATE, DECAY = 200, 2, 4, 0.5, 1e-4
#: Least number of trees that the training goes over; few pages are gone over more often.
STEPS = 2500
SEED = 11

# Element kinds, fixed by the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe canvas select head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br object "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
                   "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr mlabeledtr munder munderover none semantics annotation "
                   "annotation-xml".split())
#: Tags that an opening tag of the key closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div article section main body nav aside header footer form blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)  # quotes count after = only
#: Ends of raw elements, looked up in the page itself: lower case may be longer than the page.
_ENDS = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-label|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z]+")

GOOD_NAMES = frozenset("article body content entry main post story text prose paragraph headline hentry page".split())
BAD_NAMES = frozenset("""ad ads adv advert advertisement banner promo promotion sponsor sponsored nav navigation navbar menu
    menubar breadcrumb breadcrumbs crumbs header masthead topbar footer bottom copyright sidebar side aside widget related
    recommended more popular trending comment comments disqus respond reply replies discussion reader readers form search
    login signin signup subscribe subscription newsletter register share sharing social follow cookie cookies consent gdpr
    notice notices alert warning privacy banner popup modal overlay dialog toolbar pagination pager tags tagcloud meta byline
    feedback rating outbrain taboola skip legal disclaimer toc""".split())
_BAD = re.compile("|".join(sorted(("advert", "banner", "sidebar", "comment", "cookie", "consent", "footer", "navbar", "breadcrumb", "newsletter",
                                   "subscribe", "sponsor", "promo", "related", "widget", "social", "share", "popup", "masthead"))))

KINDS = ["article", "main", "section", "div", "p", "li", "ul", "nav", "aside", "header", "footer", "form", "heading", "table",
         "quote", "figure", "body", "other"]
_KIND = {"article": "article", "main": "main", "section": "section", "div": "div", "center": "div", "p": "p", "pre": "p",
         "li": "li", "dt": "li", "dd": "li", "ul": "ul", "ol": "ul", "dl": "ul", "menu": "nav", "nav": "nav", "aside": "aside",
         "header": "header", "footer": "footer", "address": "footer", "form": "form", "fieldset": "form", "button": "form",
         "table": "table", "tr": "table", "td": "table", "th": "table", "tbody": "table", "blockquote": "quote",
         "figure": "figure", "figcaption": "figure", "details": "div", "dialog": "aside", "body": "body", "html": "body"}
_KIND |= {f"h{i}": "heading" for i in range(1, 7)}

FEATURES = ["bias", *[f"kind:{k}" for k in KINDS], "good name", "bad name", "role", "hidden", "has text", "long", "very long",
            "stops", "link share", "all links", "symbols", "depth", "first tenth", "last tenth", "short", "copyright"]
#: Parameters: one weight a feature, then log potentials of (kind, parent state, own state).
SIZE = len(FEATURES) + len(KINDS) * 4
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


class Node:
    __slots__ = ("tag", "kind", "parent", "children", "parts", "attributes", "links", "chars", "depth", "order")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.kind, self.parent, self.attributes = tag, _KIND.get(tag, "other"), parent, attributes
        self.children: list[Node] = []
        #: Own text in page order: (place in the page, text, in a link).
        self.parts: list[tuple[int, str, bool]] = []
        self.links = self.chars = 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)


def parse(page: str) -> list[Node]:
    """Block elements of a page, parents first; each text run belongs to the innermost one.

    A run's first number is its block: text before and after an inner block is
    in blocks of its own.
    """
    root = Node("body", None)
    nodes, stack = [root], [root]
    block, at, links, end = 0, 0, 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            stack[-1].parts.append((block, page[at:stop], links > 0))
        if not found:
            break
        at = found.end()
        closing, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            continue
        tag = name.lower()
        if tag == "br" or tag == "hr":
            stack[-1].parts.append((block, " ", False))
        if tag in RAW and not closing:
            if tag == "head":
                continue  # its children are left out one by one
            if attributes.rstrip().endswith("/"):
                continue
            close = _ENDS[tag].search(page, at)
            if close:
                gone = page.find(">", close.end())
                at = gone + 1 if gone >= 0 else end
            elif tag in ("script", "style", "title", "textarea"):
                at = end
            continue
        if tag in VOID or tag in RAW:
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        block += 1
        links = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):
            root.attributes += " " + attributes
            continue
        if stack[-1].tag == "p":
            stack.pop()
        shuts = CLOSES.get(tag)
        if shuts:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shuts:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        node = Node(tag, stack[-1], attributes)
        nodes.append(node)
        stack.append(node)
    return nodes


def _names(node: Node) -> tuple[set[str], str, bool]:
    names: set[str] = set()
    role, hidden = "", False
    for key, value in _ATTRIBUTE.findall(node.attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "aria-label"):
            names.update(_NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)))
        elif key == "role":
            role = value
        elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return names, role, hidden


def describe(nodes: list[Node]) -> list[list[tuple[int, float]]]:
    """Sparse features of every node."""
    out = []
    for i, node in enumerate(nodes):
        node.order = i
        node.chars = sum(len(t.strip()) for _, t, _ in node.parts)
        node.links = sum(len(t.strip()) for _, t, link in node.parts if link)
    for node in reversed(nodes):
        if node.parent:
            node.parent.links += node.links
            node.parent.chars += node.chars
    n = len(nodes)
    first = 1 + len(KINDS)
    for i, node in enumerate(nodes):
        own = "".join(t for _, t, _ in node.parts).strip()
        names, role, hidden = _names(node) if node.attributes else (set(), "", False)
        f = [(0, 1.0), (1 + KINDS.index(node.kind), 1.0)]
        bad = bool(names & BAD_NAMES) or any(_BAD.search(x) for x in names)
        words = len(own.split()) if own else 0
        share = min(node.links / node.chars, 1.0) if node.chars else 0.0
        values = (bool(names & GOOD_NAMES) and not bad, bad, role in _ROLES, hidden, bool(own), words >= 10, words >= 40,
                  bool(own) and own[-1] in ".!?:;…\"'", share, share > 0.9, sum(c in "|©»›•" for c in own[:200]) / 5,
                  min(node.depth, 10) / 10, i < n * 0.1, i > n * 0.9, 0 < words < 4, "©" in own or "&copy;" in own)
        f += [(first + j, float(v)) for j, v in enumerate(values) if v]
        out.append(f)
    return out


def _messages(nodes: list[Node], unary: list[float], edge: np.ndarray) -> tuple[list, list, list]:
    """Upward beliefs, upward messages, marginals (probability of content) of every node.

    ``unary`` is the log odds of content by features; ``edge[k]`` the log potentials
    of (parent state, own state) for kind k.  States: 0 not, 1 content.
    """
    n = len(nodes)
    up = [(0.0, u) for u in unary]
    to_parent = [(0.0, 0.0)] * n
    kinds = [KINDS.index(x.kind) for x in nodes]
    e = edge.tolist()
    for i in range(n - 1, 0, -1):  # children come after their parents
        a, b = up[i]
        (e00, e01), (e10, e11) = e[kinds[i]]
        m0, m1 = _log_add(e00 + a, e01 + b), _log_add(e10 + a, e11 + b)
        to_parent[i] = (m0, m1)
        p = nodes[i].parent.order
        up[p] = (up[p][0] + m0, up[p][1] + m1)
    whole = [(0.0, 0.0)] * n
    whole[0] = up[0]
    for i in range(1, n):
        p = nodes[i].parent.order
        m0, m1 = to_parent[i]
        x0, x1 = whole[p][0] - m0, whole[p][1] - m1
        (e00, e01), (e10, e11) = e[kinds[i]]
        d0, d1 = _log_add(x0 + e00, x1 + e10), _log_add(x0 + e01, x1 + e11)
        whole[i] = (up[i][0] + d0, up[i][1] + d1)
    return to_parent, whole, [_chance(b - a) for a, b in whole]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if a - b < 40 else a


def _chance(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -60.0), 60.0)))


def marginals(nodes: list[Node], weights: np.ndarray) -> list[float]:
    w = weights.tolist()
    unary = [sum(w[j] * v for j, v in f) for f in describe(nodes)]
    edge = weights[len(FEATURES):].reshape(len(KINDS), 2, 2)
    return _messages(nodes, unary, edge)[2]


def gradient(nodes: list[Node], labels: list[int], weights: np.ndarray) -> np.ndarray:
    """Slope of the log likelihood of a labelled tree."""
    described = describe(nodes)
    w = weights.tolist()
    edge = weights[len(FEATURES):].reshape(len(KINDS), 2, 2)
    to_parent, whole, chances = _messages(nodes, [sum(w[j] * v for j, v in f) for f in described], edge)
    out = np.zeros(SIZE)
    slope = out[len(FEATURES):].reshape(len(KINDS), 2, 2)
    for i, node in enumerate(nodes):
        miss = labels[i] - chances[i]
        for j, v in described[i]:
            out[j] += miss * v
        if node.parent:
            p, k = node.parent.order, KINDS.index(node.kind)
            # joint of (parent, own): the parent without this child's message, the edge, this subtree
            x = np.array(whole[p]) - np.array(to_parent[i])
            below = np.array(whole[i]) - np.array([np.logaddexp(x[0] + edge[k, 0, s], x[1] + edge[k, 1, s]) for s in (0, 1)])
            joint = np.exp((t := x[:, None] + edge[k] + below[None]) - t.max())
            slope[k] -= joint / joint.sum()
            slope[k, labels[p], labels[i]] += 1
    return out / len(nodes)


# ---------------------------------------------------------------- labelled pages
_OUT = frozenset("nav aside header footer form".split())


def mark(nodes: list[Node]) -> list[int]:
    """1 for nodes inside an article or main element and outside of page furniture, else 0."""
    labels: list[int] = []
    for i, node in enumerate(nodes):
        node.order = i
        if node.parent is None:
            labels.append(0)
            continue
        names, role, hidden = _names(node) if node.attributes else (set(), "", False)
        own = labels[node.parent.order]
        if node.kind in ("article", "main"):
            own = 1
        if (node.kind in _OUT and not (node.kind == "header" and own)) or role in _ROLES or hidden or names & BAD_NAMES \
                or any(_BAD.search(x) for x in names):
            own = 0
        if own and node.parent.order and not labels[node.parent.order] and _inside_out(node.parent, labels):
            own = 0
        labels.append(own)
    return labels


def _inside_out(node: Node, labels: list[int]) -> bool:
    """Whether page furniture encloses a node; an article among comments is a comment."""
    while node.parent is not None:
        if node.kind in _OUT:
            return True
        names, role, _ = _names(node) if node.attributes else (set(), "", False)
        if names & BAD_NAMES or role in _ROLES:
            return True
        node = node.parent
    return False


def _boilerplate(pick: random.Random, texts: list[str], top: bool) -> str:
    """A block of page furniture with words of the corpus; page headers and footers only at the top level."""
    say = lambda n: " ".join(pick.choice(texts) for _ in range(pick.randint(1, n)))[:400]
    items = "".join(f'<li><a href="/{i}">{say(1)[:40]}</a></li>' for i in range(pick.randint(2, 6)))
    name = pick.choice(sorted(BAD_NAMES))
    second = pick.choice(["", "-box", " block", "_area", "-section", " container"])
    return pick.choice([
        f'<div class="{name}{second}"><p>{say(3)}</p></div>', f'<div id="{name}{second}"><ul>{items}</ul></div>',
        f"<aside><h3>{say(1)[:30]}</h3><p>{say(3)}</p></aside>", f"<aside><ul>{items}</ul></aside>",
        f'<section class="comments"><h2>{say(1)[:30]}</h2><div class="comment"><p>{say(4)}</p></div>'
        f'<article class="comment"><p>{say(4)}</p></article></section>',
        f'<form action="/s"><label>{say(1)[:30]}</label><input name="q"><button>{say(1)[:12]}</button></form>',
        f'<div class="{name}">{say(3)}</div>', f"<nav><ul>{items}</ul></nav>",
        f'<div role="{pick.choice(sorted(_ROLES))}"><p>{say(2)}</p></div>',
        *([f"<header><h1>{say(1)[:30]}</h1><p>{say(2)}</p></header>", f"<header><div>{say(1)[:40]}</div><p>{say(1)}</p></header>",
           f"<header><h1>{say(1)[:30]}</h1></header>", f"<footer><p>&copy; {say(2)}</p></footer>",
           f"<footer><div>{say(2)}</div><p>{say(1)}</p></footer>"] if top else [])])


def changed(page: str, pick: random.Random) -> tuple[list[Node], list[int]]:
    """A labelled copy of a page: with page furniture put in, and perhaps plain names for semantic elements."""
    texts = [t.strip() for t in re.findall(r">([^<>]{20,300})<", page)] or ["text"]
    spots = [m.end() for m in re.finditer(r"</(?:p|nav|div|article|h1|ul)>|<body[^>]*>", page)]
    spots += 3 * [m.end() for m in re.finditer(r"<body[^>]*>|</nav>|</article>", page)]  # most furniture stands there
    opened, closed = page.find("<article"), page.rfind("</article>")
    for spot in sorted({pick.choice(spots) for _ in range(pick.randint(0, 5))} if spots else (), reverse=True):
        page = page[:spot] + _boilerplate(pick, texts, not opened < spot <= closed) + page[spot:]
    nodes = parse(page)
    labels = mark(nodes)
    if pick.random() < 0.6:  # the labels stay, the elements that gave them away go
        for node in nodes:
            if node.tag in ("article", "main") and pick.random() < 0.8:
                node.tag, node.kind = "div", pick.choice(["div", "div", "section"])
                node.attributes = pick.choice(["", f' class="{pick.choice(sorted(GOOD_NAMES))}"', ' id="content"'])
            elif node.kind in _OUT and pick.random() < 0.4:
                named = {"nav": "nav", "aside": "sidebar", "header": "header", "footer": "footer", "form": "search"}[node.kind]
                node.tag, node.kind, node.attributes = "div", "div", f' class="{named}"'
    return nodes, labels


#: Pages that are always in the sample, written for this purpose: one plain, one of nested blocks.
BUILT_IN = [
    '<html><body><header><h1>Daily</h1><nav><a href="/">Home</a> <a href="/a">About</a></nav></header><main><article><h1>A river '
    "town</h1><p>The town lies on the river and has a market every week.</p><p>Visitors come by boat in summer, and by road in "
    'winter.</p></article></main><aside class="sidebar"><h3>More</h3><ul><li><a href="/x">Other towns</a></li></ul></aside>'
    "<footer>&copy; Daily</footer></body></html>",
    '<html><body><div class="nav"><ul><li><a href="/">Start</a></li></ul></div><article><header><h2>Bread</h2></header><div><p>Flour, '
    "water, salt and time are all that it takes to bake bread at home.</p><blockquote>It needs patience.</blockquote><ul><li>500 g of "
    'flour</li><li>350 g of water</li></ul></div></article><section class="comments"><article class="comment"><p>Great recipe, '
    'thank you so much for it!</p></article></section><div class="cookie-notice">We use cookies.</div></body></html>',
]


def train(pages: list[str], passes: int = PASSES) -> np.ndarray:
    """Parameters by gradient ascent on the labelled copies of the pages."""
    pick = random.Random(SEED)
    trees = []
    for page in [*BUILT_IN * 5, *pages]:
        nodes = parse(page)
        trees.append((nodes, mark(nodes)))
        trees += [changed(page, pick) for _ in range(COPIES)]
    weights, memory = np.zeros(SIZE), np.full(SIZE, 1e-6)
    for _ in range(max(passes, -(-STEPS // len(trees)))):
        pick.shuffle(trees)
        for nodes, labels in trees:
            if len(nodes) > 1:
                slope = gradient(nodes, labels, weights) - DECAY * weights
                memory += slope * slope
                weights = weights + RATE * slope / np.sqrt(memory)
    return weights


# ---------------------------------------------------------------- extraction
def main_text(page: str | None, weights: np.ndarray) -> str:
    """Blocks of the nodes whose content marginal is at least one half, in page order, one a line."""
    if not page:
        return ""
    nodes = parse(page)
    if len(nodes) == 1:
        return " ".join(entities.unescape("".join(t for _, t, _ in nodes[0].parts)).split())
    blocks: dict[int, list[str]] = {}
    for node, chance in zip(nodes, marginals(nodes, weights), strict=True):
        if chance >= 0.5:
            for block, text, _ in node.parts:
                blocks.setdefault(block, []).append(text)
    lines = (" ".join(entities.unescape("".join(blocks[b])).split()) for b in sorted(blocks))
    return "\n".join(x for x in lines if x)


def labelled(pages: DataFrame) -> DataFrame:
    """host, order (hash) of the pages with some node marked as content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            says = pa.array([any(mark(parse(t.as_py()))) for t in batch.column("html")], pa.bool_())
            yield batch.select(["host", "order"]).filter(says)
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    rows = pages.where(F.col("html").rlike(r"(?i)<(?:article|main)[\s/>]")).select(
        host.alias("host"), F.xxhash64("page_id", "html").alias("order"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "host string, order long")


def sampled(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """order, html of at most ``sample`` labelled pages: the least hashes of every host in turn.

    Each host keeps one page for each of ``sample`` slots before its pages are
    ranked, so that a hot host is not ranked in one task.
    """
    slots = labelled(pages).groupBy("host", F.pmod("order", F.lit(sample)).alias("slot")).agg(F.min("order").alias("order"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("order"))
    few = slots.withColumn("turn", turn).orderBy("turn", "order", "host").limit(sample).select("order").distinct()
    rows = pages.select(F.xxhash64("page_id", "html").alias("order"), F.col("html").cast("string").alias("html"))
    # the sample bounds the broadcast side; rows that repeat count once
    return rows.join(F.broadcast(few), "order").groupBy("order").agg(F.max("html").alias("html"))


def learn(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Train in one task on the sampled pages; only the parameters come back."""
    few = sampled(pages, sample)
    shape = SIZE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted(x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("order", "html")), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([train([x for _, x in own]).tolist()], pa.list_(pa.float64()))], ["weights"])
    rows = few.select("order", "html").coalesce(1).mapInArrow(run, "weights array<double>").collect()
    return np.array(rows[0]["weights"]) if rows else np.array(train([])).reshape(shape)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = learn(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py(), weights) for t in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
