"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: elements are inner nodes, runs of text between block tags are leaves. Every node is content or not. Node
potentials weigh tag, class and id words of elements, and length, links and ending of text; parent-child potentials weigh the two
labels of an edge. Sum-product messages pass once upward and once downward, which is exact on a tree, and give each leaf its
marginal; leaves more likely content than not are the main text. All potentials are smoothed counts over labelled pages: a bounded
sample of pages whose text is known, and a few labelled layouts kept here for parts the sample may lack.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages taken from a table at most, and how many times their weight the layouts kept here have together.
SAMPLE, LAYOUTS_WEIGH = 400, 3.0
#: The facts of one node weigh this much in log odds at most, so that its neighbours can outweigh them.
EVIDENCE = 6.0
#: A block with over this many words and no link is running text.
RUNNING = 12
#: From this probability on running text is taken for the main text of a page that has no likelier one.
POSSIBLE = 0.05
PRIOR = 0.5

#: The kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea".split())
#: Elements that never hold main text, with the elements that are their own parts.
APART = {
    "noscript": frozenset(), "template": frozenset(), "object": frozenset(), "button": frozenset(),
    "select": frozenset("option optgroup".split()),
    "svg": frozenset("g defs symbol path rect circle ellipse line polyline polygon text tspan title desc style use mask filter marker pattern stop "
                     "lineargradient radialgradient clippath foreignobject image animate".split()),
    "math": frozenset("mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mstyle semantics "
                      "annotation annotation-xml mpadded mphantom menclose mmultiscripts".split()),
}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var".split())
#: Opening the key closes an open element of the values, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table body html article section main div".split())
#: These say nothing by themselves: one without class, id and role is not weighed like those that have names.
GENERIC = frozenset("div section".split())
SPACE = re.compile(r"[\s ]+")
#: Quotes enclose a value only right after the sign of equality; elsewhere, as in alt=Bob's, they are ordinary characters.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=(?!\s*[\"'])[^\s>]*)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S | re.I)
MARKED = re.compile(r"(?:^|\s)data-main(?:\s|=|$)")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """Nodes in page order, parents first. Leaves have a text; ``facts`` are what the node potentials weigh."""

    parent: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    facts: list[list[str]] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)

    def add(self, parent: int, text: str | None, facts: list[str], marked: bool) -> int:
        self.parent.append(parent)
        self.text.append(text)
        self.facts.append(facts)
        self.marked.append(marked)
        return len(self.parent) - 1


def _step(value: float, steps: tuple[float, ...]) -> int:
    return sum(value > s for s in steps)


def _leaf_facts(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    closed, sign = text[-1] in ".!?:;…»”\"", "©" in text[:9] or " | " in text or " · " in text
    return [f"words:{_step(words, (1, 3, 6, 12, 25, 60))}", f"links:{_step(linked / len(text), (0.0, 0.3, 0.7))}", f"closed:{closed}", f"sign:{sign}"]


def _raw_end(page: str, name: str, at: int) -> int:
    end = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
    return end.end() if end else len(page)


def _apart_ends(page: str) -> dict[int, int]:
    """Where each element of APART ends, by the end of its start tag: after its own end tag, or, if its container or the page ends
    before that, at the first tag that is neither inline nor one of its parts. Elements that close themselves end at once."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depths: Counter = Counter()  # of each name on the stack
    whole: list[int] = []  # places on the stack of the elements of APART that no such tag has followed so far
    at = 0
    while token := TOKEN.search(page, at):
        at = token.end()
        name = (token[2] or "").lower()
        if not name or name in INLINE or name in VOID and name != "hr":
            continue
        if whole:
            held = {stack[k][0] for k in whole}
            own = name in APART[stack[whole[-1]][0]]
            if not (own or (name in held if token[1] else name in APART and name not in held)):
                for k in whole:
                    ends[stack[k][1]] = token.start()
                whole.clear()
        if token[1]:
            while depths[name]:
                last, start = stack.pop()
                depths[last] -= 1
                if whole and whole[-1] == len(stack):
                    whole.pop()
                    ends[start] = token.start()
                if last == name:
                    if name in APART:
                        ends[start] = at
                    break
        elif name in RAW:
            at = _raw_end(page, name, at)
        elif (token[3] or "").endswith("/"):
            if name in APART:
                ends[at] = at
        elif name not in VOID:
            if name in APART:
                whole.append(len(stack))
            stack.append((name, at))
            depths[name] += 1
    for k in whole:
        ends[stack[k][1]] = len(page)
    return ends


def parse(page: str) -> Tree:
    """The tree of a page. Markup left open is closed where its container ends; stray end tags are passed over. Elements of APART give no
    nodes; one that is never closed takes along what it begins with, not the blocks after it."""
    tree = Tree()
    root = tree.add(-1, None, ["tag:#page"], False)
    stack: list[tuple[str, int, bool]] = [("#page", root, False)]
    run: list[str] = []
    linked, links = 0, 0
    at = 0
    apart: dict[int, int] | None = None

    def flush() -> None:
        nonlocal linked
        if run:
            text = SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                tree.add(stack[-1][1], text, _leaf_facts(text, linked), stack[-1][2])
            run.clear()
        linked = 0

    while True:
        token = TOKEN.search(page, at)
        said = page[at : token.start() if token else len(page)]
        if said:
            run.append(said)
            linked += len(said) if links else 0
        if token is None:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name in RAW and not token[1]:
            at = _raw_end(page, name, at)
        elif name in APART:
            if not token[1]:
                if apart is None:
                    apart = _apart_ends(page)
                at = apart[at]
        elif name == "br":
            run.append(" ")
        elif name in INLINE:
            if name == "a":
                links = max(0, links - 1) if token[1] else 1
        elif name in VOID:
            if name == "hr":
                flush()
        elif token[1]:
            flush()
            links = 0
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                del stack[depth:]
        else:
            flush()
            links = 0
            if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and len(stack) > 1:
                stack.pop()
            while stack[-1][0] in CLOSES.get(name, ()) and stack[-1][0] not in CONTAINERS:
                stack.pop()
            attributes = token[3] or ""
            named = {w.lower() for m in NAMED.finditer(attributes) for w in WORD.findall(m[2] or m[3] or m[4] or "")}
            marked = stack[-1][2] or bool(MARKED.search(attributes))
            kind = f"{name}-plain" if name in GENERIC and not named else name
            node = tree.add(stack[-1][1], None, [f"tag:{kind}", f"in:{stack[-1][0]}>{kind}", *(f"name:{w}" for w in sorted(named))], marked)
            if not attributes.endswith("/"):
                stack.append((name, node, marked))
    flush()
    return tree


#: Labelled layouts: what stands under data-main is the main text.
LAYOUTS = (
    """<html><head><title>x</title></head><body><header class="site-header"><h1>Site name</h1><p>The best site of all.</p></header><nav class="menu"><ul><li><a>Home</a></li>
    <li><a>About us</a></li></ul></nav><main data-main><h1>A long walk</h1><p>We went up the hill in the early morning, when the air was still cold and clear.</p><h2>Back</h2>
    <p>Going down took us twice the time.</p><ul><li>Take water.</li><li>Take a good map, and somebody who can read it.</li></ul><blockquote>It was far.</blockquote></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a>More walks</a></li></ul><p>Read also what others have written about the hill last year.</p></aside>
    <footer class="footer"><p>Copyright 2020 by the site. All rights reserved.</p></footer></body></html>""",
    """<body><div id="top" class="header banner"><a>Home</a> | <a>News</a></div><div class="notice cookie-banner"><p>We use cookies to make this site better. By going on you agree.</p></div>
    <div id="content" class="content"><article data-main><h1>Rain</h1><p class="lead">It has rained for three days now, and the river is rising by the hour.</p><p>Nobody can say how long it will last.</p>
    <p>The bridge was closed at noon.</p><pre>level 4 m</pre></article><div class="advert ads sponsored"><p>Buy our umbrellas, the strongest in town, for half the price.</p></div>
    <section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>I live near the bridge and it was a sight to see, the whole night long.</p></div><div class="comment reply"><p>So do I.</p></div>
    <form class="comment-form"><p>Leave a reply</p><label>Your name</label></form></section></div><div class="footer bottom"><p>Contact us | Terms | Privacy</p></div></body>""",
    """<body><div class="nav navigation breadcrumb"><a>Home</a> &gt; <a>Cooking</a></div><div class="post entry-content" data-main><h1>Soup</h1><p>Peel the potatoes, cut them into small pieces and boil them until they are soft.</p>
    <table><tr><td>Potatoes</td><td>five</td></tr></table><p>Serve it hot.</p></div><div class="share social"><a>Share</a><a>Tweet</a></div><div class="related recommended"><h3>You may like</h3><p><a>Another soup of the season</a></p></div>
    <div class="widget newsletter subscribe"><p>Sign up for our letter and get a new soup every week.</p><form><p>Your mail address</p></form></div>
    <div id="disqus_thread" class="discussion"><p>I have cooked this soup on Sunday and all the children liked it.</p></div><footer><p>Made with love.</p></footer></body>""",
    """<body><section class="promo ad"><p>Great offers on everything you ever wanted, only today and only here.</p></section><section class="alert warning message"><p>This site will be closed for repairs on Sunday night.</p></section>
    <section class="article-body story text" data-main><div><p>The council met on Monday to talk about the new school.</p></div><div><p>After four hours it had decided nothing.</p><h3>Next steps</h3>
    <p>It meets again in May.</p></div></section><section class="reviews user-comments responses"><div><p>They never decide anything at all, and nobody is surprised by it any more.</p></div></section>
    <aside><p>The council has nine members, elected every four years by all citizens.</p></aside><form class="search"><p>Search this site</p></form><div class="legal copyright"><p>© The paper</p></div></body>""",
    """<html><body><div class="wrapper container"><header id="masthead"><div class="logo"><a>The Daily</a></div><nav class="navbar"><ul class="menu"><li><a>World</a></li><li><a>Sport</a></li></ul></nav></header>
    <article><h1 class="title headline" data-main>Snow in May</h1><p data-main>Snow fell in the hills on Tuesday, to the surprise of everybody who had planted beans.</p>
    <p data-main>The beans are lost.</p><div class="ad advertisement"><p>Beans of the best kind, sent to your door.</p></div><p data-main>Farmers hope for a warm June, which would save what is left of the barley.</p>
    <aside class="related-links"><h4>More</h4><p>Snow was last seen in May forty years ago.</p></aside><footer class="article-footer tags"><a>snow</a> <a>hills</a></footer>
    <section class="comments-area" id="respond"><h3>3 comments</h3><ol class="comment-list"><li class="comment"><p>We lost all our tomatoes too, and the roses as well, it is a shame.</p></li>
    <li class="comment"><p>First!</p></li></ol><form class="comment-respond"><p>Write a comment</p></form></section></article>
    <div id="secondary" class="widget-area sidebar"><section class="widget"><h2>Most read</h2><ul><li><a>Rain in June</a></li></ul></section></div>
    <footer id="colophon" class="site-footer"><div class="site-info">The Daily, printed since 1900 in the old town.</div></footer></div></body></html>""",
    """<body><div class="topbar notice alert"><p>Our office is closed on Friday, please call again on Monday morning.</p></div><div role="navigation"><a>Start</a> <a>Guides</a></div>
    <div class="modal popup" id="newsletter"><h2>Stay in touch</h2><p>Get one letter a month, no more than that.</p><form class="signup"><label>Mail</label></form></div>
    <div role="main" id="main"><div class="page-content body" data-main><h1>How to mend a tyre</h1><h2>Find the hole</h2><p>Pump the tyre up and hold it under water: where bubbles rise, there is the hole.</p>
    <dl><dt>Small hole</dt><dd>Use a patch.</dd></dl><h2>Close it</h2><ol><li>Dry the place and make it rough.</li><li>Wait five minutes.</li></ol><table><tr><th>Size</th><td>28</td></tr></table></div>
    <div class="pagination pager"><a>Previous</a><a>Next</a></div><div class="toc"><ul><li><a>Find the hole</a></li><li><a>Close it</a></li></ul></div></div>
    <div role="complementary" class="banner sponsor promotion"><p>This guide was paid for by a maker of tyres and patches.</p></div>
    <div class="feedback responses"><p>It took me four attempts, but now the tyre holds and I can ride again.</p></div><div role="contentinfo"><p>Imprint and privacy</p></div></body>""",
)


def _labels(tree: Tree, content: list[bool]) -> list[int]:
    """Labels of all nodes from those of the leaves: an element is content if over a third of its characters are, so an article stays
    one under long comments."""
    weight = [0] * len(tree.parent)
    for k in range(len(tree.parent) - 1, -1, -1):
        if tree.text[k] is not None:
            weight[k] = 2 * len(tree.text[k]) if content[k] else -len(tree.text[k])
        if k:
            weight[tree.parent[k]] += weight[k]
    return [int(w > 0) for w in weight]


def marked_labels(page: str) -> tuple[Tree, list[int]]:
    tree = parse(page)
    return tree, _labels(tree, tree.marked)


def aligned_labels(page: str, main: str) -> tuple[Tree, list[int]]:
    """Labels from the known text: leaves that are lines of it, or its beginning (a heading), point to the element that holds most of
    them and least else; inside it, leaves are content unless they are long and not in the known text."""
    tree = parse(page)
    lines = {SPACE.sub(" ", x).strip() for x in main.split("\n")}
    start = SPACE.sub(" ", main).strip()
    found = [t is not None and (t in lines or start.startswith(t)) for t in tree.text]
    score = [0 if t is None else len(t) if f else -len(t) for t, f in zip(tree.text, found, strict=True)]
    for k in range(len(score) - 1, 0, -1):
        score[tree.parent[k]] += score[k]
    best = max((k for k, t in enumerate(tree.text) if t is None), key=lambda k: score[k])
    inside = [False] * len(score)
    for k in range(len(score)):
        inside[k] = score[best] > 0 and (k == best or k > 0 and inside[tree.parent[k]])
    return tree, _labels(tree, [i and (f or len(t or "") <= 80) for i, f, t in zip(inside, found, tree.text, strict=True)])


#: Edges differ by where they hang: under the page's frame, under other elements, and from an element to its own text.
FRAME = frozenset({"tag:#page", "tag:html", "tag:body"})


def _edge_kind(tree: Tree, k: int) -> int:
    if tree.text[k] is not None:
        return 2
    return int(tree.facts[tree.parent[k]][0] not in FRAME)


@dataclass(frozen=True)
class Model:
    """Log potentials of facts by label; potentials of edges by kind and both labels, and of the root."""

    facts: dict[str, tuple[float, float]]
    edges: tuple[tuple[tuple[float, float], tuple[float, float]], ...]
    root: tuple[float, float]


def fit(labelled: list[tuple[Tree, list[int], float]]) -> Model:
    """Potentials from trees with labels and weights, as smoothed relative frequencies."""
    facts: tuple[Counter, Counter] = (Counter(), Counter())
    kinds: tuple[Counter, Counter] = (Counter(), Counter())
    edges, root = [[[PRIOR, PRIOR], [PRIOR, PRIOR]] for _ in range(3)], [PRIOR, PRIOR]
    for tree, labels, weight in labelled:
        for k, y in enumerate(labels):
            for f in tree.facts[k]:
                facts[y][f] += weight
                kinds[y][f.partition(":")[0]] += weight
            if k:
                edges[_edge_kind(tree, k)][labels[tree.parent[k]]][y] += weight
            else:
                root[y] += weight
    names = set(facts[0]) | set(facts[1])
    many = Counter(f.partition(":")[0] for f in names)
    value = {}
    for f in names:
        kind = f.partition(":")[0]
        value[f] = tuple(log((facts[y][f] + PRIOR) / (kinds[y][kind] + PRIOR * many[kind])) for y in (0, 1))
    return Model(value, tuple(tuple(tuple(x / sum(row) for x in row) for row in edge) for edge in edges), tuple(x / sum(root) for x in root))


def marginals(tree: Tree, model: Model) -> list[float]:
    """The probability that a node is content, by one upward and one downward pass."""
    n = len(tree.parent)
    edges = [model.edges[_edge_kind(tree, k)] if k else None for k in range(n)]
    own0, own1 = [1.0] * n, [1.0] * n  # node potential times the messages of the children so far
    up0, up1 = [1.0] * n, [1.0] * n  # message to the parent
    for k in range(n):
        d = 0.0
        for f in tree.facts[k]:
            w = model.facts.get(f)
            if w:
                d += w[1] - w[0]
        d = max(-EVIDENCE, min(EVIDENCE, d))
        own1[k] = 1 / (1 + exp(-d))
        own0[k] = 1 - own1[k]
    own0[0], own1[0] = own0[0] * model.root[0], own1[0] * model.root[1]
    for k in range(n - 1, 0, -1):
        (e00, e01), (e10, e11) = edges[k]
        a, b = e00 * own0[k] + e01 * own1[k], e10 * own0[k] + e11 * own1[k]
        up0[k], up1[k] = a / (a + b), b / (a + b)
        p = tree.parent[k]
        a, b = own0[p] * up0[k], own1[p] * up1[k]
        own0[p], own1[p] = max(a / (a + b), 1e-300), max(b / (a + b), 1e-300)
    out = [0.0] * n
    down0, down1 = [1.0] * n, [1.0] * n
    for k in range(n):
        if k:
            p = tree.parent[k]
            (e00, e01), (e10, e11) = edges[k]
            # what the parent knows without this child
            a, b = down0[p] * own0[p] / up0[k], down1[p] * own1[p] / up1[k]
            a, b = a * e00 + b * e10, a * e01 + b * e11
            down0[k], down1[k] = a / (a + b), b / (a + b)
        a, b = own0[k] * down0[k], own1[k] * down1[k]
        out[k] = b / (a + b)
    return out


def extract(page: str | None, model: Model) -> list[str]:
    """The main text's blocks in page order."""
    if not page:
        return []
    tree = parse(page)
    found = marginals(tree, model)
    running = [p for t, p, f in zip(tree.text, found, tree.facts, strict=True) if t is not None and t.count(" ") >= RUNNING and f[1] == "links:0"]
    # where no block is likely but running text is possible, the likeliest of it bounds what is content
    top = max(running, default=0.0)
    least = top / 5 if POSSIBLE <= top < 0.5 else 0.5
    return [t for t, p in zip(tree.text, found, strict=True) if t is not None and p > least]


def train(labelled: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """From the layouts kept here and, if given, at most ``sample`` rows (html, main) whose main text is known, chosen by a hash."""
    trees: list[tuple[Tree, list[int], float]] = []
    if labelled is not None:
        rows = labelled.select("html", "main").filter("html IS NOT NULL AND main IS NOT NULL")
        for r in rows.orderBy(F.xxhash64("html"), "html", "main").limit(sample).collect():
            trees.append((*aligned_labels(r["html"], r["main"]), 1.0))
    weight = max(20.0, LAYOUTS_WEIGH * len(trees) / len(LAYOUTS))
    return fit(trees + [(*marked_labels(x), weight) for x in LAYOUTS])


def main_text(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` (blocks joined by two line ends), ``n_blocks`` and ``n_chars`` for every row.

    Null and empty pages, and pages without content, have the empty text. Character references are decoded, white space inside a block
    is one blank, and nothing is cut off however long the page. Repeated rows are treated each; other columns are not read.
    """
    rows = pages.select(*keep, F.col("html").alias("_page"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(p.as_py(), shared.value) for p in batch.column(len(keep))]
            texts = ["\n\n".join(x) for x in found]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, found), pa.int64()), pa.array(map(len, texts), pa.int64())],
                names=[*keep, "text", "n_blocks", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_blocks long, n_chars long")
