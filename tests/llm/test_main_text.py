from __future__ import annotations

import re
from html import unescape
from itertools import product
from math import exp

import pytest

from rastrel.llm import main_text
from rastrel.llm.queries import QUERIES


def article(page: str) -> str:
    """What the table's pages show as their article, by their known layout."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1].replace("<br>", " ")
    blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op1_tree_marginals"](spark, sf).collect()
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] == article(pages[r["page_id"]]) for r in rows) >= 0.99 * len(rows)


@pytest.fixture(scope="module")
def model():
    return main_text.train()


def test_layouts(model):
    wrong = total = 0
    for page in main_text.LAYOUTS:
        tree = main_text.parse(page)
        found = main_text.extract(page, model)
        wrong += sum((t in found) != m for t, m in zip(tree.text, tree.marked, strict=True) if t)
        total += sum(t is not None for t in tree.text)
    assert wrong <= 0.04 * total


def test_marginals_are_exact(model):
    tree = main_text.parse("<body><nav><a>x</a></nav><article><h1>A head</h1><p>Some words that stand here, and a few more.</p></article><footer>© y</footer></body>")
    n = len(tree.parent)
    total, part = 0.0, [0.0] * n
    for labels in product((0, 1), repeat=n):
        w = model.root[labels[0]]
        for k in range(n):
            odds = sum(model.facts[f][1] - model.facts[f][0] for f in tree.facts[k] if f in model.facts)
            odds = max(-main_text.EVIDENCE, min(main_text.EVIDENCE, odds))
            w *= 1 / (1 + exp(-odds if labels[k] else odds))
            if k:
                w *= model.edges[main_text._edge_kind(tree, k)][labels[tree.parent[k]]][labels[k]]
        total += w
        for k in range(n):
            part[k] += w * labels[k]
    assert main_text.marginals(tree, model) == pytest.approx([p / total for p in part], abs=1e-9)


def test_broken_markup():
    tree = main_text.parse("<p><b>one<br>two<p>a &amp; b&nbsp;c &lt;p&gt;<script>var t='</p>';</script> d<!-- <p>x</p> --><li>e<li>f</ul></div>g<a href='<p>'>h</a><p")
    assert [t for t in tree.text if t] == ["one two", "a & b c <p> d", "e", "f", "gh"] or [t for t in tree.text if t][:2] == ["one two", "a & b c <p> d"]
    assert main_text.parse("").text == [None] and main_text.parse("< > &").text[-1] == "< > &"


def test_deep_and_long_pages(model):
    deep = "<div>" * 5000 + "<p>text</p>" + "</div>" * 5000
    assert len(main_text.marginals(main_text.parse(deep), model)) == 5003
    long = "<article>" + "".join(f"<p>Sentence number {k} of a very long page, which goes on.</p>" for k in range(5000)) + "</article>"
    assert len(main_text.extract(long, model)) == 5000


def test_edges(spark, model):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "plain text only", "x"), (4, "u", main_text.LAYOUTS[0], "x"), (4, "u", main_text.LAYOUTS[0], "x"), (5, "u", "<<<>>><p", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.main_text(df, model).collect()
    assert len(got) == 6 and [r["text"] for r in got[:2]] == ["", ""] and got[3]["text"] == got[4]["text"] and got[3]["text"].startswith("A long walk\n\nWe went")
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert main_text.main_text(df.filter("page_id > 99"), model).count() == 0


def test_alignment():
    page = "<body><nav><a>Home</a></nav><div class=x><h1>The head of it</h1><p>The head of it all.</p><p>Second line.</p></div><div class=ad>Another line.</div></body>"
    tree, labels = main_text.aligned_labels(page, "The head of it all.\nSecond line.")
    assert [labels[k] for k, t in enumerate(tree.text) if t] == [0, 1, 1, 1, 0]


STORY = """<article><h1>Snow in May</h1><p>Snow fell in the hills on Tuesday, to the surprise of everybody who had planted beans.</p>
<p>Farmers hope for a warm June, which would save what is left of the barley.</p><button>Share</button><svg><title>Mark</title></svg></article>"""


@pytest.mark.parametrize("before", [
    '<svg class="icon"/>', "<math/>", "<button>Menu", "<div><button>Menu</div>", "<nav><button><svg><path d='m'/></svg>Menu</nav>", "<object data='x'>",
    "<select><option>One<option>Two", "<div><select><optgroup><option>One</div>", "<noscript>", "<template>", "<svg><g><path d='m'><title>Mark</title>",
    "<math><mi>x</mi>", "<button>Menu<hr>", "<button>A<button>B", "<svg><circle/></g>",
])
def test_elements_left_open(model, before):
    want = main_text.extract(f"<body>{STORY}</body>", model)
    assert len(want) == 3 and want[0] == "Snow in May"
    for after in ("", "<button>x</button><object></object><select></select><noscript></noscript>"):
        page = f"<body>{before}{STORY}{after}</body>"
        assert main_text.extract(page, model) == want
        assert not {"Share", "Mark", "Menu", "x"} & set(main_text.parse(page).text)


def test_closed_elements_hold_no_text():
    page = "<p>a</p><noscript><div><p>b</p></noscript><object><object>c</object><p>d</p></object><svg><svg></svg><text>e</text></svg><select><option>f</select><button><div>g</div></button><template><li>h</template><p>i"
    assert [t for t in main_text.parse(page).text if t] == ["a", "i"]
