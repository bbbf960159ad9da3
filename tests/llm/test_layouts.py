"""Main text of layouts that no model was trained on: precision and recall per block."""

from __future__ import annotations

import pytest

from rastrel.llm import main_text
from rastrel.llm.queries import op1_tree_marginals

LONG = [
    "When the first settlers came to the valley they found a river full of fish and woods that reached down to the water.",
    "They built their houses from stone, because timber was needed for the boats, and some of these houses stand to this day.",
    "In the second year a flood took half of the fields, and many families moved up to the slopes, where the soil is poor but dry.",
]
NAV = '<div><a href="/">Home</a> <a href="/a">Archive</a> <a href="/c">Contact</a></div>'
FOOT = "<footer><p>Copyright by the village. All rights reserved.</p></footer>"
#: (page, blocks of the main text)
PAGES = {
    "plain divs": (f"<body>{NAV}" + "".join(f"<div>{x}</div>" for x in LONG) + f"{FOOT}</body>", LONG),
    "plain paragraphs": (f"<html><body>{NAV}" + "".join(f"<p>{x}</p>" for x in LONG) + "</body></html>", LONG),
    "heading and list": (f"<body>{NAV}<h1>Rules of the mill</h1><ul>" + "".join(f"<li>{x}</li>" for x in LONG) + f"</ul>{FOOT}</body>", ["Rules of the mill", *LONG]),
    "definitions": (f"<body>{NAV}<div><h1>Old words</h1><dl><dt>Weir</dt><dd>{LONG[0]}</dd><dt>Sluice</dt><dd>{LONG[1]}</dd></dl></div>{FOOT}</body>", ["Old words", "Weir", LONG[0], "Sluice", LONG[1]]),
    "table": (f"<body>{NAV}<div><h1>Floods</h1><p>{LONG[2]}</p><table><tr><th>Year</th><th>Height</th></tr><tr><td>1784</td><td>nine feet</td></tr></table></div>{FOOT}</body>", ["Floods", LONG[2], "Year", "Height", "1784", "nine feet"]),
    "poem": (f"<body>{NAV}<article><h1>The river</h1><p>The river runs,<br>the river sings,<br>and nobody knows<br>what tomorrow brings.</p><p>{LONG[0]}</p></article>{FOOT}</body>", ["The river", "The river runs, the river sings, and nobody knows what tomorrow brings.", LONG[0]]),
    "short article": (f"<body>{NAV}<article><h1>Closed</h1><p>The mill is closed on Monday.</p></article>{FOOT}</body>", ["Closed", "The mill is closed on Monday."]),
    "right to left": (f"<body>{NAV}<main dir=rtl><h1>הכפר הישן</h1><p>הכפר הישן עומד על גבעה קטנה ליד הנהר, והבתים שלו בנויים מאבן לבנה שהובאה מן ההרים.</p></main>{FOOT}</body>", ["הכפר הישן", "הכפר הישן עומד על גבעה קטנה ליד הנהר, והבתים שלו בנויים מאבן לבנה שהובאה מן ההרים."]),
    "chinese": (f"<body>{NAV}<article><h1>老村</h1><p>老村座落在河边的小山上,房子用从山里运来的白石建成,至今仍有许多家庭住在那里。</p></article>{FOOT}</body>", ["老村", "老村座落在河边的小山上,房子用从山里运来的白石建成,至今仍有许多家庭住在那里。"]),
    "unquoted": (f"<body>{NAV}<article><p>{LONG[0]}</p><img alt=Bob's src=x><p>{LONG[1]}</p><p title='it is \"so\"' class=a>{LONG[2]}</p></article>{FOOT}</body>", LONG),
    "comments": (f"<body>{NAV}<article><h1>The flood</h1><p>{LONG[0]}</p><p>{LONG[2]}</p></article><div class=comments><div class=comment><p>My family lived there and I have heard this story often.</p></div></div>{FOOT}</body>", ["The flood", LONG[0], LONG[2]]),
    "sidebar": (f"<body><header><h1>Village news</h1></header>{NAV}<main><h2>The flood</h2><p>{LONG[1]}</p><p>{LONG[2]}</p></main><aside class=sidebar><p>Read also how the mill was built again after the great fire.</p></aside>{FOOT}</body>", ["The flood", LONG[1], LONG[2]]),
}


@pytest.fixture(scope="module")
def model(spark):
    """As the registered query trains it."""
    held = {}
    original = main_text.main_text
    try:
        main_text.main_text = lambda pages, trained, **more: held.update(model=trained) or original(pages, trained, **more)
        op1_tree_marginals(spark, "/root/testdata/sf0.01")
    finally:
        main_text.main_text = original
    return held["model"]


def test_blocks_of_other_layouts(model):
    right = found = wanted = 0
    for name, (page, blocks) in PAGES.items():
        got = main_text.extract(page, model)
        assert got, name
        right += len(set(got) & set(blocks))
        found += len(got)
        wanted += len(blocks)
        print(name, [b for b in got if b not in blocks], [b for b in blocks if b not in got])
    print("precision", right / found, "recall", right / wanted)
    assert right / found >= 0.9 and right / wanted >= 0.9


@pytest.mark.parametrize("name", ["plain divs", "definitions", "table", "plain paragraphs", "unquoted", "right to left", "chinese", "poem", "short article"])
def test_whole_articles(model, name):
    page, blocks = PAGES[name]
    assert [b for b in main_text.extract(page, model) if b in blocks] == blocks


def test_values_without_quotes():
    tree = main_text.parse("<p class=it's id = \"a > b\">one</p><img alt=Bob's><p data-x='1 > 0' \" >two</p><a b='>three")
    assert [t for t in tree.text if t] == ["one", "two"]
