from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from rastrel.llm import line_quality, line_spread
from rastrel.llm.queries import QUERIES

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def plain(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), BLANK.sub(" ", line).strip(" "))


def spread(rows, least: int) -> Counter:
    sites, first = defaultdict(set), {}
    for r in rows:
        for line in (r["text"] or "").split("\n") if r["text"] is not None else []:
            if plain(line):
                sites[plain(line)].add(r["source"])
                if r["doc_id"] is not None:
                    first[plain(line)] = min(r["doc_id"], first.get(plain(line), r["doc_id"]))
    out = Counter()
    for r in rows:
        if r["text"] is None:
            out[r["doc_id"], None, 0] += 1
            continue
        lines = r["text"].split("\n")
        gone = [bool(plain(x)) and len(sites[plain(x)]) >= least and not (r["doc_id"] is not None and r["doc_id"] == first.get(plain(x))) for x in lines]
        out[r["doc_id"], "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), sum(gone)] += 1
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 10])
def test_spread_on_edges(edge_docs, least):
    got = line_spread.remove_spread_lines(edge_docs, least).select("row.doc_id", "text", "n_removed").collect()
    assert Counter(map(tuple, got)) == spread(edge_docs.collect(), least)


def test_spread_of_many_sites(spark):
    rows = [(k, f"shared by all\nby half {k % 2}\nin {k % 40}\nown {k}\n\nend", f"s{k % 300}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (8, 15, 150, 290):
        got = line_spread.remove_spread_lines(df, least).select("row.doc_id", "text", "n_removed").collect()
        assert Counter(map(tuple, got)) == spread(df.collect(), least)


def test_spread_of_nothing(no_docs):
    assert line_spread.remove_spread_lines(no_docs).count() == 0


def slow_measure(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def slow_judge(rows, least: int, share: float, left: float, most: int = line_quality.MOST_DOCUMENTS) -> list[tuple]:
    texts, totals = defaultdict(set), defaultdict(set)
    own = lambda t: [plain(x) for x in (t or "").split("\n") if plain(x)]
    for r in rows:
        totals[r["source"]].add(r["text"] or "")
        for x in own(r["text"]):
            texts[r["source"], x].add(r["text"])
    out = []
    for r in rows:
        m = slow_measure(r["text"])
        over = sum(len(x.replace(" ", "")) for x in own(r["text"]) if len(texts[r["source"], x]) > max(least, min(most, share * len(totals[r["source"]]))))
        base = m[0] < 10 or 100 * m[4] > 20 * m[0]
        out.append((r["doc_id"], *m, m[1] - over, base, not base and m[1] - over >= left * m[1]))
    return sorted(out, key=str)


def test_quality_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted(map(tuple, QUERIES["op10_line_quality"](spark, sf).collect()), key=str)
    assert got == slow_judge(rows, line_quality.MIN_DOCUMENTS, line_quality.MAX_SHARE, line_quality.MIN_LEFT)


def test_quality_on_edges(edge_docs, no_docs):
    got = sorted(map(tuple, line_quality.judge(edge_docs, 1, 0.1, 0.5).collect()), key=str)
    assert got == slow_judge(edge_docs.collect(), 1, 0.1, 0.5)
    assert line_quality.judge(no_docs).count() == 0


def test_depleted_documents_go(spark):
    bar = "one two three four five six seven eight nine ten eleven"
    rows = [(k, f"{bar}\n{'own words here ' + str(k) if k % 2 else 'x' + str(k)}", "h") for k in range(50)] + [(99, bar + f"\nalone {'z' * 400}", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in line_quality.judge(df, 5, 0.02, 0.2).collect()}
    assert kept[99] and not kept[2] and kept[1]


def test_limit_of_a_hot_host(spark):
    """A host a thousand times larger than the others has the same limit in documents from a size on."""
    bar = "this line stands on many pages of one host and says nothing new"
    rows = [(k, f"own text {k} of this page\n" + (bar if k < 60 else ""), "hot") for k in range(5000)]
    rows += [(9000 + k, f"own text {k} of this page\n" + (bar if k < 4 else ""), f"s{k % 5}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (50, 1000):
        got = sorted(map(tuple, line_quality.judge(df, 3, 0.02, 0.6, most).collect()), key=str)
        assert got == slow_judge(df.collect(), 3, 0.02, 0.6, most)
        assert sum(r[6] < r[2] for r in got) == (60 if most == 50 else 0)


def test_repeated_windows_of_many_words():
    words = [b"%d" % (k * k % 5003) for k in range(9000)] + [b"a b c d e f".split()[k % 6] for k in range(40)]
    text = b" ".join(words)
    assert line_quality.repeated_words(words) == slow_measure(text.decode())[4]
