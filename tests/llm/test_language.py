from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from rastrel.llm import language
from rastrel.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_language_back_off"](spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in unseen]) > 0.97


def test_edges(edge_docs, no_docs):
    model = language.fit(edge_docs)
    rows = language.predict(edge_docs, model).select("row.doc_id", "row.text", "row.lang_pred", "lang_pred", "score").collect()
    assert len(rows) == 13
    for r in rows:
        if not any(c.isalpha() for c in r[1] or ""):
            assert (r[3], r[4]) == ("und", 0.0)
        else:
            assert r[3] in model.languages and 0 < r[4] <= 1 and r[2] == "x"
    assert {r[3] for r in rows if r[1] and "está" in r[1]} == {"es"}
    assert language.predict(no_docs, model).count() == 0


def test_no_labels(edge_docs, no_docs):
    model = language.fit(no_docs)
    assert model.languages == [] and {r["lang_pred"] for r in language.predict(edge_docs, model).collect()} == {"und"}


def test_words_first_then_shorter_grams():
    words, word_weights = language._weights([language.Counter({"haus": 9, "der": 1}), language.Counter({"house": 9, "the": 1})])
    tables = [language._weights([language.Counter({g: 1 for w in own for g in language.grams(w, n)}) for own in (("haus",), ("house",))]) for n in range(1, 6)]
    scorer = language.Scorer(language.Model(["de", "en"], words, word_weights, [t[0] for t in tables], [t[1] for t in tables]))
    assert scorer.predict("haus haus")[0] == "de" and scorer.predict("The")[0] == "en"
    assert scorer.predict("hausen")[0] == "de" and scorer.predict("houses")[0] == "en"  # by long n-grams
    assert scorer.predict("xau")[0] == "de" and scorer.predict("ößü")[0] == "de"  # by short ones; of equal ones the first
    assert np.allclose(scorer.back_off("hausen"), scorer.model.gram_weights[4][[scorer.model.grams[4][g] for g in ("^haus",)]].mean(0))


def test_sample_is_bounded(spark):
    rows = [(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} other", "xx" if k % 3 else "yy") for k in range(3000)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), documents=100)
    assert model.languages == ["xx", "yy"] and 100 < len(model.words) <= 300


def test_rare_words_count(spark):
    """No word of the sample is left out, however many there are."""
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:5]]  # 40 000
    rows = [(" ".join(words[k : k + 100]) + (" zzyzx" if k == 0 else ""), "xx") for k in range(0, len(words), 100)] + [("andere worte", "yy")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.words) == 40_003 and "zzyzx" in model.words and "^zzyz" in model.grams[4]


def test_letters_and_marks():
    assert language.words_of("हिन्दी में, ไทยที่ ½ Ⅷ 12 a1b é e\u0301x _x_") == {"हिन्दी": 1, "में": 1, "ไทยที่": 1, "a": 1, "b": 1, "é": 1, "e\u0301x": 1, "x": 1}
    assert language.words_of("\u0301½ ①٣") == {}
    long = "ab" * (1 << 20) + " cd"
    assert language.words_of(long) == {"ab" * (1 << 20): 1, "cd": 1}


def plain(rows, texts):
    """Fit and score in plain Python: relative frequencies with half a count more for everything known."""
    import regex

    found = (lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower()))
    languages = sorted({lang for _, lang in rows})

    def logs(counts):
        keys = set().union(*counts)
        return {k: [math.log((c.get(k, 0) + 0.5) / (sum(c.values()) + 0.5 * len(keys))) for c in counts] for k in keys}

    own = [Counter(w for t, lang in rows if lang == x for w in found(t)) for x in languages]
    words = logs(own)

    def parts(w, n):
        w = f"^{w}$" if n > 1 else w
        return [w[k : k + n] for k in range(len(w) - n + 1)]

    tables = []
    for n in range(1, 6):
        counts = [Counter() for _ in languages]
        for c, o in zip(counts, own):
            for w, k in o.items():
                for g in parts(w, n):
                    c[g] += k
        tables.append(logs(counts))
    out = []
    for t in texts:
        total, n = [0.0] * len(languages), 0
        for w in found(t):
            n += 1
            score = words.get(w)
            for size in range(5, 0, -1):
                if score is None and (known := [tables[size - 1][g] for g in parts(w, size) if g in tables[size - 1]]):
                    score = [sum(x) / len(known) for x in zip(*known)]
            total = [a + b for a, b in zip(total, score or [0.0] * len(languages))]
        if not n:
            out.append(("und", 0.0))
            continue
        best = max(range(len(languages)), key=lambda k: (round(total[k], 9), -k))
        share = [math.exp((x - total[best]) * min(n, 20) / n) for x in total]
        out.append((languages[best], share[best] / sum(share)))
    return out


def test_table_by_plain_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    learn = [(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] is not None and r["lang"] is not None]
    got = {r["doc_id"]: r for r in QUERIES["op5_language_back_off"](spark, sf).collect()}
    for r, (lang, score) in zip(rows, plain(learn, [r["text"] for r in rows]), strict=True):
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - score) < 1e-6
