"""Cross-tokenizer alignment against a plain version with the two libraries, and the perfect hash against its definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rastrel.llm import cross_tokens as c
from rastrel.llm.queries import BYTES, PIECES


@pytest.fixture(scope="module")
def given(spark):
    return c.load(spark, f"file://{BYTES}", f"file://{PIECES}")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def groups_of(text, libraries):
    a, b = libraries
    alphabet = c.byte_alphabet()
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    xs = [bytes(alphabet[ch] for ch in a.id_to_token(i)) for i in x]
    ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i in y for p in [b.id_to_piece(i)]]
    if not text or not b"".join(xs) == (" " + text).encode() == b"".join(ys):
        return []
    ends = [set(np.cumsum(list(map(len, z))).tolist()) for z in (xs, ys)]
    out, at = [([], [])], 0
    cuts = sorted(ends[0] & ends[1])
    place = {e: k for k, e in enumerate(cuts)}
    out = [([], []) for _ in cuts]
    for ids, parts, side in ((x, xs, 0), (y, ys, 1)):
        at = k = 0
        for i, p in zip(ids, parts):
            at += len(p)
            out[k][side].append(i)
            if at in place:
                k += 1
    return out


def slow(rows, libraries):
    found = [(i, groups_of(t or "", libraries)) for i, t in rows]
    count = Counter()
    for _, groups in found:
        count.update({(p, q) for x, y in groups for p in x for q in y})
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for i, groups in found:
        links = [(p, q) for x, y in groups for p in x for q in y]
        mark = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(mark.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def fast(docs, given, **more):
    return sorted(map(tuple, c.align(docs, given, **more).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_table(spark, sf, given, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert fast(docs, given) == slow([(r.doc_id, r.text) for r in docs.collect()], libraries)


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41> stay text", "a\u2581b", "tab\tand\r\nline;\r\n ends \n\n  here  ", "\u00a0hard\u00a0 blank\u3000wide \u2028", "\x00\x1c\x1f\x85 x",
    "it's we'll 'tis I'd  they 've", "\U0001f600\U0001f468\u200d\U0001f469\u200d\U0001f467 \u0939\u093f\u0928\u094d\u0926\u0940 \u6f22\u5b57\u3068 \u0e44\u0e17\u0e22 \u05e9\u05dc\u05d5\u05dd", " ", "\n", "  lead", "trail  ", "=" * 3000, "ab" * 2000,
    "x" * 20_000, "\u00e9" * 3000, " " * 500 + "z", "1234567890 " * 50, "\t".join("abc"), "a" + "\u0301" * 200, "\ufeffbom", "don\u2019t \u201cquote\u201d",
]


def test_odd_texts(spark, given, libraries):
    draw = random.Random(3)
    alphabet = "ab cdE\n\t\r .,;'1\u00e9\u00df\u2581\u00a0\u6f22\U0001f600\u0301"
    texts = ODD + ["".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(300)] + ["".join(chr(draw.choice([draw.randint(1, 0x24FF), draw.randint(32, 126)])) for _ in range(40)) for _ in range(300)]
    rows = list(enumerate(texts))
    assert fast(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), given) == slow(rows, libraries)


def test_edges(spark, edge_docs, no_docs, given, libraries):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert fast(edge_docs, given) == slow(rows, libraries)
    assert fast(no_docs, given) == []


def test_blocks_tree_and_restarts(spark, sf, given, libraries, monkeypatch):
    """Several blocks of the index, a tree of many levels and workers that start again give the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(7)
    want = slow([(r.doc_id, r.text) for r in docs.collect()], libraries)
    assert fast(docs, given, pairs_per_block=3000) == want
    pairs = c.written(c.counted_pairs(docs, given), "pairs")
    tables = [{r.bucket: tuple(r) for r in c.pair_index(pairs, fan).collect()} for fan in (2, 32)]
    assert tables[0] == tables[1]


def test_forgetting(given, libraries, sf, spark):
    """An aligner that is cleared between texts reads them as one that isn't."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own = c.Aligner(given)
    kept = [own.text[k] for k in own.read(texts)[0]]
    again = []
    for t in texts:
        own.clear()
        again += [own.text[k] for k in own.read([t])[0]]
    assert kept == again and own.cuts and own.fast


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 1 << 47, 2 * n).astype(np.uint64))[:n]
    bucket = c.bucket_of(keys)
    rows, order = [], []
    for b in np.unique(bucket):
        sizes, bits, own = c.perfect_hash(keys[bucket == b])
        assert sorted(own.tolist()) == sorted(keys[bucket == b].tolist())
        rows.append((int(b), sizes.tobytes(), bits.tobytes(), own.tobytes()))
        order += own.tolist()
    index = c.Index(rows)
    places = index.find(np.array(order, np.uint64))
    assert places.tolist() == list(range(len(keys)))
    others = np.setdiff1d(draw.integers(0, 1 << 47, 1000).astype(np.uint64), keys)
    assert (index.find(others) == -1).all()


def test_a_word_is_one_stretch_whatever_sign_follows(given, libraries):
    own = c.Aligner(given)
    text = "word, word. word### (word) don't f(x)=a_b;c\\d 12.5% Zürich: \u00b2\u2173x, ~a~ [b]"
    parts = own.stretches(text)
    assert "".join(parts) == " " + text and parts.count(" word") == 3 and parts.count(" (word") == 1
    groups = groups_of(text, libraries)
    assert ";".join(own.text[k] for k in own.read([text])[0]) == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
