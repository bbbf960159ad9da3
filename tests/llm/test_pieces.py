from __future__ import annotations

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rastrel.llm import pieces
from rastrel.llm.queries import PIECES

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model(spark):
    return pieces.load_model(spark, f"file://{PIECES}")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


ODD = ["", " ", "  a   b ", "\n\n\t", "aaaaaaaa", "日本語の テスト", "🎉🎉 é", "=====-----((((", " " * 40, "a" * 300, "Ünïcödé\x00\x7f", "​", "1234567890 12:30", "</s><s><unk>"]


@pytest.mark.parametrize("text", ODD)
def test_same_numbers_as_the_library(model, library, text):
    machine = pieces.Transducer(model)
    ids = list(machine.encode(text))
    assert ids == library.encode(text) and machine.decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.sampled_from("the anding ofre\nst.,é▁ 日x"), max_size=40))
def test_same_numbers_on_any_text(model, library, text):
    machine = pieces.Transducer(model)
    assert list(machine.encode(text)) == library.encode(text)
    assert machine.decode(machine.encode(text)) == text.replace("▁", " ") or "▁" in text


def test_table_round_trip(spark, sf, model, library):
    rows = pieces.encode(spark.read.parquet(f"{sf}/documents.parquet"), model, ("doc_id", "text")).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["ids"] == library.encode(r["text"]) and r["n_ids"] == len(r["ids"]) and r["round_trip"]


def test_edges(edge_docs, no_docs, model, library):
    rows = pieces.encode(edge_docs, model, ("doc_id", "text")).collect()
    assert [r["ids"] for r in rows] == [library.encode(r["text"] or "") for r in rows] and all(r["round_trip"] for r in rows) and len(rows) == 13
    assert pieces.encode(no_docs, model).count() == 0
    with pytest.raises(ValueError, match="clash"):
        pieces.encode(edge_docs, model, ("ids",))


def test_decode_rows(spark, model, edge_docs):
    back = pieces.decode(pieces.encode(edge_docs, model, ("doc_id", "text")), model).select("row.text", "text").collect()
    assert all((r[0] or "") == r[1] for r in back)
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), model).first()["text"] is None


def test_long_parts_are_cut_where_none_crosses(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 50)
    text = "some words and then averyveryverylongwordthatneverseemstoendatallbecauseithasnoblanks 日本 " * 5
    assert list(pieces.Transducer(model).encode(text)) == library.encode(text)


TOY = pieces.Model(pieces.UNIGRAM, [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("▁a", -2.2, 1), ("ba", -2.9, 1), ("aba", -5.5, 1), ("b▁", -3.3, 1)])


@pytest.mark.parametrize("text", ["".join(x) for n in range(6) for x in product("ab ", repeat=n)])
def test_least_weight_of_all_paths(text):
    machine = pieces.Transducer(TOY)
    plain = machine.normalise(text)

    def paths(at):
        if at == len(plain):
            yield 0.0
        for k in range(at + 1, len(plain) + 1):
            if plain[at:k] in machine.weight:
                for rest in paths(k):
                    yield machine.weight[plain[at:k]] + rest

    ids = machine.encode(text)
    assert "".join(TOY.pieces[i][0] for i in ids) == plain
    assert sum(-TOY.pieces[i][1] for i in ids) == pytest.approx(min(paths(0)))


def test_unknown_without_bytes():
    machine = pieces.Transducer(TOY)
    assert list(machine.encode("axxb")) == [5, 0, 3] and machine.decode([5, 0, 3]) == "a ⁇ b"


def test_memory_of_parts_is_bounded():
    found = pieces.Remembered(lambda k: k * 2, 10)
    assert [found[k % 37] for k in range(500)] == [2 * (k % 37) for k in range(500)] and len(found) <= 10 and len(found.old) <= 10


def test_few_texts_are_held_at_once(spark, model, monkeypatch):
    """A batch of many texts goes on in pieces of ROWS texts, whose results follow each other in order."""
    import pyarrow as pa

    class Docs:
        sparkSession, dtypes = spark, [("doc_id", "bigint"), ("text", "string")]
        select = lambda self, *names: self

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.record_batch([pa.array(range(5000)), pa.array(["a text"] * 4999 + [None])], names=["doc_id", "text"])])))

    out = pieces.encode(Docs(), model)
    assert max(b.num_rows for b in out) <= 2048
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(5000)) and [n for b in out for n in b.column(2).to_pylist()][-1] == 0


def test_parts_end_where_kinds_of_characters_meet(model, library):
    """No piece joins letters and signs, so a word is the same part whatever sign follows it."""
    machine = pieces.Transducer(model)
    text = "word, word. word### (word) a££b 12.5% Жизнь, 日本語—x"
    parts = [p for some in machine.parts(text) for p in some]
    assert "".join(parts) == machine.normalise(text) and parts.count("▁word") == 3 and "word" in parts
    assert list(machine.encode(text)) == library.encode(text)


def test_memory_of_a_worker_is_bounded(model, library, monkeypatch):
    """Many distinct words take little memory, and what a worker forgets is found again."""
    import random
    import tracemalloc

    draw = random.Random(7)
    texts = [" ".join("".join(draw.choices("etaoinshr", k=9)) for _ in range(500)) for _ in range(80)]
    machine = pieces.Transducer(model)
    known = pieces.Parts(machine)
    tracemalloc.start()
    ids, lengths, same = known.encode(texts)
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()
    assert all(same) and ids.tolist() == [i for t in texts for i in library.encode(t)] and lengths.sum() == len(ids)
    monkeypatch.setattr(pieces, "PARTS", 100)
    known = pieces.Parts(pieces.Transducer(model))
    for t in ("", "▁", texts[0], "a b", texts[1] + "▁ x"):
        ids, lengths, same = known.encode([t, t])
        assert ids.tolist() == 2 * library.encode(t) and same == 2 * ["▁" not in t] and len(known) <= 100 and lengths.tolist() == 2 * [len(ids) // 2]
