from __future__ import annotations

import pytest

WORDS = "the cat sat on a mat while rain fell over hills and rivers near old towns where people sang songs about bread".split()


def prose(k: int, n: int) -> str:
    """n words that depend on k, with a line end after every ninth."""
    return " ".join(WORDS[(k * 7 + i * i * (k + 3) + i) % len(WORDS)] + ("\n" if i % 9 == 8 else "") for i in range(n))


#: Names that operators use inside; a table may have them as further columns.
CLASHING = ("row", "k1", "k2", "tk", "fp", "root", "shard", "slot", "p", "r", "h", "w", "a", "b", "ids", "found", "site", "host", "key", "id", "gone", "rank", "n", "doc", "_page", "held_out", "lang_pred", "row_id", "lines")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and further columns with clashing names."""
    rows = [
        (1, prose(1, 60), "en", "a"), (2, prose(1, 60), "en", "b"), (2, prose(1, 60), "en", "b"), (3, None, None, None), (None, None, None, None),
        (None, prose(2, 30), "en", None), (4, "", "de", "a"), (5, " \n\t ", "de", "c"), (6, "él está aquí ¡sí! 🎉\n" * 3, "es", "a"),
        (7, prose(3, 20_000), None, "a"), (None, prose(2, 30), "en", None), (8, "one", "en", ""), (9, prose(1, 60), "en", "a"),
    ]
    return spark.createDataFrame(
        [(i, t, g, s, None if t is None else len(t), *["x"] * len(CLASHING)) for i, t, g, s in rows],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("doc_id > 100")
