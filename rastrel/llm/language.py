"""Language identification, words first: known words score by their log frequency in each language; an unseen word falls back to
its longest character n-grams that are known, then to shorter ones.

The model is fitted on a bounded sample of labelled rows (``DOCUMENTS`` per language, a parameter, chosen by a hash of the text so that
it does not depend on the layout) and holds all words and n-grams of that sample, which Spark counts. It is then small enough to be
broadcast, and every row is predicted from its whole text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import Remembered, written

UNKNOWN = "und"
DOCUMENTS = 1500
LONGEST = 5
#: Added to every count; words count as evidence up to this many when the score is made.
PRIOR, EVIDENCE = 0.5, 20
#: Unseen words a worker remembers.
UNSEEN = 80_000
#: Characters of a text whose words are counted at once.
STRETCH = 1 << 20


def _of(*kinds: str) -> list[int]:
    """All characters whose general category begins so."""
    return [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith(kinds)]


def _class(kind: str) -> str:
    """The same as ranges of a pattern's character class."""
    found = _of(kind)
    ranges = np.split(np.array(found), np.flatnonzero(np.diff(found) > 1) + 1)
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in ranges)


#: A letter, and the letters and marks that follow it; digits and number signs are none.
LETTERS = re.compile(f"[{(_letters := _class('L'))}][{_letters}{(_marks := _class('M'))}]*")
_BREAK = re.compile(f"[^{_letters}{_marks}]")
#: The same for texts without marks and number signs, much faster; and those characters.
_PLAIN, _ODD = re.compile(r"[^\W\d_]+"), frozenset(map(chr, _of("M", "No", "Nl")))


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 3 from the doc_id as text; a null id is fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def words_of(text: str) -> Counter:
    """Words in lower case, with their counts; stretches of a long text end between words."""
    found: Counter = Counter()
    pattern = _PLAIN if text.isascii() or _ODD.isdisjoint(text) else LETTERS
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        stop = end.start() if end else len(text)
        found.update(pattern.findall(text[at:stop].lower()))
        at = stop
    return found


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    words: dict[str, int]
    word_weights: np.ndarray
    grams: list[dict[str, int]]
    gram_weights: list[np.ndarray]


def _weights(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of all keys, and the log relative frequency in each language, smoothed alike."""
    keys = {k: i for i, k in enumerate(sorted(set().union(*counts)))}
    table = np.full((len(keys), len(counts)), PRIOR)
    for j, c in enumerate(counts):
        for k, n in c.items():
            table[keys[k], j] += n
    return keys, np.log(table / table.sum(0))


def fit(labelled: DataFrame, documents: int = DOCUMENTS) -> Model:
    """From the columns text and lang; rows with a null in either are left out. Without any rows the model knows no language.

    The sample keeps ``documents`` rows of a language on average, of any length; the driver receives the sample's distinct words and
    n-grams with their counts.
    """
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    chance = F.xxhash64(F.lit(3), "text") / F.lit(2.0**64) + 0.5
    # shares as constants: joining them would shuffle every text by its language
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in totals.items() for v in (lang, documents / n)]), F.col("lang")) if totals else F.lit(0.0)
    sample = rows.filter(chance < share).select("lang", "text")

    def counted(of):
        """Sums per language and key what ``of`` gives for each row (key, n); a task passes on each key once in a while."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, Counter] = defaultdict(Counter)

            def out() -> Iterator[pa.RecordBatch]:
                for lang, c in found.items():
                    yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["lang", "key", "n"])
                found.clear()

            for batch in batches:
                for row in zip(*batch.to_pydict().values(), strict=True):
                    of(found[row[0]], *row[1:])
                if sum(map(len, found.values())) > UNSEEN * 4:
                    yield from out()
            yield from out()

        return run

    def of_text(found: Counter, text: str) -> None:
        found.update(words_of(text))

    def of_word(found: Counter, word: str, n: int) -> None:
        for size in range(1, LONGEST + 1):
            for g in grams(word, size):
                found[f"{size}{g}"] += n

    words = written(sample.mapInArrow(counted(of_text), "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "words")
    parts = words.mapInArrow(counted(of_word), "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    languages = sorted(totals)

    def tables(frame: DataFrame, sizes: list[str]) -> list[tuple[dict[str, int], np.ndarray]]:
        found = {size: {lang: {} for lang in languages} for size in sizes}
        for lang, key, n in zip(*frame.toArrow().to_pydict().values(), strict=True):
            size = key[: len(sizes[0])]
            found[size][lang][key[len(size) :]] = n
        return [_weights([Counter(found[size][lang]) for lang in languages]) if languages else ({}, np.zeros((0, 0))) for size in sizes]

    (word_keys, word_weights), = tables(words.select("lang", "key", "n"), [""])
    by_size = tables(parts.select("lang", "key", "n"), [str(n) for n in range(1, LONGEST + 1)])
    return Model(languages, word_keys, word_weights, [k for k, _ in by_size], [w for _, w in by_size])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.grams = [{g: tuple(w[k].tolist()) for g, k in keys.items()} for keys, w in zip(model.grams, model.gram_weights, strict=True)]
        self.unseen = Remembered(self.back_off, UNSEEN)

    def back_off(self, word: str) -> tuple[float, ...]:
        """Mean log frequency of the known n-grams of the longest order that has any; zero without."""
        for n in range(LONGEST, 0, -1):
            known = [w for g in grams(word, n) if (w := self.grams[n - 1].get(g)) is not None]
            if known:
                return tuple(sum(c) / len(known) for c in zip(*known, strict=True))
        return (0.0,) * len(self.model.languages)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else None
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        known = self.model.words
        rows, times, others, counts = [], [], [], []
        for word, n in found.items():
            at = known.get(word)
            if at is not None:
                rows.append(at)
                times.append(n)
            else:
                others.append(self.unseen[word])
                counts.append(n)
        total = np.zeros(len(self.model.languages))
        if rows:
            total += np.asarray(times, float) @ self.model.word_weights[rows]
        if others:
            total += np.asarray(counts, float) @ np.asarray(others)
        n = found.total()
        share = np.exp((total - total.max()) * min(n, EVIDENCE) / n)
        best = int(total.argmax())  # of equal ones the first in order of name
        return self.model.languages[best], float(share[best] / share.sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (a struct of all columns), ``lang_pred`` and ``score`` for every row, from the text alone.

    ``und`` with score 0 if the text is null or has no letter; of equal languages the first by name. Very long texts are read whole, in
    stretches. Repeated rows are predicted each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in texts:
            yield pd.DataFrame([scorer.predict(t) for t in batch], columns=["lang", "score"])

    out = docs.select(F.struct("*").alias("row"), judged(F.col("text")).alias("found"))
    return out.select("row", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
