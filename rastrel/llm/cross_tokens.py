"""Alignment of two tokenizers over a corpus, and how many documents link each pair of ids.

A byte-level tokenizer A and a piece tokenizer B cut the same bytes; where tokens of both end at one byte a group ends, and all A and B
tokens of a group are linked. First pass: every task aligns its texts and writes, per bucket of a hash of the pair, the distinct
pairs with the number of its documents. Of the distinct pairs of a bucket, merged as a tree, a minimal perfect hash is built: at each level
a pair goes to a bit of its own or, if others want it too, on to the next level, and a pair's place is the number of bits set before
its own. The tasks' counts become dense vectors in that order, which are summed as a tree. The pair itself is kept at its place, so a pair
of another block is told from a counted one. Second pass: texts are aligned again and their links looked up in the index, which is broadcast in
blocks of a counted size.

Alignment works on stretches of white space and what follows it: neither tokenizer lets a token reach across, which is checked for the
given vocabularies, so both encodings are those of the stretches one after the other, and each distinct stretch is encoded once. If no piece of B
goes on from a letter to a sign, as A never does, stretches end there too, and a word is the same one whatever sign follows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.llm.common import written

#: Buckets of pairs by their hash (a power of two); a bucket can't outgrow this share of all pairs of the two vocabularies.
BUCKETS = 256
#: Rows of a bucket that are merged or summed at once.
FAN = 32
#: Pairs whose index (about 17 bytes each) is broadcast at once.
PAIRS_PER_BLOCK = 4_000_000
#: Distinct stretches, links of stretches and pairs a worker remembers before it starts again.
MOST = 400_000
#: Stretches with more possible links are aligned one by one.
LONG = 1 << 12
#: Bytes of text that are aligned at once.
STEP = 1 << 22
#: The blank of the piece alphabet; kinds of pieces and of models in the model format.
BLANK = "▁"
BYTE, CONTROL, UNKNOWN = 6, 3, 2
#: Fixed value: how byte-level vocabularies of the usual kind cut texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and signs between which stretches may end; those of all versions of Unicode, as the libraries bring tables of their own.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ž", r"!-/:-@\[-`{-~"


@dataclass(frozen=True)
class Tokenizers:
    """The two vocabulary files, as they are sent to the workers."""

    a: str
    b: bytes


def load(spark: SparkSession, a: str, b: str) -> Tokenizers:
    """Read by Spark, so the paths may lie in any store."""
    files = [bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]) for path in (a, b)]
    return Tokenizers(files[0].decode(), files[1])


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin-1 for itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Numbers for stretches of text, with their tokens and links; pairs have numbers of their own."""

    def __init__(self, tokenizers: Tokenizers, texts: bool = True):
        """Without ``texts`` the groups are not written out."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizers.a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        config, alphabet = json.loads(tokenizers.a), byte_alphabet()
        special = {t["content"] for t in config.get("added_tokens", [])}
        self.a_bytes = {i: t.encode() if t in special else bytes(alphabet.get(c, 63) for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        model = proto.ModelProto.FromString(tokenizers.b)
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        norm = model.normalizer_spec
        joined = [p.piece.lstrip(BLANK) for p in model.pieces if len(p.piece) > 1 and p.type not in (CONTROL, UNKNOWN, BYTE)]
        # white space that B never joins with anything; texts with other white space are encoded whole
        space = "".join(c for c in " \t\n\r" if not any(c in p for p in joined))
        words = "" if any(re.search(f"[{LETTERS}][{SIGNS}]", p) for p in joined) else f"[{space}]*+[{SIGNS}]*+[{LETTERS}]++(?![^{SIGNS}{space}])|"
        self.parts, self.odd = re.compile(f"{words}[{space}]*[^{space}]+|[{space}]+"), re.compile(rf"[^\S{space}]")
        pre = config.get("pre_tokenizer") or {}
        #: Whether texts may be cut before white space: the usual byte-level pattern, and no piece with a blank but at its beginning.
        self.cuts = (
            config.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(BLANK in p for p in joined))
        self.b_whole = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.b)
        norm.add_dummy_prefix = False  # stretches bring their blank along
        self.b_part = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.texts, top = texts, 1 + max(len(self.b_bytes), *self.a_bytes)
        self.id = [f"{k}{c}" for k in range(top) for c in ",|;"] if texts else []
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.a_size = np.zeros(top, np.int64)
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.fast = self._ranks(config) if self.cuts else None
        self.clear()

    def _ranks(self, config: dict):
        """The same encoding by a faster library, which knows merges by the number of their result: only if merges are in that order."""
        import tiktoken

        merged = config["model"]["merges"]
        vocab, plain = config["model"]["vocab"], len(byte_alphabet())
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merged)
        if config["model"].get("ignore_merges") or len(vocab) != plain + len(merged) or any(vocab.get(a + b) != plain + k for k, (a, b) in enumerate(pairs)):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values()}, special_tokens={})

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of each stretch
        self.key: dict[int, int] = {}  # of each pair
        self.text: list[str] = []
        self.same = np.zeros(0, bool)
        self.facts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of each stretch
        self.keys = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)  # of a stretch's links among all
        self.link, self.times = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.number) > MOST or len(self.key) > 4 * MOST or len(self.link) > 8 * MOST

    def stretches(self, text: str) -> list[str]:
        whole = " " + text
        return self.parts.findall(whole) if self.cuts and not self.odd.search(text) else [whole]

    def learn(self, parts: list[str]) -> None:
        """Numbers for stretches without one."""
        if not parts:
            return
        a = list(map(self.fast.encode_ordinary, parts)) if self.fast else [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # a whole text goes to B as it is, which adds the blank itself
        b = self.b_part.encode(parts, num_threads=1) if self.cuts else self.b_whole.encode([p[1:] for p in parts], num_threads=1)
        data = [p.encode() for p in parts]
        bytes_of = (lambda table, ids: b"".join(map(table.__getitem__, ids)))
        same, whole = np.ones(len(parts), bool), b"".join(data)
        if not bytes_of(self.a_bytes, chain.from_iterable(a)) == whole == bytes_of(self.b_bytes, chain.from_iterable(b)):
            same = np.array([bytes_of(self.a_bytes, x) == d == bytes_of(self.b_bytes, y) for x, y, d in zip(a, b, data, strict=True)])
        # long stretches, whose groups may be large, one by one
        long = np.array([len(x) * len(y) > LONG for x, y in zip(a, b, strict=True)])
        kinds = [np.flatnonzero(same & ~long).tolist(), np.flatnonzero(same & long).tolist(), np.flatnonzero(~same).tolist()]
        for k, p in enumerate(chain.from_iterable(kinds), len(self.same)):
            self.number[parts[p]] = k
        self._many([a[k] for k in kinds[0]], [b[k] for k in kinds[0]])
        for k in kinds[1]:
            self._one(a[k], b[k])
        bad = len(kinds[2])
        self._keep(np.zeros((bad, 4), np.int64), np.zeros(bad, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [""] * bad)
        self.same = np.concatenate([self.same, np.ones(len(parts) - bad, bool), np.zeros(bad, bool)])

    def _keep(self, facts: np.ndarray, links: np.ndarray, keys: np.ndarray, times: np.ndarray, texts: list[str]) -> None:
        """Stretches with their facts, numbers of links, the links' pairs and how often each occurs."""
        ids, at = np.unique(keys, return_inverse=True)
        known = self.key
        new = [k for k in ids.tolist() if k not in known]
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.keys = np.concatenate([self.keys, np.array(new, np.int64)])
        number = np.fromiter(map(known.__getitem__, ids.tolist()), np.int32, len(ids))
        self.link, self.times = np.concatenate([self.link, number[at]]), np.concatenate([self.times, times])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(links)])
        self.facts = np.concatenate([self.facts, facts])
        if self.texts:
            self.text.extend(texts)

    def _many(self, a: list[list[int]], b: list[list[int]]) -> None:
        """Short stretches, all at once: where both end is where the running numbers of bytes meet."""
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        x, y = (np.fromiter(chain.from_iterable(z), np.int64, n.sum()) for z, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        part = np.searchsorted(np.cumsum(n_a), start_a, side="right")  # of each group
        n_groups = np.bincount(part, minlength=len(a))
        each = size_b[group_a]  # links of each A token
        other = np.repeat(start_b[group_a] - np.cumsum(each) + each, each) + np.arange(each.sum())
        n_links = np.zeros(len(a), np.int64)
        np.add.at(n_links, part, size_a * size_b)
        texts: list[str] = []
        if self.texts:
            stop_a = start_a + size_a
            code = np.zeros(len(x) + len(y), np.int64)
            last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True][: len(x)], np.r_[group_b[1:] != group_b[:-1], True][: len(y)]
            code[np.arange(len(x)) + start_b[group_a]] = 3 * x + last_a
            code[np.arange(len(y)) + stop_a[group_b]] = 3 * y + 2 * last_b
            words = list(map(self.id.__getitem__, code.tolist()))
            stops = np.cumsum(n_a + n_b).tolist()
            texts = ["".join(words[i:j])[:-1] for i, j in zip([0, *stops], stops, strict=False)]
        self._keep(np.stack([n_a, n_b, n_groups, n_links], axis=1), n_links, np.repeat(x, each) << 32 | y[other], np.ones(len(other), np.int64), texts)

    def _one(self, x: list[int], y: list[int]) -> None:
        """A long stretch: groups may hold many tokens, so equal pairs of a group are counted, not written out."""
        links: Counter[int] = Counter()
        n_links, texts, first, second = 0, [], 0, 0
        ends, other = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        common = np.intersect1d(ends, other, assume_unique=True)
        stops = zip((np.searchsorted(ends, common) + 1).tolist(), (np.searchsorted(other, common) + 1).tolist(), strict=True)
        for i, j in stops:
            some, others = x[first:i], y[second:j]
            first, second = i, j
            again = Counter(others)
            for p, n in Counter(some).items():
                for q, m in again.items():
                    links[p << 32 | q] += n * m
            n_links += len(some) * len(others)
            if self.texts:
                texts.append(f"{','.join(map(str, some))}|{','.join(map(str, others))}")
        keys, times = np.fromiter(links, np.int64, len(links)), np.fromiter(links.values(), np.int64, len(links))
        self._keep(np.array([[len(x), len(y), len(common), n_links]]), np.array([len(links)]), keys, times, [";".join(texts)])

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of all texts, one text after the other, and where each text begins (and the last ends). Texts that
        aren't the bytes of their tokens, and empty ones, have none."""
        parts = [self.stretches(t) if t else [] for t in texts]
        known = self.number
        self.learn(list(set(chain.from_iterable(parts)).difference(known)))
        numbers = [np.fromiter(map(known.__getitem__, ps), np.int64, len(ps)) for ps in parts]
        if not self.same.all():
            numbers = [n if self.same[n].all() else n[:0] for n in numbers]
        return np.concatenate(numbers or [np.zeros(0, np.int64)]), np.cumsum([0, *map(len, numbers)])


#: The aligner of this worker process; loading the two libraries takes as long as some thousand texts.
_LOADED: dict[tuple, Aligner] = {}


def loaded(tokenizers: Tokenizers, texts: bool = True) -> Aligner:
    """An aligner that knows no stretch yet; a worker keeps the last one it loaded."""
    key = (hash(tokenizers), texts)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(tokenizers, texts)
    _LOADED[key].clear()
    return _LOADED[key]


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about STEP bytes of text: the first row's number and the texts."""
    first, out, size = 0, [], 0
    for k, t in enumerate(batch.column(column)):
        text = t.as_py() or ""
        out.append(text)
        size += len(text) + 64
        if size >= STEP:
            yield first, out
            first, out, size = k + 1, [], 0
    if out:
        yield first, out


def mix(keys: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits all depend on each other (the finaliser of splitmix64)."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) % np.uint64(BUCKETS)).astype(np.int64)


def _place(keys: np.ndarray, level: int, size) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(keys) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)) % np.asarray(size, np.uint64)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits (64 to a word), and the keys in the order of their places."""
    sizes, levels, order, left = [], [], [], keys.astype(np.uint64)
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        order.append(left[own][np.argsort(at[own])])
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~own]
    joined = (lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind))
    return np.array(sizes, np.int64), joined(levels, np.uint64), joined(order, np.uint64)


class Index:
    """Places of pairs over several buckets, one after the other, checked against the pairs kept there."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]]):
        """Rows of (bucket, sizes, bits, keys)."""
        sizes = {b: np.frombuffer(s, np.int64) for b, s, _, _ in rows}
        self.depth = max(map(len, sizes.values()), default=0)
        self.size, self.offset = (np.zeros((BUCKETS, self.depth), np.int64) for _ in range(2))
        at = 0
        for b, own in sizes.items():
            self.size[b, : len(own)] = own
            self.offset[b, : len(own)] = at + np.cumsum(own) - own
            at += int(own.sum())
        self.words = np.concatenate([np.frombuffer(w, np.uint64) for _, _, w, _ in rows] or [np.zeros(0, np.uint64)])
        self.before = np.cumsum(np.r_[0, np.bitwise_count(self.words)])
        self.keys = np.concatenate([np.frombuffer(k, np.uint64) for *_, k in rows] or [np.zeros(0, np.uint64)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each pair, -1 for pairs that aren't here."""
        keys = keys.astype(np.uint64)
        out, rest, bucket = np.full(len(keys), -1, np.int64), np.arange(len(keys)), bucket_of(keys)
        for level in range(self.depth):
            size = self.size[bucket[rest], level]
            rest, size = rest[size > 0], size[size > 0]
            at = self.offset[bucket[rest], level] + _place(keys[rest], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.before[at >> 6] + below)[hit]
            rest = rest[~hit]
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out


def _raw(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def counted_pairs(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(bucket, part, keys, counts): the distinct pairs of a task's documents and in how many of them they are linked."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(shared.value, texts=False)
        counts, part = np.zeros(0, np.int64), TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            keys = own.keys[: len(counts)]
            bucket = bucket_of(keys)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            ks, cs = np.split(keys[order], cuts), np.split(counts[order], cuts)
            return pa.record_batch(
                [pa.array([int(bucket_of(k[:1])[0]) for k in ks], pa.int32()), pa.array([part] * len(ks), pa.int64()),
                 pa.array(map(_raw, ks), pa.binary()), pa.array(map(_raw, cs), pa.binary())], names=["bucket", "part", "keys", "counts"])

        for batch in batches:
            for _, texts in pieces(batch, 0):
                numbers, start = own.read(texts)
                doc = np.repeat(np.arange(len(texts)), np.diff(start))
                known = max(1, len(own.same))
                once = np.unique(doc * known + numbers)  # each stretch once for each document
                doc, number = once // known, once % known
                begin = own.start
                size = begin[number + 1] - begin[number]
                at = np.repeat(begin[number] - np.cumsum(size) + size, size) + np.arange(size.sum())
                link = own.link[at].astype(np.int64)
                pairs = np.unique(np.repeat(doc, size) * max(1, len(own.keys)) + link) % max(1, len(own.keys))
                counts = np.concatenate([counts, np.zeros(len(own.keys) - len(counts), np.int64)]) + np.bincount(pairs, minlength=len(own.keys))
                if own.full():
                    if len(counts):
                        yield flush()
                    own.clear()
                    counts, part = np.zeros(0, np.int64), part + 1
        if len(counts):
            yield flush()
        own.clear()

    return docs.select("text").mapInArrow(run, "bucket int, part long, keys binary, counts binary")


def _column(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(_column(table, "keys", np.uint64)))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "keys": pa.array([_raw(keys)], pa.binary())})


def _hashes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    sizes, bits, order = perfect_hash(np.unique(np.concatenate(_column(table, "keys", np.uint64))))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(order)], pa.int64()), **{n: pa.array([_raw(x)], pa.binary()) for n, x in (("sizes", sizes), ("bits", bits), ("keys", order))}})


def _vector(key: tuple[pa.Scalar, ...], rows: pa.Table, index: pa.Table) -> pa.Table:
    """The counts of some tasks as one dense vector in the order of the hash."""
    if not rows.num_rows:  # the tree may leave a group without tasks
        return pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
    places = Index([(index["bucket"][0].as_py(), *[index[n][0].as_py() for n in ("sizes", "bits", "keys")])])
    total = np.zeros(index["n"][0].as_py(), np.int64)
    for keys, counts in zip(_column(rows, "keys", np.uint64), _column(rows, "counts", np.int64), strict=True):
        total[places.find(keys)] += counts
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([_raw(total)], pa.binary())})


def _sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum(_column(table, "counts", np.int64), axis=0)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([_raw(total)], pa.binary())})


def pair_index(pairs: DataFrame, fan: int = FAN) -> DataFrame:
    """(bucket, n, sizes, bits, keys, counts): the minimal perfect hash of each bucket and the dense count vector over all parts."""
    deal = (lambda groups: F.pmod(F.xxhash64("part"), F.lit(groups)).cast("long").alias("g"))
    parts = pairs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1
    rows, n = pairs.select("bucket", "part", "keys"), parts
    while n > fan:
        n = -(-n // fan)
        rows = rows.groupBy("bucket", deal(n)).applyInArrow(_merge, "bucket int, part long, keys binary")
    index = written(rows.groupBy("bucket").applyInArrow(_hashes, "bucket int, n long, sizes binary, bits binary, keys binary"), "pair-hashes")
    n = -(-parts // fan)
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    sums = pairs.groupBy("bucket", deal(n)).cogroup(dealt.groupBy("bucket", "part")).applyInArrow(_vector, "bucket int, part long, counts binary")
    while n > 1:
        n = -(-n // fan)
        sums = sums.groupBy("bucket", deal(n)).applyInArrow(_sum, "bucket int, part long, counts binary")
    return written(index.join(sums.select("bucket", "counts"), "bucket"), "pair-index")


def highest(index: DataFrame) -> DataFrame:
    """(a, best): the highest count of each A id; at most one row for each entry of A's vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*[_column(pa.table(batch), n, np.int64) for n in ("keys", "counts")], strict=True):
                ids, at = np.unique(keys >> 32, return_inverse=True)
                best = np.zeros(len(ids), np.int64)
                np.maximum.at(best, at, counts)
                yield pa.record_batch([pa.array(ids), pa.array(best)], names=["a", "best"])

    return index.select("keys", "counts").mapInArrow(run, "a long, best long").groupBy("a").agg(F.max("best").alias("best"))


FACTS = ("n_a", "n_b", "n_groups", "n_links")


def _look_up(docs: DataFrame, tokenizers: Tokenizers, block: DataFrame, best: np.ndarray) -> DataFrame:
    """rid, doc_id, facts, groups_sha256 and, over the pairs of this block, n_best and count_sum."""
    context = docs.sparkSession.sparkContext
    rows = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in block.select("bucket", "sizes", "bits", "keys", "counts").collect()]
    shared = context.broadcast((tokenizers, rows, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, rows, best = shared.value
        own, index = loaded(given), Index([r[:4] for r in rows])
        counts = np.concatenate([np.frombuffer(r[4], np.int64) for r in rows] or [np.zeros(0, np.int64)])
        sums = np.zeros((0, 2), np.int64)  # n_best and count_sum of each stretch

        def learnt() -> np.ndarray:
            """The sums of the stretches learnt since."""
            start = own.start[len(sums) :]
            link, times = own.link[start[0] :], own.times[start[0] :]
            ids, at = np.unique(link, return_inverse=True)
            keys = own.keys[ids]
            place = index.find(keys)
            here = np.where(place >= 0, counts[place] if len(counts) else 0, 0)
            top = (place >= 0) & (here == best[keys >> 32])
            both = np.stack([top[at] * times, here[at] * times], axis=1)
            total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(both, axis=0)])
            return total[start[1:] - start[0]] - total[start[:-1] - start[0]]

        for batch in batches:
            for first, texts in pieces(batch, 2):
                numbers, start = own.read(texts)
                if len(own.same) > len(sums):
                    sums = np.concatenate([sums, learnt()])
                facts = own.facts
                each = np.concatenate([facts, sums], axis=1)[numbers]
                total = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(each, axis=0)])
                total = total[start[1:]] - total[start[:-1]]
                words = list(map(own.text.__getitem__, numbers.tolist()))
                marks = [hashlib.sha256(";".join(words[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                part = batch.slice(first, len(texts))
                yield pa.record_batch([part.column(0), part.column(1), *[pa.array(total[:, k].copy()) for k in range(6)], pa.array(marks, pa.string())],
                                      names=["rid", "doc_id", *FACTS, "n_best", "count_sum", "groups_sha256"])
                if own.full():
                    own.clear()
                    sums = np.zeros((0, 2), np.int64)
        own.clear()

    schema = f"rid long, doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in (*FACTS, "n_best", "count_sum")) + ", groups_sha256 string"
    return docs.select("rid", "doc_id", "text").mapInArrow(run, schema)


def align(docs: DataFrame, tokenizers: Tokenizers, pairs_per_block: int = PAIRS_PER_BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row.

    Null and empty texts, and those whose tokens don't give the text's bytes back, have no tokens: zeros and an empty string. Repeated rows
    count as documents of their own. Texts of any length are read whole. An empty table gives an empty result. Only doc_id and text
    are read. Beyond ``pairs_per_block`` distinct pairs the index is broadcast block by block, with one pass over the texts for each.
    """
    index = pair_index(written(counted_pairs(docs, tokenizers), "pairs"))
    total = index.agg(F.sum("n")).first()[0] or 0
    blocks = min(BUCKETS, max(1, -(-total // pairs_per_block)))
    top = highest(index).collect()  # one number for each id of A at most
    best = np.zeros(max((r.a for r in top), default=0) + 1, np.int64)
    best[[r.a for r in top]] = [r.best for r in top]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    if blocks == 1:
        return _look_up(rows, tokenizers, index, best).drop("rid")
    rows = written(rows, "numbered")  # the same numbers in every pass
    found = None
    for block in range(blocks):
        part = _look_up(rows, tokenizers, index.filter(F.pmod("bucket", F.lit(blocks)) == block), best)
        found = part if found is None else found.union(part)
    same = [F.max(n).alias(n) for n in ("doc_id", *FACTS)]
    return found.groupBy("rid").agg(*same, *[F.sum(n).alias(n) for n in ("n_best", "count_sum")], F.max("groups_sha256").alias("groups_sha256")).drop("rid")
