"""Conversation repair against all edit sequences of short conversations and a plain table of suffixes."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from rastrel.llm import conversations as c

SPACE = "\t\n\x0b\x0c\r "


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        left = text.rstrip(SPACE)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def suffixes(rows, bad):
    """Least (cost, audit) by a table from the end, with the allowed prefixes of roles told by the pattern itself."""
    states = {"": "", "s": "s", "u": "su", "a": "sua"}  # any beginning with that last role

    def after(state, initial):
        text = states[state] + initial
        if re.fullmatch("(s?(ua)*u?)", text) is None:
            return None
        return initial

    best = {q: (0, "") if re.fullmatch("(s?(ua)+)?", states[q]) else (9**9, "") for q in states}
    for k in range(len(rows), -1, -1):
        if k < len(rows):
            now = {}
            for q in states:
                found = [(best[q][0] + 4, "D" + best[q][1])]
                if bad[k] not in ("blank", "duplicate"):
                    more = 3 if bad[k] == "truncated" else 0
                    if (to := after(q, rows[k][2][:1])) is not None and rows[k][2][:1]:
                        found.append((best[to][0] + more, "K" + best[to][1]))
                    for new in "ua":
                        if (to := after(q, new)) is not None:
                            found.append((best[to][0] + more + 3, "R" + best[to][1]))
                now[q] = min(found)
            best = now
        for _ in range(4):  # insertions before what follows
            best = {q: min([best[q]] + [(best[to][0] + 3, "I" + best[to][1]) for new in "ua" if (to := after(q, new)) is not None]) for q in states}
    return best[""]


def everything(rows, bad):
    """All choices for up to three rows, judged by the pattern alone."""
    found = []
    inserts = ["", "u", "a", "ua", "au"]
    choices = [["D"] + ([] if b in ("blank", "duplicate") else ["K", "u", "a"]) for b in bad]
    for pick in itertools.product(*choices):
        for ins in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k in range(len(rows) + 1):
                roles, audit, cost = roles + ins[k], audit + "I" * len(ins[k]), cost + 3 * len(ins[k])
                if k < len(rows):
                    p = pick[k]
                    roles += "" if p == "D" else rows[k][2][:1] or "?" if p == "K" else p
                    audit += p if p in "DK" else "R"
                    cost += {"D": 4, "K": 0}.get(p, 3) + (3 if p != "D" and bad[k] == "truncated" else 0)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, audit))
    return min(found)


def fixed(rows, audit):
    out, at, last = [], 0, ""
    for letter in audit:
        nxt = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((nxt, ""))
        else:
            _, _, role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            out.append((role if letter == "K" else nxt, text))
        last = out[-1][0][:1]
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return out


def slow(table):
    """All columns of every conversation."""
    out = {}
    after = damaged(table)
    for conv in {r[0] for r in table}:
        rows = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        bad = faults(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        cost, audit = suffixes(rows, bad)
        text = "\n".join(f"{r}:{t}" for r, t in fixed(rows, audit))
        pairs = [x[2][:1] + y[2][:1] for x, y in itertools.pairwise(rows)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def repaired(rows_of_table):
    out = c.repair(c.damage(rows_of_table), rows_of_table).collect()
    found = {r.conv_id: tuple(r)[1:] for r in out}
    assert len(found) == len(out)
    return found


def symbols(rows, bad):
    number = {"s": 0, "u": 1, "a": 2}
    return bytes(number.get(r[2][:1], 3) + {"": 0, "truncated": 8}.get(b, 4) for r, b in zip(rows, bad))


def test_cheapest_edits():
    kinds = [(role, bad) for role in ("system", "user", "assistant", "tool", "") for bad in ("", "blank", "truncated")]
    for n in (0, 1, 2):
        for pick in itertools.product(kinds, repeat=n):
            rows, bad = [(0, 0, r, "") for r, _ in pick], [b for _, b in pick]
            want = everything(rows, bad)
            assert suffixes(rows, bad) == want == c.cheapest(symbols(rows, bad))
    draw = random.Random(5)
    for n in [3] * 30 + [7] * 300 + [40] * 100 + [400] * 5:
        pick = [draw.choice(kinds) for _ in range(n)]
        rows, bad = [(0, 0, r, "") for r, _ in pick], [b for _, b in pick]
        got = c.cheapest(symbols(rows, bad))
        assert got == suffixes(rows, bad)
        if n == 3:
            assert got == everything(rows, bad)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/conversations.parquet")
    assert repaired(docs) == slow([tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()])


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, t, r, x) for t, r, x in [(0, "user", "Hi."), (None, "user", "Hi."), (None, None, None), (None, "user", "Hi."), (3, "user", "Hi."), (3, "tool", "x"), (9, "assistant", " ok! \n")]]
    rows += [(None, None, None, None), (None, 1, "assistant", "Yes."), (2, None, "user", "a."), (2, None, "user", "a."), (3, 5, "assistant", "é…"), (3, 7, "", "b."), (3, 7, "system", "s."), (3, 7, "system", "s."), (3, 8, "system", "s.")]
    rows += [(k, t, ["system", "user", "assistant"][(k + t * t) % 3], "w" * (k % 4) + ".") for k in range(10, 40) for t in range(k % 9)]
    rows += [(99, t, "user" if t % 2 else "assistant", "long " * 20_000 + f"{t}.") for t in range(40)]
    rows += [(7, t, "user", "the same.") for t in range(2000)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, kind string, t string")


def test_edges(spark, edges):
    assert repaired(edges) == slow([tuple(r)[:4] for r in edges.collect()])
    assert repaired(edges.filter("conv_id > 1000")) == {}


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    docs = spark.createDataFrame([(5, turn, "user", "gone.")], "conv_id long, turn long, role string, text string")
    assert repaired(docs) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
