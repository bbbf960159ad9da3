"""Secret scan by a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain: alternatives are OR-ed, the
trigrams of one alternative AND-ed. One pass writes the postings (trigram, document) of the trigrams that any rule asks for;
intersecting them by a grouping leaves candidate documents, and only those are searched. Rules without a mandatory trigram are
searched in all documents. Everything is a DataFrame expression: no text is exchanged unless the candidates are too many to be
broadcast, and then the planner shuffles candidates and texts by key.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, then those that this method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),  # a run matched at any length and dropped if short is the same: its rest is shorter
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED
#: The base rules as matched at any length, with the characters a match needs, for the check.
CHECKED = (BASE[0], Rule("access", r"AKIA[A-Z0-9]+", 0, 16), Rule("hex", r"[0-9a-f]+", 0, 32))
#: A run of literals is closed when it stands for more strings than this.
MOST_STRINGS = 64


def _exact(items) -> set[str] | None:
    """All strings that a part of an expression matches, in lower case; None if they are too many to list."""
    found = {""}
    for op, value in items:
        if op is rc.LITERAL:
            own: set[str] | None = {chr(value).lower()}
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in value):
            own = {chr(v).lower() for _, v in value}
        elif op is rc.SUBPATTERN:
            own = _exact(value[3])
        elif op is rc.BRANCH:
            parts = [_exact(p) for p in value[1]]
            own = None if None in parts else set().union(*parts)
        elif op is rc.MAX_REPEAT and value[1] <= 2:
            part = _exact(value[2])
            own = None if part is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(part, repeat=n)}
        else:
            own = None
        if own is None or len(found) * len(own) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def _runs(items) -> list[set[str]]:
    """Consecutive parts that can be listed, joined as far as possible; each match contains one string of every run."""
    runs, run = [], {""}
    for item in items:
        own = _exact([item])
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        runs.append(run)
        run = own or {""}
        if own is None and item[0] is rc.SUBPATTERN:
            runs += _runs(item[1][3])
        elif own is None and item[0] is rc.MAX_REPEAT and item[1][0] > 0:
            runs += _runs(item[1][2])
    return [*runs, run]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which one must have all its trigrams in a text that matches; empty if none is mandatory.

    Trigrams are in lower case. Of all runs of literals the most selective is taken: the one whose shortest string is longest.
    """
    runs = [r for r in _runs(rp.parse(pattern)) if min(map(len, r)) >= 3]
    if not runs:
        return []
    best = max(runs, key=lambda r: (min(map(len, r)), -len(r)))
    parts = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in best}
    return sorted((p for p in parts if not any(q < p for q in parts)), key=sorted)


def _keys() -> list[Column]:
    """128 bits for a row's doc_id and text; repeated rows share them, and have the same secrets."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")]


def candidates(texts: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(kind, k1, k2) of the documents whose trigrams satisfy the query of the kind."""
    terms = sorted({t for q in queries.values() for part in q for t in part})
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))
    postings = texts.select(F.explode(found).alias("trigram"), "k1", "k2").distinct()
    wanted = [(kind, k, t, len(part)) for kind, q in queries.items() for k, part in enumerate(q) for t in part]
    query = texts.sparkSession.createDataFrame(wanted, "kind string, part int, trigram string, need int")
    hits = postings.join(F.broadcast(query), "trigram")  # a row for each trigram of a rule
    whole = hits.groupBy("kind", "part", "k1", "k2").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return whole.filter("n = need").select("kind", "k1", "k2").distinct()


MATCHES = "array<struct<kind: string, i: int, before: int, own: int, good: boolean>>"


def _matches(rule: Rule, wanted: Column) -> Column:
    """A struct per match: its number in the text, the characters between it and the one before, its own, and whether it is kept."""
    pattern = F.lit(rule.pattern)
    cut = F.arrays_zip(
        F.split("text", rule.pattern, -1).alias("before"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("all"),
        F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"))
    each = F.transform(F.filter(cut, lambda m: m["all"].isNotNull()), lambda m, i: F.struct(
        F.lit(rule.kind).alias("kind"), i.alias("i"), F.length(m["before"]).alias("before"), F.length(m["all"]).alias("own"),
        (F.length(m["value"]) >= rule.least).alias("good")))
    return F.when(wanted & F.col("text").rlike(rule.pattern), each.cast(MATCHES)).otherwise(F.array().cast(MATCHES))


def _searched(texts: DataFrame, rules: list[tuple[Rule, Column]]) -> DataFrame:
    """The matches of several rules by one pass over the texts."""
    found = F.flatten(F.array(*[_matches(r, wanted) for r, wanted in rules]))
    return texts.select("k1", "k2", F.explode(found).alias("m")).select("k1", "k2", "m.*")


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k1, k2, kind, start, end) of every secret in the whole texts: code points, end exclusive.

    Matches are leftmost and do not overlap within a kind; those too short are dropped after matching. k1 and k2 stand for a row's
    doc_id and text, so repeated rows share one set of spans. Null and empty texts have none, and so has an empty table. Only
    doc_id and text are read.
    """
    texts = docs.select("text", *_keys()).filter("text IS NOT NULL")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    parts = []
    if queries:
        found = candidates(texts, queries).groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))
        parts.append(_searched(texts.join(found, ["k1", "k2"]), [(r, F.array_contains("kinds", r.kind)) for r in rules if r.kind in queries]))
    if rest := [(r, F.lit(True)) for r in rules if r.kind not in queries]:
        parts.append(_searched(texts, rest))
    each = parts[0].union(parts[1]) if len(parts) == 2 else parts[0]
    before = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    ended = each.distinct().withColumn("end", F.sum(F.col("before") + F.col("own")).over(before))
    return ended.filter("good").select("k1", "k2", "kind", (F.col("end") - F.col("own")).alias("start"), "end")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, the number of spans of each base kind, their digest, and all spans as text."""
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    base = F.col("s.k") < len(BASE)
    each = spans(docs, rules).select("k1", "k2", F.struct("start", order[F.col("kind")].alias("k"), F.concat_ws(":", "kind", "start", "end").alias("text")).alias("s"))
    own = each.groupBy("k1", "k2").agg(
        *[F.count_if(F.col("s.k") == k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.array_sort(F.collect_list(F.when(base, F.col("s")))).alias("base"), F.array_sort(F.collect_list("s")).alias("all"))
    text = lambda c: F.concat_ws(",", F.coalesce(F.col(f"{c}.text"), F.array().cast("array<string>")))
    rows = docs.select("doc_id", *_keys()).join(own, ["k1", "k2"], "left")
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(text("base"), 256).alias("base_sha256"), text("all").alias("spans"))


def check_sql(rules: tuple[Rule, ...] = CHECKED + ADDED) -> str:
    """The same rows in DuckDB, every rule searched in every text."""
    parts = []
    for k, r in enumerate(rules):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT rid, '{r.kind}' AS kind, {k} AS k, {r.least} AS least, string_split_regex(text, {p}) AS b, regexp_extract_all(text, {p}, 0) AS m, "
            f"regexp_extract_all(text, {p}, {r.group}) AS g FROM d WHERE regexp_matches(text, {p})")
    total = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
r AS MATERIALIZED ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r),
s AS (SELECT rid, kind, k, ({total.format('b[1:i]')} + {total.format('m[1:i-1]')})::BIGINT AS s, length(m[i]) AS n FROM i WHERE length(g[i]) >= least),
t AS (SELECT rid, kind, k, s, kind || ':' || s || ':' || (s + n) AS w FROM s),
a AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(w, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(w, ',' ORDER BY s, k) AS spans FROM t GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
