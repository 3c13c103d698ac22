"""Secret scan: a trigram inverted index answers Boolean queries derived from the rules' regular expressions
(DataFrame functions only)."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.functions.scalars import let, running_sums
from rxweave.llm.common import stored

#: An alternative of a Boolean query has at most this many trigrams; fewer only admit more candidates.
MAX_TERMS = 60
#: A choice of more strings than this counts as "any string" when trigrams are derived.
MAX_EXACT = 16


@dataclass(frozen=True)
class SecretRule:
    """``regex`` in the syntax that Java and Python share; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds.
BASE_RULES = (
    SecretRule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    SecretRule("access", "AKIA[A-Z0-9]+", 0, 16, True),
    SecretRule("hex", "[0-9a-f]+", 0, 32, True),
)
#: The kinds that this scanner adds.
EXTRA_RULES = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}"),
)


def _join(left: list[set[str]], right: list[set[str]]) -> list[set[str]]:
    """Both must hold; where that has too many alternatives, the left side alone, which admits more."""
    return [a | b for a, b in product(left, right)] if len(left) * len(right) <= MAX_EXACT * MAX_EXACT else left


def _grams(s: str) -> set[str]:
    s = s.lower()
    return {s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii()}


def _walk(nodes) -> tuple[list[str] | None, list[set[str]]]:
    """(the exact strings a sequence can be, or None; the trigram sets of which a match holds one whole)."""
    run: list[str] | None = [""]  # the strings that the nodes since the last open one can be
    query: list[set[str]] = [set()]
    closed = True
    for op, arg in nodes:
        exact: list[str] | None = None
        inner: list[set[str]] = [set()]
        if op is sre.LITERAL:
            exact = [chr(arg)]
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            exact = [chr(v) for _, v in arg]
        elif op is sre.SUBPATTERN:
            exact, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            exact = None if any(p[0] is None for p in parts) else [s for p in parts for s in p[0]]
            inner = [q for p in parts for q in (p[1] if p[0] is None else [_grams(s) for s in p[0]])]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            one, inside = _walk(body)
            if (low, high) == (0, 1) and one is not None:
                exact = ["", *one]
            elif low == high and one is not None and len(one) == 1 and low < 20:
                exact = [one[0] * low]
            elif low > 0:
                inner = inside if one is None else [_grams(s) for s in one]
        elif op is sre.AT:
            exact = [""]
        if exact is not None and run is not None and len(run) * len(exact) <= MAX_EXACT:
            run = [a + b for a, b in product(run, exact)]
        else:
            query = _join(_join(query, [_grams(s) for s in run or [""]]), inner if exact is None else [_grams(s) for s in exact])
            run, closed = [""], False
    if closed:
        return run, [_grams(s) for s in run or [""]]
    return None, _join(query, [_grams(s) for s in run or [""]])


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams: a text with a match holds all trigrams of one of them.

    Empty if some match needs no trigram; the rule must then scan every text.
    """
    alternatives = {frozenset(sorted(q)[:MAX_TERMS]) for q in _walk(parser.parse(regex))[1]}
    least = [q for q in alternatives if not any(p < q for p in alternatives)]
    return [] if frozenset() in alternatives else sorted(least, key=sorted)


def _spans(text: Column, rule: SecretRule, order: int) -> Column:
    """Kept matches as array<struct<s,k,e,kind>>: code points, end exclusive. Running sums of the lengths of matches and of the
    gaps between them give the places."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
    pairs = F.arrays_zip(F.split(text, rule.regex, -1).alias("gap"), found.alias("hit"), tested.alias("part"))

    def placed(pairs: Column) -> Column:
        def span(x: Column, end: Column) -> Column:
            there = F.struct((end - F.length(x["hit"])).alias("s"), F.lit(order).alias("k"), end.alias("e"), F.lit(rule.kind).alias("kind"))
            return F.when(F.length(x["part"]) >= rule.least, there)

        ends = running_sums(F.transform(pairs, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))))
        return let(ends, lambda e: F.array_compact(F.zip_with(pairs, e, span)))

    return let(pairs, placed)


def _shorter(rule: SecretRule) -> SecretRule:
    """A plain repeated class with a least length needs no match below it: the longest run is the match."""
    if not rule.group and rule.least > 1 and rule.regex.endswith("]+"):
        lead = len(rule.regex[: rule.regex.index("[")])
        return SecretRule(rule.kind, rule.regex[:-1] + "{%d,}" % max(1, rule.least - lead), 0, 1, rule.base)
    return rule


def scan_secrets(docs: DataFrame, rules: Sequence[SecretRule] = BASE_RULES + EXTRA_RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Find every rule's leftmost non-overlapping matches in whole texts: key, ``found`` array<struct<s,k,e,kind>>.

    1. Index: one pass writes the postings (trigram, key) of the trigrams that the rules' queries name.
    2. Query: postings join the queries' terms; the bits of the terms met are or-ed by (key, alternative), and a key
       whose bits are complete is a candidate of the rule.
    3. Verify: texts are joined with their candidate rules (broadcast only if that table is within Spark's size
       limit, else by shuffle), and only those rules run, with the rules that have no mandatory trigram, which run
       on every text.

    Spans are sorted by start, then by the rules' order. Null text is empty. Rows with the same or a null key are each
    judged on their own text; other columns are ignored. Empty tables and texts give no spans.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
    terms = [(t, i, j, 1 << n, (1 << len(q)) - 1) for i, qs in queries.items() for j, q in enumerate(qs) for n, t in enumerate(sorted(q))]
    full = {i for i, qs in queries.items() if not qs}
    if terms:
        spark = docs.sparkSession
        low = F.lower("text")
        names = sorted({t[0] for t in terms})
        held = F.filter(F.array(*map(F.lit, names)), lambda t: F.contains(F.col("low"), t))
        postings = stored(rows.select("key", low.alias("low")).select("key", F.explode(held).alias("trigram")), "postings")
        needs = spark.createDataFrame(terms, "trigram string, rule int, alt int, bit long, whole long")
        candidates = (
            postings.join(F.broadcast(needs), "trigram")
            .groupBy("key", "rule", "alt", "whole")
            .agg(F.bit_or("bit").alias("bits"))
            .where("bits = whole")
            .groupBy("key")
            .agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))
        )
        candidates = stored(candidates, "candidates").withColumnRenamed("key", "ckey")
        rows = rows.join(candidates, F.col("key").eqNullSafe(F.col("ckey")), "left").drop("ckey")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    parts = []
    for i, r in enumerate(rules):
        run = F.regexp_like(F.col("text"), F.lit(_shorter(r).regex))
        if i not in full:
            run = (F.coalesce("rules", F.lit(0)).bitwiseAND(1 << i) != 0) & run
        parts.append(F.when(run, _spans(F.col("text"), _shorter(r), i)).otherwise(none))
    return rows.select(F.col("key").alias(key), F.array_sort(F.concat(*parts)).alias("found"))
