"""URL filter rules, indexed by their rarest literal token (DataFrame functions only)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class SiteRule:
    """Fits a host and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        end = "" if self.path.startswith("/") else "(?=/|$)" if not self.path else "(?!)"
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}{end}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting URL holds whole; the last of an open-ended path may go on."""
        found = re.findall("[a-z0-9]+", self.name.translate(str.maketrans(UPPER, LOWER)))
        return found[:-1] if self.path and self.name[-1].isalnum() else found


@dataclass(frozen=True)
class PatternRule:
    """The method's own: a regular expression over host and path, with the literal tokens it needs whole."""

    verdict: str
    regex: str
    literals: tuple[str, ...] = ()
    name: str | None = None

    @property
    def tokens(self) -> list[str]:
        return list(self.literals)


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _index(rules: Sequence[SiteRule | PatternRule], counts: dict[str, int]) -> tuple[Column, Column, int]:
    """Buckets of (token, rule) by a hash of the rule's rarest token, and the rules without a token."""
    size = 1 << max(2, (2 * len(rules)).bit_length())
    kind = "array<struct<token:string,len:int,name:string,verdict:string,regex:string>>"
    buckets: list[list[Column]] = [[] for _ in range(size)]
    always: list[Column] = []
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        site = isinstance(r, SiteRule)
        entry = F.struct(
            F.lit(token).cast("string").alias("token"), F.lit(len(r.name) if site else -1).alias("len"),
            F.lit(r.name if site else None).cast("string").alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"),
        )
        (always if token is None else buckets[zlib.crc32(token.encode()) % size]).append(entry)
    return F.array(*[F.array(*b).cast(kind) for b in buckets]), F.array(*always).cast(kind), size


def filter_urls(pages: DataFrame, rules: Sequence[SiteRule | PatternRule], default: str = "allow", *, key: str = "page_id", url: str = "url") -> DataFrame:
    """Judge each row's URL; one row out for each row in: key, host, path, rule, verdict.

    The rules travel inside the plan, so their number is bounded by what a driver writes down. One aggregate counts
    the rules' own tokens over all URLs; each rule is then filed under its rarest token. A URL's tokens look up
    buckets of candidate rules, and only the candidates run their regular expressions. Rules without a token are
    candidates everywhere. There is no join and no shuffle of rows.

    The longest fitting site rule wins (equal lengths: the larger name). Without one, a fitting pattern rule decides
    (``block`` before ``allow``), else ``default``. A null URL, or one without ``://``, has an empty host and path and
    gets ``default``. Repeated rows and null keys are kept as they are; other columns are ignored. No rules: default.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).select(
        "key", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path")
    )
    place = F.concat("host", "path")
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(place, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))
    needed = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if needed:
        wanted = F.array_intersect(tokens, F.array(*map(F.lit, needed)))
        counts = dict(map(tuple, rows.select(F.explode(wanted).alias("t")).groupBy("t").count().collect()))  # a row for each rule token
    index, always, size = _index(rules, counts)
    candidates = F.concat(
        always, F.flatten(F.transform(tokens, lambda t: F.filter(F.get(index, (F.crc32(t.cast("binary")) % size).cast("int")), lambda e: e["token"] == t)))
    )
    hits = F.filter(candidates, lambda e: F.regexp_like(place, e["regex"]))
    best = F.array_max(F.transform(hits, lambda e: F.struct(e["len"].alias("len"), e["name"].alias("name"), e["verdict"].alias("verdict"))))
    judged = rows.withColumn("best", best)
    return judged.select(
        F.col("key").alias(key), "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
