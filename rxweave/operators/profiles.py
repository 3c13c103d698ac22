"""Trading-partner profiles: small descriptions of conventions. They never change how a message is read."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave import codes

STANDARDS, EFFECTS = ("script", "telecom"), ("relaxes", "adds", "requires")
OPTIONS = ("name", "description", "quirks", "extends")
WARNING_CODES = {*codes.CLAIM_WARNINGS, *codes.SCRIPT_WARNINGS}


class ProfileError(ValueError):
    def __init__(self, message: str, profile: str | None = None) -> None:
        super().__init__(message)
        self.profile = profile


@dataclass(frozen=True)
class Quirk:
    id: str
    standard: str
    effect: str
    summary: str
    fixture: str
    source_category: str
    expected_warnings: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    name: str
    lineage: tuple[str, ...]
    quirks: tuple[Quirk, ...] = field(default=())
    description: str | None = None

    @property
    def expected_warnings(self) -> list[str]:
        return sorted({c for q in self.quirks for c in q.expected_warnings})

    @property
    def standards(self) -> list[str]:
        return sorted({q.standard for q in self.quirks})

    def describe(self) -> dict:
        by_effect = {e: [q for q in self.quirks if q.effect == e] for e in EFFECTS}
        rest = {"name": self.name, "lineage": list(self.lineage), "standards": self.standards, "expectedWarnings": self.expected_warnings}
        return rest | by_effect | ({} if self.description is None else {"description": self.description})


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def check_options(options: Mapping[str, object]) -> None:
    name = options.get("name")
    if not isinstance(name, str) or not name.strip():
        raise ProfileError(f"a profile needs a name, a string that isn't blank; got {name!r}", name if isinstance(name, str) else None)
    for key in options:
        if key not in OPTIONS:
            hint = next((o for o in OPTIONS if _distance(key, o) <= 2), None)
            raise ProfileError(f"profile {name!r} has an unknown option {key!r}" + (f"; did you mean {hint!r}?" if hint else ""), name)


def check_quirks(quirks: Sequence[Quirk], profile: str) -> None:
    seen: set[str] = set()
    for q in quirks:
        if not isinstance(q, Quirk):
            raise ProfileError(f"profile {profile!r}: {q!r} isn't a quirk", profile)
        checks = (
            (isinstance(q.id, str) and re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", q.id), "an id in kebab case"), (q.id not in seen, "an id of its own"),
            (q.standard in STANDARDS, f"a standard of {STANDARDS}"), (q.effect in EFFECTS, f"an effect of {EFFECTS}"), (isinstance(q.summary, str) and q.summary.strip(), "a summary"),
            (isinstance(q.fixture, str) and re.fullmatch(r"[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)+", q.fixture), "a relative fixture path"),
            (isinstance(q.source_category, str) and q.source_category.strip(), "a source category"), (all(c in WARNING_CODES for c in q.expected_warnings), "known warning codes"),
        )
        for ok, what in checks:
            if not ok:
                raise ProfileError(f"profile {profile!r}: quirk {q.id!r} needs {what}", profile)
        seen.add(q.id)


def define_profile(**options) -> Profile:
    """Check, merge with the parents in ``extends`` (a profile or several), check again.

    A quirk of a later layer replaces one of the same id at its first place; the description is the own one, else that of
    the last parent with one; the lineage lists every ancestor once, the profile last.
    """
    check_options(options)
    name, own = options["name"], tuple(options.get("quirks") or ())
    check_quirks(own, name)
    extends = options.get("extends")
    parents = [] if extends is None else [extends] if isinstance(extends, Profile) else list(extends)
    lineage = dict.fromkeys(n for p in parents for n in (p.lineage or (p.name,)))
    lineage.setdefault(name)
    merged: dict[str, Quirk] = {}
    for layer in [*(p.quirks for p in parents), own]:
        for q in layer:
            merged[q.id] = q
    described = [p.description for p in parents if p.description is not None]
    description = options.get("description")
    quirks = tuple(merged.values())
    check_quirks(quirks, name)
    return Profile(name, tuple(lineage), quirks, description if description is not None else described[-1] if described else None)


SURESCRIPTS = define_profile(
    name="surescripts",
    description="Network conventions for e-prescribing: routing identifiers",
    quirks=[Quirk("routing-identifiers", "script", "adds", "To and From of the header carry the network's routing identifiers.", "prescriptions/routing.xml", "Network guide: message routing")],
)
PBM = define_profile(
    name="pbm",
    description="Payer conventions for claims: person code, a deeper reject taxonomy, alerts on responses",
    quirks=[
        Quirk("person-code-required", "telecom", "requires", "The insurance segment carries a person code.", "claims/person-code.txt", "Payer sheets: person code"),
        Quirk("reject-code-depth", "telecom", "adds", "Responses carry reject codes beyond the core table.", "claims/unknown-reject.txt", "Payer sheets: reject codes", ("UNKNOWN_REJECT_CODE",)),
        Quirk("response-dur-segment", "telecom", "adds", "A paid response carries an alert segment too.", "claims/response-alert.txt", "Payer sheets: clinical alerts"),
    ],
)
BUILT_IN = {p.name: p for p in (SURESCRIPTS, PBM)}
_DEFAULT = "rxweave.profile"


def set_default_profile(spark: SparkSession, profile: Profile | None, known: Mapping[str, Profile] = BUILT_IN) -> None:
    """The session's default; None takes it away."""
    if profile is None:
        spark.conf.unset(_DEFAULT)
    else:
        if profile.name not in known:
            raise ProfileError(f"profile {profile.name!r} isn't among the known ones", profile.name)
        spark.conf.set(_DEFAULT, profile.name)


def get_default_profile(spark: SparkSession, known: Mapping[str, Profile] = BUILT_IN) -> Profile | None:
    return known.get(spark.conf.get(_DEFAULT, None))


UNSET = object()


def resolve_profile(spark: SparkSession, explicit: object = UNSET, known: Mapping[str, Profile] = BUILT_IN) -> Profile | None:
    """An explicit profile, or None to opt out, comes before the session's default."""
    return get_default_profile(spark, known) if explicit is UNSET else explicit


def partition_warnings(parsed: DataFrame, profile: Profile) -> DataFrame:
    """Add ``expected`` and ``unexpected``: the warnings in their order, by whether the profile lists their code."""
    wanted = F.array(*map(F.lit, profile.expected_warnings)).cast("array<string>")
    listed = lambda w: F.array_contains(wanted, w["code"])
    return parsed.select("*", F.filter("warnings", listed).alias("expected"), F.filter("warnings", lambda w: ~listed(w)).alias("unexpected"))


def profile_rows(spark: SparkSession, profiles: Sequence[Profile] = tuple(BUILT_IN.values())) -> DataFrame:
    """A row for each quirk of each profile, as a dimension table."""
    rows = [(p.name, p.description, n, q.id, q.standard, q.effect, q.summary, q.fixture, q.source_category, list(q.expected_warnings)) for p in profiles for n, q in enumerate(p.quirks)]
    return spark.createDataFrame(rows, "profile string, description string, ord int, id string, standard string, effect string, summary string, fixture string, sourceCategory string, expectedWarnings array<string>")


def expected_flag(code: Column, profile: Profile) -> Column:
    return code.isin(*profile.expected_warnings) if profile.expected_warnings else F.lit(False)
