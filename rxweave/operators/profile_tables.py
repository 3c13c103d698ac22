"""Trading-partner profiles as tables: thousands of partners that extend each other, merged by joins and groupings.

Three tables: ``profiles`` (name, description), ``parents`` (name, parent, ord) and ``quirks`` (name, ord, id, standard, effect,
summary, fixture, source_category, expected_warnings). The rules are those of ``profiles.define_profile``: the layers of a profile are
those of its parents in their order, each with its own parents first, and then its own. A later layer's quirk replaces one
of the same id at the place where the id was first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxweave.operators.profiles import EFFECTS, STANDARDS, WARNING_CODES, ProfileError

QUIRK = ("standard", "effect", "summary", "fixture", "source_category", "expected_warnings")
#: The place of a profile's own layer among its parents': after all of them.
_OWN = (1 << 31) - 1


def quirk_problems(quirks: DataFrame) -> DataFrame:
    """(name, id, problem) of rows that no profile may have; the first problem of each row, in a fixed order."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    kebab = F.coalesce(F.col("id").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*\\z"), F.lit(False))
    path = F.coalesce(F.col("fixture").rlike("^[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)+\\z"), F.lit(False))
    listed = F.coalesce(F.forall("expected_warnings", lambda c: c.isin(*sorted(WARNING_CODES))), F.lit(True))
    twice = F.count("*").over(Window.partitionBy("name", "id")) > 1
    problem = (
        F.when(~kebab, "an id in kebab case").when(twice, "an id of its own").when(~F.coalesce(F.col("standard").isin(*STANDARDS), F.lit(False)), "a standard").when(~F.coalesce(F.col("effect").isin(*EFFECTS), F.lit(False)), "an effect")
        .when(~filled("summary"), "a summary").when(~path, "a relative fixture path").when(~filled("source_category"), "a source category").when(~listed, "known warning codes")
    )
    return quirks.select("name", "id", problem.alias("problem")).where("problem IS NOT NULL")


def layers_of(profiles: DataFrame, parents: DataFrame) -> DataFrame:
    """(name, layer, at): every layer of every profile; ``at`` is an array whose order is that of the layers.

    A join a level: as many as the longest line of parents. A profile that is its own ancestor is a ProfileError, and so is
    a parent that isn't there.
    """
    stray = parents.join(profiles.select(F.col("name").alias("parent")), "parent", "left_anti").first()
    if stray is not None:
        raise ProfileError(f"profile {stray['name']!r} extends {stray['parent']!r}, which isn't there", stray["name"])
    found = frontier = profiles.select("name", F.col("name").alias("layer"), F.array().cast("array<int>").alias("path"))
    edges = parents.select(F.col("name").alias("layer"), "parent", F.col("ord").cast("int").alias("ord"))
    while True:
        frontier = frontier.join(edges, "layer").select("name", F.col("parent").alias("layer"), F.array_append("path", F.col("ord")).alias("path"))
        reached = frontier.groupBy().agg(F.count("*").alias("n"), F.min(F.when(F.col("name") == F.col("layer"), F.col("name"))).alias("own")).first()
        if reached["own"] is not None:
            raise ProfileError(f"profile {reached['own']!r} is among its own parents", reached["own"])
        if not reached["n"]:
            return found.select("name", "layer", F.array_append("path", F.lit(_OWN)).alias("at"))
        found = found.unionByName(frontier)


def merge_quirks(layers: DataFrame, quirks: DataFrame) -> DataFrame:
    """(name, ord, id, and QUIRK): the quirks of each profile, merged."""
    own = quirks.select(F.col("name").alias("layer"), F.col("ord").cast("int").alias("own_ord"), "id", F.struct(*QUIRK).alias("quirk"))
    place = F.array_append("at", F.col("own_ord"))
    merged = layers.join(own, "layer").groupBy("name", "id").agg(F.min(place).alias("first"), F.max_by("quirk", place).alias("quirk"))
    ord = F.row_number().over(Window.partitionBy("name").orderBy("first")) - 1
    return merged.select("name", ord.alias("ord"), "id", *[F.col(f"quirk.{c}").alias(c) for c in QUIRK])


def describe_profiles(profiles: DataFrame, layers: DataFrame, merged: DataFrame) -> DataFrame:
    """A row for each profile: name, description (its own, else that of the last layer with one), lineage (every layer once, at its
    first place), standards, expected_warnings (both sorted), and the number of quirks of each effect."""
    told = layers.join(profiles.select(F.col("name").alias("layer"), "description"), "layer")
    once = told.groupBy("name", "layer").agg(F.min("at").alias("first"), F.max_by("description", F.when(F.col("description").isNotNull(), F.col("at"))).alias("description"), F.max(F.when(F.col("description").isNotNull(), F.col("at"))).alias("told"))
    lines = once.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "layer"))), lambda x: x["layer"]).alias("lineage"), F.max_by("description", "told").alias("description"))
    sets = merged.groupBy("name").agg(
        F.sort_array(F.collect_set("standard")).alias("standards"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("expected_warnings")))).alias("expected_warnings"),
        *[F.count_if(F.col("effect") == e).alias(f"n_{e}") for e in EFFECTS],
    )
    none = F.array().cast("array<string>")
    return lines.join(sets, "name", "left").select(
        "name", "description", "lineage", F.coalesce("standards", none).alias("standards"), F.coalesce("expected_warnings", none).alias("expected_warnings"), *[F.coalesce(f"n_{e}", F.lit(0)).alias(f"n_{e}") for e in EFFECTS]
    )


def partition_warnings_by(parsed: DataFrame, described: DataFrame, profile: Column | str) -> DataFrame:
    """As ``profiles.partition_warnings``, by the profile that each row names; an unknown or no profile expects nothing."""
    wanted = described.select(F.col("name").alias("_profile"), F.col("expected_warnings").alias("_wanted"))
    joined = parsed.withColumn("_by", profile if isinstance(profile, Column) else F.col(profile)).join(wanted, F.col("_by") == F.col("_profile"), "left")
    joined = joined.withColumn("_wanted", F.coalesce("_wanted", F.array().cast("array<string>")))
    listed = lambda w: F.array_contains("_wanted", w["code"])
    return joined.select("*", F.filter("warnings", listed).alias("expected"), F.filter("warnings", lambda w: ~listed(w)).alias("unexpected")).drop("_by", "_profile", "_wanted")
