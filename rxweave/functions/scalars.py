"""Scalar functions over columns: exact strings in, exact strings out; no amount ever becomes a float."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave import codes

#: Unicode white space as trimmed at both ends; the three separators 0x1C-0x1E are not white space here.
BLANKS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"


MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def check_mode(mode: str, modes: Sequence[str] = MODES) -> None:
    if mode not in modes:
        raise ValueError(f"mode is one of {', '.join(modes)}; got {mode!r}")


def let(value: Column, build) -> Column:
    """``build(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def settled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same rows, with the columns ``names`` worked out once.

    A filter on them stays above: pushed below a chain of projections, it would repeat their expressions many times over.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline_outer(F.array(F.struct(*names))))


def running_sums(numbers: Column) -> Column:
    """The sum up to each place of an array of integers: places are added to those 1, 2, 4... before them, so the work grows
    as n log n, also for a hostile message."""

    def doubled(sums: Column, k: Column) -> Column:
        before = F.concat(F.array_repeat(F.lit(0), F.pow(F.lit(2), k).cast("int")), sums)
        return F.zip_with(sums, F.slice(before, F.lit(1), F.size(sums)), lambda a, b: a + b)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers))).cast("int") - 1)
    return F.when(F.size(numbers) > 1, F.aggregate(rounds, numbers, doubled)).otherwise(numbers)


def trim_blank(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def text_or_null(c: Column) -> Column:
    """Trimmed; blank is absent."""
    return F.nullif(trim_blank(c), F.lit(""))


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict[str, str], key: Column) -> Column:
    """The label of a code; null for a code outside the table. A literal map: no join."""
    pairs = F.expr("map(" + ", ".join(sql_text(x) for kv in table.items() for x in kv) + ")")
    return F.try_element_at(pairs, key)


def known(table: Iterable[str], key: Column) -> Column:
    return F.coalesce(F.array_contains(F.expr("array(" + ", ".join(map(sql_text, table)) + ")"), key), F.lit(False))


def prefix_int(c: Column) -> Column:
    """The integer that the text starts with (after white space), or null: ``3abc`` is 3."""
    return F.nullif(F.regexp_extract(c, f"^{BLANK}*([+-]?[0-9]+)", 1), F.lit("")).try_cast("decimal(38,0)")


def _implied(digits: Column, places: int) -> Column:
    def split(d: Column) -> Column:
        whole = F.regexp_replace(F.substring(d, F.lit(1), F.length(d) - places), "^0+(?=[0-9])", "")
        return F.concat(whole, F.lit("."), F.right(d, F.lit(places)))

    padded = F.when(F.length(digits) > places, digits).otherwise(F.lpad(digits, places + 1, "0"))
    return let(padded, split)


def implied3(c: Column) -> Column:
    """Three implied decimal places: ``30000`` is ``30.000``; null unless all digits."""
    return F.when(c.rlike("^[0-9]+\\z"), _implied(c, 3))


def quantity(c: Column) -> Column:
    return let(c, lambda s: F.when(s.isNotNull(), let(implied3(s), lambda a: F.struct(s.alias("source"), a.isNotNull().alias("isValid"), a.alias("impliedDecimal")))))


def money(c: Column) -> Column:
    """Two implied places; a leading sign, or a zoned sign in the last character. Minus zero is zero."""
    zoned = codes.OVERPUNCH_POSITIVE + codes.OVERPUNCH_NEGATIVE

    def digits(s: Column) -> Column:
        return (
            F.when(s.rlike("^[0-9]+\\z"), s)
            .when(s.rlike("^[+-][0-9]+\\z"), F.substring(s, 2, 1 << 30))
            .when(s.rlike("^[0-9]*[{A-I}J-R]\\z"), F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.translate(F.right(s, F.lit(1)), zoned, "0123456789" * 2)))
        )

    def signed(s: Column, plain: Column) -> Column:
        negative = (s.startswith("-") | s.rlike("[}J-R]\\z")) & (plain != "0.00")
        return F.struct(s.alias("source"), plain.isNotNull().alias("isValid"), F.when(negative, F.concat(F.lit("-"), plain)).otherwise(plain).alias("amount"), negative.alias("isNegative"))

    return let(c, lambda s: F.when(s.isNotNull(), let(let(digits(s), lambda d: _implied(d, 2)), lambda plain: signed(s, plain))))


def decimal_value(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c.alias("source"), c.rlike("^-?[0-9]+(\\.[0-9]+)?\\z").alias("isValid")))


def ndc_segmentation(c: Column) -> Column:
    shape = F.when(c.rlike("^[0-9]{11}\\z"), "11-digit").when(c.rlike("^[0-9]{10}\\z"), "10-digit")
    for name in ("5-4-2", "5-4-1", "5-3-2", "4-4-2"):
        a, b, d = name.split("-")
        shape = shape.when(c.rlike(f"^[0-9]{{{a}}}-[0-9]{{{b}}}-[0-9]{{{d}}}\\z"), name)
    return F.when(c.isNotNull(), shape.otherwise("unknown"))


def ndc_value(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c.alias("value"), ndc_segmentation(c).alias("segmentation")))


def code_system(qualifier: Column) -> Column:
    return F.when(qualifier.isNotNull(), F.coalesce(lookup(codes.CODE_SYSTEMS, F.upper(trim_blank(qualifier))), F.lit("UNKNOWN")))


def coded_value(value: Column, qualifier: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.coalesce(qualifier, F.lit("")).alias("qualifier"), code_system(F.coalesce(qualifier, F.lit(""))).alias("system")))


def approval(outcome: Column) -> Column:
    return lookup(codes.APPROVALS, outcome)


def disposition_of_kind(kind: Column) -> Column:
    return lookup(codes.RESPONSE_MEANING, kind)


def register(spark: SparkSession) -> None:
    """SQL functions of the session: money_amount, implied3, ndc_segmentation, code_system. They are SQL, not Python."""
    blank = BLANK.replace("\\", "\\\\")  # as a SQL string spells it
    sql = {
        "implied3": ("s STRING", "STRING", "CASE WHEN s RLIKE '^[0-9]+\\\\z' THEN concat(regexp_replace(substring(lpad(s, greatest(length(s), 4), '0'), 1, greatest(length(s), 4) - 3), '^0+(?=[0-9])', ''), '.', right(lpad(s, greatest(length(s), 4), '0'), 3)) END"),
        "ndc_segmentation": ("s STRING", "STRING", "CASE WHEN s IS NULL THEN NULL WHEN s RLIKE '^[0-9]{5}-[0-9]{4}-[0-9]{2}\\\\z' THEN '5-4-2' WHEN s RLIKE '^[0-9]{5}-[0-9]{4}-[0-9]\\\\z' THEN '5-4-1' WHEN s RLIKE '^[0-9]{5}-[0-9]{3}-[0-9]{2}\\\\z' THEN '5-3-2' WHEN s RLIKE '^[0-9]{4}-[0-9]{4}-[0-9]{2}\\\\z' THEN '4-4-2' WHEN s RLIKE '^[0-9]{11}\\\\z' THEN '11-digit' WHEN s RLIKE '^[0-9]{10}\\\\z' THEN '10-digit' ELSE 'unknown' END"),
        "code_system": ("q STRING", "STRING", "CASE WHEN q IS NOT NULL THEN coalesce(try_element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in codes.CODE_SYSTEMS.items()) + f"), upper(regexp_replace(q, '^{blank}+|{blank}+\\\\z', ''))), 'UNKNOWN') END"),
        "money_amount": ("s STRING", "STRING", "(SELECT CASE WHEN neg AND d NOT RLIKE '^0*\\\\z' THEN '-' ELSE '' END || regexp_replace(substring(lpad(d, greatest(length(d), 3), '0'), 1, greatest(length(d), 3) - 2), '^0+(?=[0-9])', '') || '.' || right(lpad(d, greatest(length(d), 3), '0'), 2) FROM (SELECT CASE WHEN s RLIKE '^[0-9]+\\\\z' THEN s WHEN s RLIKE '^[+-][0-9]+\\\\z' THEN substring(s, 2) WHEN s RLIKE '^[0-9]*[{A-I}J-R]\\\\z' THEN substring(s, 1, length(s) - 1) || translate(right(s, 1), '{ABCDEFGHI}JKLMNOPQR', '01234567890123456789') END AS d, s LIKE '-%' OR s RLIKE '[}J-R]\\\\z' AS neg))"),
    }
    for name, (args, kind, body) in sql.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
