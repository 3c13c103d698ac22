import pytest
from pyspark.sql import functions as F

from rxweave.functions import scalars as S


def values(spark, build, given):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, s string").select("i", build(F.col("s")).alias("v")).orderBy("i").collect()
    return [r.v.asDict() if hasattr(r.v, "asDict") else r.v for r in rows]


def test_money_keeps_source_and_sign(spark):
    given = ["1234", "0", "5", "-5", "+150", "12C", "12L", "}", "{", "00000", "-000", "1.5", "", "abc", "9" * 60, None]
    found = values(spark, S.money, given)
    amounts = [None if v is None else v["amount"] for v in found]
    assert amounts == ["12.34", "0.00", "0.05", "-0.05", "1.50", "1.23", "-1.23", "0.00", "0.00", "0.00", "0.00", None, None, None, "9" * 58 + ".99", None]
    assert [v["isValid"] for v in found[:-1]] == [a is not None for a in amounts[:-1]] and all(v["source"] == s for v, s in zip(found[:-1], given))
    assert [v["isNegative"] for v in found[:7]] == [False, False, False, True, False, False, True] and not found[7]["isNegative"]


def test_three_implied_places(spark):
    assert values(spark, S.implied3, ["30000", "5", "0", "000123", "1a", "", None]) == ["30.000", "0.005", "0.000", "0.123", None, None, None]


@pytest.mark.parametrize(("text", "valid"), [("1", True), ("-1.50", True), ("1.", False), (".5", False), ("+1", False), ("1e3", False), ("", False), ("1\n", False)])
def test_decimal_values(spark, text, valid):
    assert values(spark, S.decimal_value, [text]) == [{"source": text, "isValid": valid}]


def test_ndc_segmentation(spark):
    given = ["12345-1234-12", "12345-1234-1", "12345-123-12", "1234-1234-12", "12345678901", "1234567890", "x", "", None]
    assert values(spark, S.ndc_segmentation, given) == ["5-4-2", "5-4-1", "5-3-2", "4-4-2", "11-digit", "10-digit", "unknown", "unknown", None]


def test_texts_are_trimmed_and_blank_is_absent(spark):
    given = [" a b ", " x﻿", "  ", "", None, "\x1ca\x1c", "a\n\nb\n"]
    assert values(spark, S.text_or_null, given) == ["a b", "x", None, None, None, "\x1ca\x1c", "a\n\nb"]


def test_prefix_integers(spark):
    assert [None if v is None else int(v) for v in values(spark, S.prefix_int, ["3abc", " 12", "-4", "x", "", None, "007"])] == [3, 12, -4, None, None, None, 7]


def test_code_systems(spark):
    assert values(spark, S.code_system, [" ndc ", "nothing", "", None])[1:] == ["UNKNOWN", "UNKNOWN", None]
    assert values(spark, S.code_system, [" ndc "]) == ["NDC"]


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT implied3('30000') AS a, ndc_segmentation('12345-1234-12') AS b, code_system('ndc') AS c, money_amount('12L') AS d").first()
    assert tuple(row) == ("30.000", "5-4-2", "NDC", "-1.23")
    given = [" ndc ", "\tndc\n", "\u00a0RxCUI\ufeff", "nothing", "", None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, q string")
    rows.createOrReplaceTempView("qualifiers")
    assert spark.sql("SELECT i, code_system(q) AS c FROM qualifiers").exceptAll(rows.select("i", S.code_system(F.col("q")).alias("c"))).count() == 0
