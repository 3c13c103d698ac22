"""The SQL table function of nodes has the rows of its DataFrame form, refused and unreadable texts included."""

import random

import pytest

from rxweave.operators import prescriptions as P
from rxweave.sources import xml

ODD = [
    None, "", "  \n", "plain", "<a", "<a>", "</a>", "<a/><b/>", "<a></a></a><b/>", "<a></a></a>", "<a x='1' y=\"2\" x='3'>t<b>u</b>v</a>", "<!DOCTYPE a><a/>", "<a><!ENTITY x 'y'></a>", "<a><!doctype></a>", "<!DOCTYPES><a/>",
    "<a><![CDATA[<b>]]></a>", "<a><!-- <b> --></a>", "<?xml version='1.0'?><?pi z?><n:a n:x='1'><n:b/></n:a>", "<a>" * 300, "<a>é\U0001f600&amp;</a>",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    pieces = ["<a>", "</a>", "<b x='1'>", "</b>", "<c/>", "text", "<!-- n -->", "<![CDATA[x<]]>", "<?p q?>", "<!ENTITY", "<", ">", "&lt;", "<!DOCTYPE x>"]
    weights = [6, 6, 4, 4, 4, 6, 1, 1, 1, 0.05, 0.05, 1, 1, 0.05]
    made = ["".join(rng.choices(pieces, weights, k=rng.randrange(1, 25))) for _ in range(1500)]
    return spark.createDataFrame(list(enumerate(ODD + made)), "k int, payload string")


def test_function_and_dataframe_agree(spark, texts):
    xml.register(spark)
    through_sql = spark.sql("SELECT m.k, n.* FROM {m} AS m, LATERAL script_nodes(m.payload) AS n", m=texts)
    key = lambda df: sorted(map(repr, df.selectExpr("k", "id", "parent", "last", "depth", "name", "text", "map_entries(attrs) AS attrs").collect()))
    found = key(through_sql)
    assert found == key(P.script_nodes(texts, "k")) and len(found) > 1500


def test_refused_texts_have_no_rows(spark, texts):
    refused = texts.where("payload RLIKE '(?i)<!(DOCTYPE|ENTITY)([^A-Za-z0-9_]|$)'")
    assert refused.count() >= 3 and P.script_nodes(refused, "k").count() == 0
    assert P.parse_scripts(refused).where("fatal IS NULL").count() == 0
