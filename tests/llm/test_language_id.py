import numpy as np
from pyspark.sql import functions as F

from rxweave.llm.language_id import identify, train
from rxweave.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op6_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_held_out_labels_and_other_columns_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in identify(x, ~held).collect()} for x in (docs, changed))
    assert a == b


def test_a_mixture_names_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 2000")
    model = train(docs)
    some = {r.lang: r.text for r in docs.groupBy("lang").agg(F.first("text").alias("text")).collect()}
    names = sorted(some)
    for a, b in zip(names, names[1:] + names[:1], strict=True):
        pred, score, mixture = model.infer(some[a][:2000] + " " + some[b][:1000])
        assert pred == a and {a, b} <= {lang for lang, _ in mixture} and 0.4 < score < 0.95
        assert abs(sum(s for _, s in mixture) - 1) < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "some words here", "en"), (1, None, "en"), (2, "", "en"), (3, "123 !?", None), (3, "123 !?", None), (4, "mots " * 300000, "fr")], "doc_id long, text string, lang string")
    docs = docs.withColumn("lang_pred", F.lit("x")).withColumn("key", F.lit(1))
    found = [(r.doc_id, r.lang_pred) for r in identify(docs, F.lit(True)).collect()]
    assert sorted(found, key=str) == sorted([(None, "en"), (1, "und"), (2, "und"), (3, "und"), (3, "und"), (4, "fr")], key=str)
    assert {r.lang_pred for r in identify(docs, F.lit(False)).collect()} == {"und"}
    assert identify(docs.limit(0), F.lit(True)).count() == 0
