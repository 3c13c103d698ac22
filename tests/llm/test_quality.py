import numpy as np
from pyspark.sql import functions as F

from rxweave.llm.common import crc_of_id
from rxweave.llm.queries import QUERIES
from rxweave.llm.quality import fit_network, score_quality


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable")) + 1
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_documents_are_ranked_by_quality(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op2_quality"](spark, sf)
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    y = rows["quality"].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > 0.9
    assert rows["predicted"][y == 1].mean() > 0.9
    assert ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all() and rows["score"].between(0, 1).all()


def test_training_rows_alone_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = crc_of_id() % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in score_quality(docs, x, ~held).collect()} for x in (labels, turned))
    assert a == b and len(a) == docs.count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "good text"), (1, None), (2, ""), (2, ""), (3, "word " * 200000)], "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("rest", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, none, F.lit(True)).collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (1, 0)], "doc_id long, quality int")
    rows = score_quality(docs, some, F.lit(True)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(docs.limit(0), some, F.lit(True)).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(3000) < p).astype(float)
    net = fit_network(x[:2000], y[:2000])
    found = net.probability(x[2000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (found >= low) & (found < low + 0.25)
        assert abs(found[part].mean() - p[2000:][part].mean()) < 0.12


def test_labels_without_a_document_do_not_use_up_the_bound(spark):
    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "bad junk there ") * 5) for k in range(1, 101)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(1, 101)]
    more = labels + [(k, 1 - k % 2) for k in range(1000, 21000)]
    a, b = ({r.doc_id: r.score for r in score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int"), F.lit(True), train_rows=200).collect()} for x in (labels, more))
    assert a == b and a[1] > 0.5 > a[2]
