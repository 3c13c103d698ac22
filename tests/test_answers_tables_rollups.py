import random

import pytest
from pyspark.sql import functions as F

from rxweave.operators import answers, code_tables, rollups

DAY = "2024-01-01 "
#: id, key, time of requests; id, time of answers
ASKED = [("a", 1, "00:00:00"), ("b", 2, "00:10:00"), ("c", 3, "00:20:00"), ("d", 4, "00:30:00"), ("d", 5, "00:30:00"), ("e", 6, "00:40:00"), (None, 7, "00:40:00")]
TOLD = [("a", "00:00:00"), ("a", "00:30:00"), ("a", "00:30:00"), ("b", "00:09:59"), ("b", "01:10:00"), ("c", "01:20:01"), ("x", "00:05:00"), (None, "00:05:00")]
WANT = {(1, "a", "answered", 3, 0), (2, "b", "answered", 1, 1), (3, "c", "unanswered", 0, 0), (4, "d", "unanswered", 0, 0), (6, "e", "unanswered", 0, 0)}


def asked(spark, rows):
    return spark.createDataFrame([(i, k, DAY + t) for i, k, t in rows], "i string, key long, t string").select(F.struct(F.col("i").alias("messageId")).alias("header"), "key", F.col("t").cast("timestamp").alias("t"))


def told(spark, rows):
    return spark.createDataFrame([(i, DAY + t) for i, t in rows], "correlatesTo string, t string").select("correlatesTo", F.col("t").cast("timestamp").alias("t"), F.lit(None).cast("long").alias("key"))


def shown(rows):
    return {(r.request_id, r.id, r.outcome, r.n_answers, r.n_early) for r in rows}


def test_answered_requests(spark):
    found = answers.answered_requests(asked(spark, ASKED), told(spark, TOLD), "key", "t", "1 hour")
    rows = found.collect()
    assert shown(rows) == WANT and len(rows) == len(WANT)
    assert {r.id: str(r.first_answer)[11:] for r in rows if r.first_answer} == {"a": "00:00:00", "b": "01:10:00"}
    assert answers.answered_requests(asked(spark, ASKED[:0]), told(spark, TOLD), "key", "t").count() == 0
    assert {r.outcome for r in answers.answered_requests(asked(spark, ASKED), told(spark, TOLD[:0]), "key", "t").collect()} == {"unanswered"}


def test_a_stream_in_three_batches_has_the_rows_of_the_table(spark, tmp_path):
    """Answers before their request, after it in another batch, repeated, and after the deadline; the last batch only moves time on."""
    batches = [(ASKED[:2] + [("late", 8, "00:01:00")], TOLD[:1] + TOLD[3:4] + TOLD[6:]), (ASKED[2:], TOLD[1:3] + TOLD[4:6]), ([("end", 9, "23:00:00")], [])]
    for n, (a, b) in enumerate(batches):
        for side, df in (("asked", asked(spark, a)), ("told", told(spark, b))):
            df.coalesce(1).write.parquet(f"file://{tmp_path}/{side}/{n}")
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        read = lambda side, like: spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{side}/*")
        stream = answers.answered_request_stream(read("asked", asked(spark, ASKED)), read("told", told(spark, TOLD)), "key", "t", 3_600, "2 hours")
        query = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").collect()
    finally:
        spark.conf.unset(name)
    assert shown(found) == WANT | {(8, "late", "unanswered", 0, 0)} and len(found) == len(WANT) + 1


@pytest.mark.parametrize(("plan", "literal", "bytes_"), [("literal", 1_000_000, 1), ("broadcast", 0, 1 << 30), ("shuffle", 0, 0)])
def test_all_plans_name_codes_alike(spark, monkeypatch, plan, literal, bytes_):
    monkeypatch.setattr(code_tables, "LITERAL_ROWS", literal)
    monkeypatch.setattr(code_tables, "BROADCAST_BYTES", bytes_)
    table = spark.createDataFrame([("75", "Prior"), ("AG", None), (None, "x"), ("it's", "a \\ b")], "code string, name string")
    rows = spark.createDataFrame([(1, "75", "n"), (1, "75", "n"), (2, "ZZ", "n"), (3, None, "n"), (4, "AG", "n"), (5, "it's", "n")], "i int, c string, name string")
    assert code_tables.plan_for(table) == plan
    found = code_tables.with_code_name(rows, "c", table, "called")
    assert sorted((r.i, r.called, r.called_known) for r in found.collect()) == [(1, "Prior", True), (1, "Prior", True), (2, None, False), (3, None, False), (4, None, True), (5, "a \\ b", True)]
    assert [tuple(r) for r in code_tables.unknown_codes(rows, "c", table).collect()] == [("ZZ", 1)]
    empty = code_tables.with_code_name(rows, "c", table.limit(0), "called")
    assert empty.where("called_known").count() == 0 and empty.count() == 6


def test_a_table_of_100000_codes_names_as_the_built_in_one(spark, tmp_path):
    from rxweave import codes
    from rxweave.functions.scalars import lookup

    filler = spark.range(100_000).select(F.concat(F.lit("#"), "id").alias("code"), F.lit("none").alias("name"))
    filler.unionByName(spark.createDataFrame(list(codes.REJECT_CODES.items()), "code string, name string")).write.parquet(f"file://{tmp_path}/codes")
    table = spark.read.parquet(f"file://{tmp_path}/codes")
    assert code_tables.plan_for(table) == "broadcast"
    rows = spark.createDataFrame([(c,) for c in [*codes.REJECT_CODES, "ZZ", "2x"]], "c string").withColumn("want", lookup(codes.REJECT_CODES, F.col("c")))
    found = code_tables.with_code_name(rows, "c", table, "called")
    assert found.where("NOT called <=> want OR called_known <> (want IS NOT NULL)").count() == 0
    with pytest.raises(ValueError):
        code_tables.plan_for(table.unionByName(table.limit(1)))


def test_states_of_days_merge_to_the_state_of_all(spark):
    rnd = random.Random(5)
    rows = [(f"d{rnd.randrange(30)}", rnd.choice("xy"), f"m{rnd.randrange(9_000)}", rnd.random() < 0.2, rnd.randrange(1_000_000)) for _ in range(40_000)]
    df = spark.createDataFrame([*rows, ("d1", "x", None, None, None)], "day string, p string, m string, r boolean, c long").repartition(7)
    state = rollups.daily_state(df, ["day", "p"], F.col("m"), F.col("r"), F.col("c"))
    found = {r.p: r for r in rollups.estimates(rollups.combined(state, [["p"], []], ["p"])).collect()}
    for p, r in found.items():
        ours = [x for x in rows if p in (None, x[1])]
        assert (r.n, r.n_rejected, r.paid_cents) == (len(ours) + (p != "y"), sum(x[3] for x in ours), sum(x[4] for x in ours))
        exact = len({x[2] for x in ours})
        assert abs(r.members - exact) <= 0.05 * exact
        for q, v in ((0.5, r.paid_p50), (0.9, r.paid_p90)):
            assert abs(sum(x[4] <= v for x in ours) / len(ours) - q) < 0.03
    assert set(found) == {"x", "y", None}
    nothing = rollups.estimates(rollups.daily_state(df.where("m IS NULL"), ["p"], F.col("m"), F.col("r"), F.col("c"))).first()
    assert (nothing.n, nothing.n_rejected, nothing.paid_cents, nothing.members, nothing.paid_p50) == (1, 0, 0, 0, None)
