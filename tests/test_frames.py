"""The message data source: what is written is read back; a failing task, a restart and a stream leave whole batches only."""

import os

import pytest
from pyspark.sql import functions as F

from rxweave.operators import claims as C
from rxweave.plans.encoders import claim_messages
from rxweave.sources import frames
from rxweave.sources.files import read_messages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def registered(spark):
    frames.register(spark)
    return spark


def visible(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if "/_" not in d)


def load(spark, path):
    return sorted(((r["key"], bytes(r["payload"])) for r in spark.read.format("rx_messages").load(str(path)).collect()), key=repr)


def test_claims_are_read_back_as_they_were_written(registered, tmp_path):
    made = claim_messages(registered, SF, "request").select(F.concat_ws("-", "k", "ln").alias("key"), F.col("request").alias("wire"), F.lit(1).alias("extra"))
    path = f"file://{tmp_path}/claims"
    made.write.format("rx_messages").option("payload", "wire").option("encoding", "latin-1").mode("append").save(path)
    back = registered.read.format("rx_messages").load(path)
    assert back.count() == made.count()
    same = made.join(back, "key").where(F.encode("wire", "ISO-8859-1") == F.col("payload"))
    assert same.count() == made.count()
    parsed = C.parse_claims(back, "payload")
    assert parsed.where("kind = 'request'").count() == C.parse_claims(made, "wire").where("kind = 'request'").count()
    assert not [d for d in os.listdir(tmp_path / "claims") if d.startswith("_")]


def test_odd_rows(registered, tmp_path, monkeypatch):
    rows = [(None, b"x"), ("a", b""), ("a", b""), ("é/../b", b"\x1d\x1e\n\r\x00"), ("", b"empty key"), ("long", b"z" * 3_000_000)]
    registered.createDataFrame(rows, frames.SCHEMA).repartition(3).write.format("rx_messages").mode("append").save(str(tmp_path))
    assert load(registered, tmp_path) == sorted(rows, key=repr)
    registered.createDataFrame([], frames.SCHEMA).write.format("rx_messages").mode("append").save(str(tmp_path))
    assert len(load(registered, tmp_path)) == len(rows)
    registered.createDataFrame([("new", b"1")], frames.SCHEMA).write.format("rx_messages").mode("overwrite").save(str(tmp_path))
    assert load(registered, tmp_path) == [("new", b"1")]
    with pytest.raises(Exception, match="without a payload"):
        registered.createDataFrame([("k", None)], frames.SCHEMA).write.format("rx_messages").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="layout is one of"):
        registered.createDataFrame(rows, frames.SCHEMA).write.format("rx_messages").option("layout", "rows").mode("append").save(str(tmp_path))
    assert load(registered, tmp_path) == [("new", b"1")]


def test_a_file_each(registered, tmp_path):
    rows = [("one/two", b"\x02first"), ("one/two", b"second"), ("n" * 300, b"third"), (None, b"fourth")]
    registered.createDataFrame(rows, frames.SCHEMA).repartition(2).write.format("rx_messages").options(layout="files", suffix=".clm").mode("append").save(str(tmp_path))
    assert sorted(bytes(r["payload"]) for r in read_messages(registered, str(tmp_path), "*.clm").collect()) == sorted(p for _, p in rows)


def test_a_failing_task_leaves_no_file(registered, tmp_path):
    good = registered.createDataFrame([("kept", b"1")], frames.SCHEMA)
    good.write.format("rx_messages").mode("append").save(str(tmp_path))
    before = visible(tmp_path)
    bad = registered.range(0, 4000, 1, 8).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 3999, F.raise_error("lost").cast("binary")).otherwise(F.col("id").cast("string").cast("binary")).alias("payload"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("rx_messages").mode("append").save(str(tmp_path))
    assert visible(tmp_path) == before
    assert not [d for d in os.listdir(tmp_path) if d.startswith("_")]
    assert load(registered, tmp_path) == [("kept", b"1")]


def test_attempts_that_spark_does_not_report_are_never_shown(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array([b"v"])], names=["key", "payload"])
    writer = frames.TableWriter({"path": str(tmp_path)}, False)
    lost, told = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.folder != told.folder and not visible(tmp_path)
    writer.commit([told, None, frames.Staged(None)])
    reader = frames.FrameReader({"path": str(tmp_path)})
    assert [b.to_pydict() for p in reader.partitions() for b in reader.read(p)] == [{"key": ["k"], "payload": [b"v"]}]


def test_a_batch_committed_again_stays_once_and_cut_files_are_refused(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["k"]), pa.array([b"value"])], names=["key", "payload"])
    for _ in range(2):  # the second as after a restart between the commit and its note in the checkpoint
        writer = frames.StreamWriter({"path": str(tmp_path)})
        writer.commit([writer.write(iter([batch]))], 7)
    (path,) = visible(tmp_path)
    reader = frames.FrameReader({"path": str(tmp_path)})
    for cut in (3, 10):
        whole = open(path, "rb").read()
        open(path, "wb").write(whole[:-cut])
        with pytest.raises(ValueError, match="inside a frame"):
            list(reader.read(reader.partitions()[0]))
        open(path, "wb").write(whole)


def test_a_stream_in_three_batches_and_a_restart(registered, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    want = []
    for n in range(3):
        rows = [(f"{n}-{i}", f"payload {i}".encode()) for i in range(50)]
        want += rows
        registered.createDataFrame(rows, frames.SCHEMA).repartition(2).write.mode("append").parquet(str(source))
        stream = registered.readStream.schema(frames.SCHEMA).parquet(str(source))
        query = stream.writeStream.format("rx_messages").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert load(registered, out) == sorted(want, key=repr)
    assert not [d for d in os.listdir(out) if d.startswith("_")]
