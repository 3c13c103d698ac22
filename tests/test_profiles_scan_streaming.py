import pytest

from rxweave import streaming
from rxweave.operators import claims, profiles, scan
from rxweave.operators.profiles import Profile, ProfileError, Quirk, define_profile
from rxweave.sources.files import read_messages

FS, GS, RS = "\x1c", "\x1d", "\x1e"
PAID = "D0B11A011234567890     20240101" + GS + FS.join(["AM21", "ANP"])
REJECTED = "D0B11A011234567890     20240101" + GS + FS.join(["AM21", "ANR", "FA1", "FBXX"])


def quirk(id="some-quirk", **other):
    return Quirk(**{"id": id, "standard": "telecom", "effect": "adds", "summary": "s", "fixture": "a/b.txt", "source_category": "guide"} | other)


@pytest.mark.parametrize("bad", [{"id": "Not Kebab"}, {"standard": "x"}, {"effect": "x"}, {"summary": " "}, {"fixture": "/etc/x"}, {"source_category": ""}, {"expected_warnings": ("X",)}])
def test_bad_quirks_are_refused(bad):
    with pytest.raises(ProfileError):
        define_profile(name="p", quirks=[quirk(**bad)])


def test_names_options_and_hints():
    for options in ({}, {"name": " "}, {"name": "p", "quirk": []}):
        with pytest.raises(ProfileError):
            define_profile(**options)
    with pytest.raises(ProfileError, match="did you mean 'quirks'"):
        define_profile(name="p", quirk=[])


def test_later_layers_replace_quirks_at_their_first_place():
    a = define_profile(name="a", description="A", quirks=[quirk("x", summary="old"), quirk("y")])
    b = define_profile(name="b", extends=a, quirks=[quirk("x", summary="new"), quirk("z")])
    c = define_profile(name="c", extends=[b, a])
    assert [(q.id, q.summary) for q in b.quirks] == [("x", "new"), ("y", "s"), ("z", "s")]
    assert b.lineage == ("a", "b") and c.lineage == ("a", "b", "c") and c.description == "A" and [q.summary for q in c.quirks if q.id == "x"] == ["old"]


def test_defaults_and_partitions(spark):
    assert profiles.get_default_profile(spark) is None
    profiles.set_default_profile(spark, profiles.PBM)
    assert profiles.resolve_profile(spark) == profiles.PBM and profiles.resolve_profile(spark, None) is None
    profiles.set_default_profile(spark, None)
    with pytest.raises(ProfileError):
        profiles.set_default_profile(spark, Profile("other", ("other",)))
    parsed = claims.parse_claims(spark.createDataFrame([(1, REJECTED)], "i int, payload string"))
    row = profiles.partition_warnings(parsed, profiles.PBM).first()
    assert [w.code for w in row.expected] == ["UNKNOWN_REJECT_CODE"] and len(row.expected) + len(row.unexpected) == len(row.warnings)


def test_scan_finds_what_the_allow_list_lacks(spark, tmp_path):
    (tmp_path / "allow.txt").write_text("# names\nname: Testcase\nemail-domain: example.com\ndob: 19800101\n")
    allow = scan.load_allow_list(spark, f"file://{tmp_path}/allow.txt")
    xml = "<Message><LastName>Testcase Real</LastName><DateOfBirth><Date>1980-01-01</Date></DateOfBirth><SSN>123456789</SSN></Message>"
    texts = spark.createDataFrame([("a.xml", xml), ("b", f"x{FS}CBReal{FS}C419990101"), ("c", "mail me@example.com or you@real.org, 123-45-6789"), ("d", None), ("e", "")], "path string, text string")
    hits = scan.scan_texts(texts, allow)
    found = {(r.path, r.category, r.value) for r in hits.collect()}
    assert found == {("a.xml", "name", "Real"), ("a.xml", "id", "123456789"), ("b", "name", "Real"), ("b", "dob", "19990101"), ("c", "email", "you@real.org"), ("c", "ssn", "123-45-6789")}
    assert {(r.path, r.n_hits, r.n_texts) for r in scan.report(hits, texts).collect()} == {("a.xml", 2, 5), ("b", 2, 5), ("c", 2, 5)}
    assert scan.scan_texts(texts.limit(0), allow).count() == 0


def test_a_stream_has_the_rows_of_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, text in enumerate([PAID, REJECTED, " ", "bad"]):
        (tmp_path / "in" / f"{i}.msg").write_text(text, encoding="latin-1")
    source = f"file://{tmp_path}/in"
    want = sorted((r.kind or "", r.fatal.code if r.fatal else "") for r in claims.parse_claims(read_messages(spark, source)).collect())
    stream = streaming.claim_stream(streaming.read_message_files(spark, source))
    streaming.write_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    found = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r.kind or "", r.fatal.code if r.fatal else "") for r in found) == want and len(want) == 4


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", PAID), ("2024-01-01 00:02:00", PAID), ("2024-01-01 00:12:00", REJECTED), ("2024-01-01 00:12:00", "bad")], "t string, payload string")
    counts = streaming.disposition_counts(rows.selectExpr("CAST(t AS TIMESTAMP) AS t", "payload"), "t")
    assert sorted((r.start.minute, r.disposition, r.n) for r in counts.collect()) == [(0, "paid", 2), (10, "rejected", 1)]


def written(spark, stream, path):
    stream.writeStream.format("parquet").option("path", f"file://{path}/out").option("checkpointLocation", f"file://{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"file://{path}/out").collect()


def test_windowed_counts_of_a_stream_leave_the_state_with_the_watermark(spark, tmp_path):
    schema = "t timestamp, payload string"
    for n, rows in enumerate([[("2024-01-01 00:01:00", PAID), ("2024-01-01 00:02:00", PAID)], [("2024-01-01 02:00:00", PAID)], [("2024-01-01 05:00:00", PAID)]]):
        spark.createDataFrame(rows, "t string, payload string").selectExpr("CAST(t AS TIMESTAMP) AS t", "payload").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    counts = streaming.disposition_counts(stream, "t")
    assert counts.isStreaming
    found = written(spark, counts, tmp_path)
    assert ("paid", 2) in {(r.disposition, r.n) for r in found} and all(r.n <= 2 for r in found)


def test_streams_of_requests_and_responses_meet(spark, tmp_path):
    message = lambda head, kind: f'<Message version="2017071"><Header>{head}</Header><Body><{kind}/></Body></Message>'
    request = lambda n: message(f"<MessageID>M{n}</MessageID>", "RxRenewalRequest")
    answer = lambda n, to: message(f"<MessageID>A{n}</MessageID><RelatesToMessageID>M{to}</RelatesToMessageID>", "RxRenewalResponse")
    for side, rows in (
        ("requests", [(1, "2024-01-01 00:00:00", request(1)), (2, "2024-01-01 00:05:00", request(2)), (3, "2024-01-01 00:06:00", request(3))]),
        ("responses", [(11, "2024-01-01 00:10:00", answer(11, 1)), (12, "2024-01-01 02:00:00", answer(12, 2)), (13, "2024-01-01 00:01:00", answer(13, 3)), (14, "2024-01-01 00:30:00", answer(14, 9))]),
    ):
        spark.createDataFrame(rows, "id long, t string, payload string").selectExpr("id", "CAST(t AS TIMESTAMP) AS t", "payload").write.parquet(f"file://{tmp_path}/{side}")
    read = lambda side: spark.readStream.schema("id long, t timestamp, payload string").parquet(f"file://{tmp_path}/{side}")
    joined = streaming.correlate_streams(read("responses"), read("requests"), "id", "t")
    assert {(r.response_id, r.request_id) for r in written(spark, joined, tmp_path)} == {(11, 1)}
