import time

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rxweave.operators import claims as C
from rxweave.operators import prescriptions as P
from rxweave.sources.xml import read_nodes, shred_messages

FS, GS, RS = "\x1c", "\x1d", "\x1e"
HEAD = "610014D0B1PCN       1" + "01" + "1234567890     " + "20240101" + "VENDOR    "


def response(*segments):
    return "D0B11A011234567890     20240101" + GS + RS.join(segments)


def parsed(spark, *texts, **options):
    return C.parse_claims(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string"), **options)


def test_fatal_codes_come_in_order(spark):
    texts = [None, "  ", "short", HEAD.replace("D0", "51") + " " * 20, HEAD + "no separators", "x" * 5]
    found = [r.fatal.code if r.fatal else None for r in parsed(spark, *texts).orderBy("i").collect()]
    assert found[:3] == ["EMPTY_INPUT", "EMPTY_INPUT", "NO_HEADER"] and found[3] == "UNSUPPORTED_VERSION" and found[4] == "INVALID_FRAMING"
    assert parsed(spark, *texts, mode="DROPMALFORMED").count() == found.count(None)
    with pytest.raises(Exception, match="EMPTY_INPUT|NO_HEADER|UNSUPPORTED_VERSION|INVALID_FRAMING"):
        parsed(spark, *texts, mode="FAILFAST").collect()
    assert parsed(spark, "x").limit(0).count() == 0


@pytest.mark.parametrize(
    ("fields", "disposition", "conflict"),
    [
        (["ANP"], "paid", False), (["ANA"], "approved", False), (["ANC"], "captured", False), (["AND"], "duplicate", False), (["ANZ"], "unknown", False), ([], "unknown", False),
        (["ANP", "FB70"], "rejected", True), (["ANP", "FA1"], "rejected", True), (["ANR", "FB70"], "rejected", False), (["ANP", "FA0"], "paid", False), (["ANP", "FA"], "paid", False),
    ],
)
def test_a_reject_always_wins(spark, fields, disposition, conflict):
    row = C.with_response_status(parsed(spark, response(FS.join(["AM21", *fields])))).first()
    assert row.kind == "response" and row.status.disposition == disposition and row.status.statusConflict == conflict


def test_no_occurrence_is_dropped_or_merged(spark):
    text = response(FS.join(["AM21", "ANR", "FA3", "FB70", "FB70", "FB99"]), FS.join(["AM24", "J61", "E4DD", "FSx", "J62", "E4DD", "FSy"]))
    row = C.with_response_dur(C.with_response_status(parsed(spark, text))).first()
    assert [x.code for x in row.status.rejectCodes] == ["70", "70", "99"] and len(row.alerts) == 2


def test_warnings_carry_positions_and_codes_alone(spark):
    secret = "SENTINEL"
    row = parsed(spark, response(FS.join(["AM21", "ANP", "FB" + secret, "Z"]), FS.join(["AM99", "XX" + secret]), secret)).first()
    assert {w.code for w in row.warnings} >= {"UNKNOWN_REJECT_CODE", "STATUS_CONFLICT", "UNKNOWN_SEGMENT"}
    assert all(secret not in (w.message or "") for w in row.warnings)


@settings(max_examples=3, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=FS + GS + RS + "AMDN02140FB x{}", max_size=80), min_size=100, max_size=110))
def test_any_text_is_read_and_canonical_output_is_stable(spark, bodies):
    """Three hundred bodies and more, as requests, as responses and on their own."""
    once = C.with_wire(parsed(spark, *[HEAD + GS + b for b in bodies], *["D0B11A" + GS + b for b in bodies], *bodies)).where("fatal IS NULL").select("i", "wire")
    twice = C.with_wire(C.parse_claims(once.withColumnRenamed("wire", "payload"))).select("i", "fatal", F.col("wire").alias("again"))
    rows = once.join(twice, "i").collect()
    assert len(rows) >= 2 * len(bodies) and all(r.fatal is None and r.wire == r.again for r in rows)


def test_segments_without_a_token_are_left_out_and_a_bare_token_is_framed(spark):
    rows = C.with_wire(parsed(spark, HEAD + RS + FS + FS + RS + "AM04" + FS + "C2X", HEAD + "AM04" + FS, response("AM21" + FS + "ANP", FS))).orderBy("i").collect()
    assert [r.wire[-len(t) :] for r, t in zip(rows, ("    AM04" + FS + "C2X", "    AM04" + RS, GS + "AM21" + FS + "ANP"), strict=True)] == ["    AM04" + FS + "C2X", "    AM04" + RS, GS + "AM21" + FS + "ANP"]


def test_a_hostile_message_of_many_parts(spark):
    text = HEAD + RS + FS.join(["AM08", *["E4DD"] * 20_000]) + RS * 50_000 + FS.join(["AM05", *["5C01", "DV1"] * 10_000])
    row = C.with_other_payments(C.with_request_dur(parsed(spark, text))).selectExpr("size(segments) AS n", "size(interventions) AS d", "size(otherPayments) AS p", "segments[1].byteOffset AS at").first()
    assert tuple(row) == (2, 20_000, 10_000, text.index("AM05"))


def script(body, version=' version="2017071"', head="<Header><MessageID>M1</MessageID></Header>"):
    return f"<Message{version}>{head}<Body>{body}</Body></Message>"


def scripts(spark, *texts, **options):
    return P.parse_scripts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string"), **options).orderBy("i").collect()


def test_script_gates_dispatch_and_outcomes(spark):
    outcome = lambda *names: script("<RxRenewalResponse><Response>" + "".join(f"<{n}/>" for n in names) + "</Response></RxRenewalResponse>")
    rows = scripts(
        spark,
        None, "<!DOCTYPE x><Message/>", "<Message><Body></Message", "<Other/>", script("<NewRx/>", ' version="10.6"'),
        script("<Status><Code>000</Code></Status><Error><Code>600</Code></Error>"), outcome("Approved", "Denied"), outcome("Approved"), outcome("Other"), script("<Unheard/>"), script("<ns:NewRx/>", ""),
    )
    assert [r.fatal.code if r.fatal else None for r in rows[:5]] == ["EMPTY_INPUT", "NOT_XML", "NOT_XML", "NO_MESSAGE_ROOT", "UNSUPPORTED_VERSION"]
    assert rows[5].kind == "Error" and rows[5].disposition == "error" and rows[5].response.code == "600"
    assert [r.outcome for r in rows[6:9]] == ["denied", "approved", "unknown"]
    assert rows[9].kind == "unsupported" and rows[9].transaction is None and rows[10].kind == "NewRx"
    assert [w.code for w in rows[6].warnings] == ["LIFECYCLE_AMBIGUOUS_OUTCOME"]
    assert "VERSION_ABSENT" in [w.code for w in rows[10].warnings]


def test_canonical_xml(spark):
    body = "<NewRx><Patient><Name><LastName>A &amp; B</LastName></Name></Patient><MedicationPrescribed><DrugDescription>Drug</DrugDescription><Sig/></MedicationPrescribed></NewRx>"
    found = P.with_xml(P.parse_scripts(spark.createDataFrame([(1, script(body))], "i int, payload string"))).first().xml
    lines = [
        '<Message version="2017071">', "  <Header>", "    <MessageID>M1</MessageID>", "  </Header>", "  <Body>", "    <NewRx>", "      <Patient>", "        <Name>", "          <LastName>A &amp;amp; B</LastName>",
        "        </Name>", "      </Patient>", "      <MedicationPrescribed>", "        <DrugDescription>Drug</DrugDescription>", "        <Sig/>", "      </MedicationPrescribed>", "    </NewRx>", "  </Body>", "</Message>",
    ]
    assert found.rstrip("\n").split("\n") == lines


def shred(text, strict=True):
    nodes = read_nodes(text, strict)
    return nodes and [{"id": i, "parent": p, "last": e, "name": n, "text": t, "attrs": a} for i, (p, e, n, t, a) in enumerate(zip(nodes.parent, nodes.last, nodes.name, nodes.text, nodes.attrs, strict=True))]


def test_nodes_as_columns(spark):
    """Unreadable and null messages between others, attributes, no rows."""
    texts = ["<a x='1' n:y='2' x='3'><b>t</b></a>", "<a", None, "<c/>", "", "<a><b z='q'/></a>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string").coalesce(1)
    for r in shred_messages(df).collect():
        want = None if texts[r.i] is None else shred(texts[r.i])
        assert (r.nodes and [{"id": n.id, "parent": n.parent, "last": n.last, "name": n.name, "text": n.text, "attrs": list(n.attrs.items())} for n in r.nodes]) == want
    assert shred_messages(df.where("i < 0")).count() == 0


def test_hostile_messages_take_seconds(spark):
    """A megabyte of nested elements of names that are looked up at any depth, and one of attributes."""
    texts = ["<Message><Body><NewRx>" + "<Name><Identification>" * 45_000, "<Message " + "version='2017071' " * 60_000 + "><Body/></Message>"]
    start = time.time()
    rows = scripts(spark, *texts)
    assert rows[0].kind == "NewRx" and rows[1].version == "2017071"
    assert time.time() - start < 60


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ab=\"'!-[]CDATA?&; \n", max_size=60))
def test_shredding_never_fails(text):
    nodes = shred(text)
    for n in nodes or []:
        assert n["last"] >= n["id"] and (n["parent"] is None) == (n["id"] == 0)


def test_node_tree():
    nodes = shred("<?xml version='1.0'?><a:Message v='1'><b>x<![CDATA[<y>]]></b><!-- <z> --><c/></a:Message><second/>")
    assert [(n["name"], n["parent"], n["last"], n["text"]) for n in nodes] == [("Message", None, 2, ""), ("b", 0, 1, "x<y>"), ("c", 0, 2, "")]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("<a><b></a></b>", ["a", "b"]), ("<a><b>", ["a", "b"]), ("before<a/>between<c/>", ["a"]), ("<a x y=1 z='2>'>t</a>", ["a"]), ("<a/></a>", ["a"]), ("<?p q='1'?><a/>", ["?p"]), ("<!x><a/>", ["!x", "a"]), ("<>", [""]),
        ("</a><b/>", None), ("<a/></a><![CDATA[x]]>", None), ("<a", None), ("<a b='>", None), ("<a/><!-- x", None), ("<a/><![CDATA[x", None), ("<a/><?p", None), ("<a></a", None), ("", None), ("text", None), ("<!-- x -->", None),
    ],
)
def test_what_is_readable_as_xml(text, names):
    found = shred(text)
    assert (found and [n["name"] for n in found]) == names


def test_broken_markup_is_read_as_far_as_it_goes():
    assert [(n["name"], n["text"]) for n in shred("<a>x<b>y</b><c", strict=False)] == [("a", "x"), ("b", "y")] and shred("<", strict=False) is None
