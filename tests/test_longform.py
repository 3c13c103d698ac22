import random

import pytest
from pyspark.sql import functions as F

from rxweave.codes import FS, GS, RS
from rxweave.operators import claims as C
from rxweave.operators import longform as L
from rxweave.operators import prescriptions as P

HEAD = "610014D0B1PCN       1" + "01" + "1234567890     " + "20240101" + "VENDOR    "


def random_messages(n, seed):
    """Requests and responses whose repeating segments are random lists of their fields, also twice, empty, or without the count."""
    rnd = random.Random(seed)
    pools = {
        "24": ["J6", "E4", "FS", "FU", "FV", "E5", "E6", "8E", "FY", "XX"], "08": ["E4", "E5", "E6", "8E", "J9", "H7"], "05": ["4C", "5C", "6C", "7C", "E8", "HC", "DV", "6E", "7E"],
        "28": ["NT", "5C", "6C", "7C", "MH", "NU", "MJ"], "99": ["AA", "A"],
    }
    out = []
    for i in range(n):
        segments = []
        for s in rnd.sample(sorted(pools), rnd.randint(0, 4)) + rnd.choices(sorted(pools), k=rnd.randint(0, 1)):
            tokens = [rnd.choice(pools[s]) + rnd.choice(["", "1", "DD", "TD", "100", "2x"]) for _ in range(rnd.randint(0, 9))]
            segments.append(FS.join(([] if rnd.random() < 0.05 else ["AM" + s]) + tokens))
        body = RS.join(segments)
        out.append((i, HEAD + RS + body if i % 2 else "D0B11A011234567890     20240101" + GS + body))
    return out


@pytest.fixture(scope="module")
def messages(spark):
    df = spark.createDataFrame(random_messages(10_000, 3), "i int, payload string").repartition(8)
    return C.parse_claims(df).where("fatal IS NULL")


def same(a, b):
    """The same rows with the same number of each."""
    a, b = sorted(map(tuple, a.collect()), key=repr), sorted(map(tuple, b.collect()), key=repr)
    assert len(a) > 1000 and a == b


ALERT = ("reasonForServiceCode", "clinicalSignificanceCode", "professionalServiceCode", "resultOfServiceCode", "levelOfEffort", "previousDateOfFill", "quantityOfPreviousFill", "freeText", "reasonKnown", "reasonDescription")


def test_alerts_are_those_of_the_array_form(messages):
    fields = L.fields_of(messages, "i")
    want = C.with_response_dur(messages).select("i", F.posexplode("alerts").alias("pos", "a")).select("i", "pos", "a.counter", *[f"a.{c}" for c in ALERT])
    same(L.alerts(fields, "i").select("i", "block", "counter", "reason", "significance", "service", "result", "effort", "previous_fill", "previous_quantity", "note", "reason_known", "reason_name"), want)
    names = ("reasonForServiceCode", "professionalServiceCode", "resultOfServiceCode", "levelOfEffort", "coAgentIdQualifier", "coAgentId", "reasonKnown", "reasonDescription")
    want = C.with_request_dur(messages).select("i", F.posexplode("interventions").alias("pos", "a")).select("i", "pos", *[f"a.{c}" for c in names])
    same(L.alerts(fields, "i", "08", None).select("i", "block", "reason", "service", "result", "effort", "agent_qualifier", "agent", "reason_known", "reason_name"), want)


@pytest.mark.parametrize(("qualifier", "amount", "member"), [("HC", "DV", "amountsPaid"), ("6E", "7E", "patientResponsibilityAmounts")])
def test_payers_and_amounts_are_those_of_the_array_form(messages, qualifier, amount, member):
    blocks = L.payer_blocks(L.fields_of(messages, "i"), "i")
    each = C.with_other_payments(messages).select("i", F.posexplode("otherPayments").alias("pos", "p"))
    same(L.payers(blocks, "i").select("i", "block", "coverage", "payer_qualifier", "payer", "payer_date"), each.select("i", "pos", "p.coverageType", "p.payerIdQualifier", "p.payerId", "p.payerDate"))
    rows = each.select("i", "pos", F.posexplode(f"p.{member}").alias("row", "a")).select("i", "pos", "row", "a.qualifier", "a.amount.source", "a.amount.amount", "a.amount.isNegative")
    same(L.amounts(blocks, "i", qualifier, amount).select("i", "block", "row_no", "qualifier", "amount.source", "amount.amount", "amount.isNegative"), rows)


def test_other_payers_of_responses(messages):
    found = L.payers(L.payer_blocks(L.fields_of(messages, "i"), "i", "28", "NT"), "i").select("i", "block", "coverage", "payer_qualifier", "payer", "processor", "cardholder", "group_id")
    want = C.with_response_other_payers(messages).select("i", F.posexplode("otherPayers").alias("pos", "p")).select("i", "pos", "p.coverageType", "p.payerIdQualifier", "p.payerId", "p.processorControlNumber", "p.cardholderId", "p.groupId")
    same(found, want)


def test_several_views_of_one_shuffle(messages):
    blocks = L.payer_blocks(L.fields_of(messages, "i"), "i")
    views = [L.payers(blocks, "i"), L.amounts(blocks, "i"), L.alerts(L.fields_of(messages, "i"), "i")]
    for v in views:
        assert v._jdf.queryExecution().sparkPlan().toString().count("Window") and v._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_text_is_written_back(messages):
    fields = L.fields_of(messages, "i")
    heads = messages.select("i", "kind", "header", "responseHeader")
    same(L.text_of(fields, heads, "i"), C.with_wire(messages).select("i", "wire"))


def test_masked_fields_and_no_others_change(messages):
    fields = L.fields_of(messages, "i")
    wanted = fields.where("field_id IN ('FY', '7C') AND i % 3 = 0").select("i", "seg_no", "field_no")
    wanted = wanted.unionByName(wanted)  # rows may come several times
    texts = L.text_of(L.masked(fields, wanted, "i"), messages.select("i", "kind", "header", "responseHeader"), "i")
    again = L.fields_of(C.parse_claims(texts.withColumnRenamed("wire", "payload")), "i")
    want = fields.withColumn("value", F.when(F.col("field_id").isin("FY", "7C") & (F.col("i") % 3 == 0), F.repeat(F.lit("X"), F.length("value"))).otherwise(F.col("value")))
    rows = lambda df: sorted(((r.i, r.segment_id, r.field_no, r.field_id, r.value) for r in df.where("field_no IS NOT NULL").collect()), key=repr)
    assert rows(again) == rows(want)


def test_sql_function_has_the_readers_gates(spark):
    C.register(spark)
    rnd = random.Random(9)
    odd = [None, "", " \t\n", "short", "610014D0B1", HEAD, HEAD + "AM04", HEAD.replace("D0", "51") + RS + "AM04" + FS + "C2X", HEAD.replace("D0", "F6") + RS + "AM04" + FS + "C2X", "D0B1", "D0B11A01SHORT", "D0B11R" + RS + "AM21" + FS + "ANR"]
    odd += ["".join(rnd.choice([FS, GS, RS, "AM", "04", "D0", "F6", "C2", "x"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    odd += [HEAD + "".join(rnd.choice([FS, GS, RS, "AM", "04", "123", "C2", "x"]) for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, payload string")
    by_sql = spark.sql("SELECT m.i, f.seg_no, f.segment_id, f.field_no, f.field_id, f.value FROM {m} AS m, LATERAL claim_fields(m.payload) AS f", m=df)
    by_reader = C.long_fields(C.parse_claims(df), "i").select("i", "segment_id", "field_no", "field_id", "value")
    found = sorted(map(tuple, by_sql.select("i", "segment_id", "field_no", "field_id", "value").collect()))
    assert len(found) > 400 and found == sorted(map(tuple, by_reader.collect()))


def test_modes_are_known_ones(spark):
    df = spark.createDataFrame([("x",)], "payload string")
    for read in (C.parse_claims, P.parse_scripts):
        with pytest.raises(ValueError, match="PERMISSIVE"):
            read(df, mode="permissive")
    with pytest.raises(ValueError, match="FAILFAST"):
        C.build_requests(df, mode="DROPMALFORMED")


def test_first_descendants_by_brute_force(spark):
    rnd = random.Random(4)

    def tree(depth):
        name = rnd.choice("abc")
        return f"<{name}>" + "".join(tree(depth - 1) for _ in range(rnd.randint(0, 3) if depth else 0)) + f"</{name}>"

    texts = [(i, tree(5)) for i in range(60)] + [(99, "<a>" * 3000)]
    nodes = P.script_nodes(spark.createDataFrame(texts, "k int, payload string"), "k").select("k", "id", "last", "name")
    pairs = [("a", "b"), ("a", "a"), ("c", "b"), ("b", "z")]
    found = L.first_descendants(nodes, spark.createDataFrame(pairs, "ancestor string, descendant string"), "k").collect()
    rows = {}
    for r in nodes.collect():
        rows.setdefault(r.k, []).append(r)
    want = []
    for k, each in rows.items():
        names = {r.id: r.name for r in each}
        for r in each:
            for a, d in pairs:
                if r.name == a and (hit := next((i for i in range(r.id, r.last + 1) if names[i] == d), None)) is not None:
                    want.append((k, a, d, r.id, hit))
    assert sorted(map(tuple, found)) == sorted(want)
