"""Registered queries of the message operators, and the same answers in SQL over the base tables.

Each query writes messages, reads them back with the operator and returns flat columns; its oracle works from the facts that
went into the messages and sees no message.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave import codes
from rxweave.functions import scalars as S
from rxweave.operators import claims as C
from rxweave.operators import prescriptions as P
from rxweave.operators import longform as L
from rxweave.operators import profile_tables as T
from rxweave.operators import answers, code_tables, profiles, rollups, scan
from rxweave.sources import xml
from rxweave.plans.encoders import FACTS, ORDER_FACTS, claim_messages, script_messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ("k", "ln")


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = f"WITH f AS ({FACTS}), o AS ({ORDER_FACTS}) {oracle}"
        return f

    return add


def _sql_map(column: str, table: dict[str, str], otherwise: str = "NULL") -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


#: What is written again.
WIRE = ("kind", "header", "responseHeader", "segments")


def responses(spark: SparkSession, sf_dir: str, *more: str, only: tuple[str, ...] = ("segments",), names: bool = False) -> DataFrame:
    return C.parse_claims(claim_messages(spark, sf_dir, "response").select(*KEY, "flag", *more, "response"), "response", only=only, names=names)


def requests(spark: SparkSession, sf_dir: str, *more: str, only: tuple[str, ...] = ("segments",)) -> DataFrame:
    return C.parse_claims(claim_messages(spark, sf_dir, "request").select(*KEY, "flag", *more, "request"), "request", only=only, names=False)


REJECTED = "(n_fb > 0 OR coalesce(fa, '') IN ('1', '2x'))"
DISPOSITION = f"CASE WHEN {REJECTED} THEN 'rejected' ELSE {_sql_map('an', codes.RESPONSE_DISPOSITIONS, chr(39) + 'unknown' + chr(39))} END"
CONFLICT = f"({REJECTED} AND an IN ('P', 'C', 'A', 'D', 'Q'))"
#: cents as an amount with two places
AMOUNT = "(CAST((cents - cents % 100) / 100 AS BIGINT) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0'))"
MILLI = "(CAST((milli - milli % 1000) / 1000 AS BIGINT) || '.' || lpad(CAST(milli % 1000 AS VARCHAR), 3, '0'))"


#: The responses of the facts in their canonical form, segment by segment.
RESPONSE_TEXTS = """, w AS (SELECT *, 'D0' || tx || '1A01' || rpad('P' || sk, 15, ' ') || chr(29) AS head,
    concat_ws(chr(28), 'AM21', 'AN' || an, 'FA' || fa, CASE WHEN sk % 2 = 0 THEN 'F3' || k END, CASE WHEN n_fb > 0 THEN 'FB75' END, CASE WHEN n_fb > 1 THEN 'FBZZ' END, CASE WHEN n_fb > 2 THEN 'FBAG' END, CASE WHEN ln % 6 = 0 THEN 'FQsee note' END) AS s21,
    concat_ws(chr(28), 'AM23', 'F5' || CASE WHEN neg THEN substr(CAST(cents AS VARCHAR), 1, length(CAST(cents AS VARCHAR)) - 1) || substr('}JKLMNOPQR', CAST(cents % 10 AS INT) + 1, 1) ELSE CAST(cents AS VARCHAR) END, 'F9' || cents,
      CASE WHEN ln % 4 = 0 THEN 'F6bad' END, CASE WHEN ln % 4 = 1 THEN 'FM01' END, CASE WHEN ln % 4 = 2 THEN 'F7+' || cents END) AS s23,
    CASE WHEN n_dur > 0 THEN concat_ws(chr(28), 'AM24', array_to_string(list_transform(range(1, n_dur + 1), lambda i: concat_ws(chr(28), CASE WHEN (sk + i) % 2 = 0 THEN 'J6' || i END, 'E4' || ['DD', 'TD', 'ZZ'][(pk + i) % 3 + 1], 'FYt' || i)), chr(28)), CASE WHEN ln % 2 = 0 THEN 'FYlast' END) END AS s24,
    CASE WHEN n_pay > 0 THEN concat_ws(chr(28), 'AM28', 'NT' || (n_pay + CASE WHEN ln % 5 = 0 THEN 1 ELSE 0 END), array_to_string(list_transform(range(1, n_pay + 1), lambda i: concat_ws(chr(28), '5C0' || i, '7C' || sk, 'MHPCN', 'NU' || k)), chr(28))) END AS s28 FROM f)"""


@query("r01_disposition_rollup", f"SELECT flag, {DISPOSITION} AS disposition, count(*) AS n, CAST(sum(CASE WHEN {CONFLICT} THEN 1 ELSE 0 END) AS BIGINT) AS n_conflict, CAST(sum(cents) AS BIGINT) AS paid_cents FROM f GROUP BY 1, 2")
def r01(spark, sf_dir):
    found = C.with_response_pricing(C.with_response_status(responses(spark, sf_dir)))
    cents = F.sum(F.col("pricing.totalAmountPaid.amount").cast("decimal(20,2)") * 100)
    return found.groupBy("flag", F.col("status.disposition").alias("disposition")).agg(
        F.count("*").alias("n"), F.sum(F.col("status.statusConflict").cast("long")).alias("n_conflict"), cents.cast("long").alias("paid_cents")
    )


@query(
    "t08_fields",
    """, seg AS (SELECT '21' AS segment_id, 'AN' AS field_id, count(*) AS n FROM f UNION ALL SELECT '21', 'FA', count(fa) FROM f UNION ALL SELECT '21', 'F3', count(*) FROM f WHERE sk % 2 = 0
    UNION ALL SELECT '21', 'FB', CAST(sum(least(n_fb, 3)) AS BIGINT) FROM f UNION ALL SELECT '23', 'F5', count(*) FROM f UNION ALL SELECT '23', 'F9', count(*) FROM f UNION ALL SELECT '23', 'F6', count(*) FROM f WHERE ln % 4 = 0
    UNION ALL SELECT '23', 'FM', count(*) FROM f WHERE ln % 4 = 1 UNION ALL SELECT '24', 'E4', CAST(sum(n_dur) AS BIGINT) FROM f UNION ALL SELECT '24', 'FY', CAST(sum(n_dur + CASE WHEN n_dur > 0 AND ln % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM f
    UNION ALL SELECT '24', 'J6', CAST(sum(CASE WHEN n_dur >= 1 AND (sk + 1) % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN n_dur >= 2 AND sk % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM f
    UNION ALL SELECT '28', 'NT', count(*) FROM f WHERE n_pay > 0 UNION ALL SELECT '28', x, CAST(sum(n_pay) AS BIGINT) FROM f, (VALUES ('5C'), ('7C'), ('MH'), ('NU')) AS v(x) GROUP BY x
    UNION ALL SELECT '21', 'FQ', count(*) FROM f WHERE ln % 6 = 0 UNION ALL SELECT '23', 'F7', count(*) FROM f WHERE ln % 4 = 2)
    SELECT segment_id, field_id, n, """ + _sql_map("segment_id", codes.SEGMENT_NAMES) + " AS segment_name, " + _sql_map("field_id", codes.FIELD_NAMES) + " AS field_name FROM seg WHERE n > 0",
)
def t08(spark, sf_dir):
    fields = C.long_fields(responses(spark, sf_dir, names=True), "k")
    return fields.groupBy("segment_id", "segment_name", "field_id", "field_name").agg(F.count("*").alias("n"))


@query(
    "t20_claim",
    f"""SELECT k, ln, tx AS code, CASE WHEN pk % 2 = 0 THEN 'G' || pk END AS group_id, 'SYNTH' || k AS cardholder, CASE WHEN pk % 3 = 0 THEN '01' END AS person, ship AS born, CASE WHEN ln % 2 = 0 THEN '1' END AS gender,
    k || '' || ln AS reference, CASE WHEN pk % 7 <> 0 OR pk % 7 < 5 THEN CASE WHEN pk % 7 <> 0 THEN lpad(CAST(pk AS VARCHAR), 11, '0') ELSE '' END END AS product,
    CASE WHEN pk % 7 < 5 THEN {_sql_map("lpad(CAST(pk % 5 AS VARCHAR), 2, '0')", codes.PRODUCT_QUALIFIERS)} END AS qualifier, {MILLI} AS quantity, CASE WHEN sk % 2 = 0 THEN TRUE ELSE FALSE END AS days_valid, 'N' || sk AS prescriber, '0' AS fill, '0' AS as_written, '1' AS reference_kind, '01' AS prescriber_kind FROM f""",
)
def t20(spark, sf_dir):
    found = C.with_claim(requests(spark, sf_dir, only=("header", "segments")))
    names = {
        "transactionCode": "code", "groupId": "group_id", "cardholderId": "cardholder", "personCode": "person", "dateOfBirth": "born", "genderCode": "gender", "prescriptionReferenceNumber": "reference",
        "product.id": "product", "product.qualifierMeaning": "qualifier", "quantityDispensed.impliedDecimal": "quantity", "daysSupply.isValid": "days_valid", "prescriberId": "prescriber",
        "fillNumber": "fill", "dispenseAsWritten": "as_written", "prescriptionReferenceQualifier": "reference_kind", "prescriberIdQualifier": "prescriber_kind",
    }
    return found.select(*KEY, *[F.col(f"claim.{a}").alias(b) for a, b in names.items()])


@query(
    "t23_response_status",
    f"""SELECT k, ln, an AS status, {_sql_map('an', codes.RESPONSE_STATUS_NAMES)} AS status_name, {DISPOSITION} AS disposition, {CONFLICT} AS conflict, fa AS declared, CAST(least(n_fb, 3) AS INT) AS n_rejects,
    CAST(CASE n_fb WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS INT) AS n_known, CASE WHEN sk % 2 = 0 THEN CAST(k AS VARCHAR) END AS authorization_no,
    CASE WHEN ln % 6 = 0 THEN 'see note' END AS note, CASE n_fb WHEN 0 THEN '' WHEN 1 THEN 'Prior Authorization Required' WHEN 2 THEN 'Prior Authorization Required;?' ELSE 'Prior Authorization Required;?;Days Supply Limitation For Product/Service' END AS reasons FROM f""",
)
def t23(spark, sf_dir):
    found = C.with_response_status(responses(spark, sf_dir))
    s = lambda n: F.col(f"status.{n}")
    return found.select(
        *KEY, s("transactionResponseStatus").alias("status"), s("statusDescription").alias("status_name"), s("disposition"), s("statusConflict").alias("conflict"), s("rejectCount").alias("declared"),
        F.size(s("rejectCodes")).alias("n_rejects"), F.size(F.filter(s("rejectCodes"), lambda r: r["known"])).alias("n_known"), s("authorizationNumber").alias("authorization_no"),
        s("additionalMessage").alias("note"), F.array_join(F.transform(s("rejectCodes"), lambda r: r["description"]), ";", "?").alias("reasons"),
    )


@query(
    "t24_response_pricing",
    f"SELECT k, ln, CASE WHEN neg AND cents > 0 THEN '-' ELSE '' END || {AMOUNT} AS patient_pay, neg AND cents > 0 AS negative, {AMOUNT} AS total, CASE WHEN ln % 4 = 0 THEN FALSE END AS cost_valid, CASE WHEN ln % 4 = 1 THEN '01' END AS basis, CASE WHEN ln % 4 = 2 THEN {AMOUNT} END AS fee FROM f",
)
def t24(spark, sf_dir):
    found = C.with_response_pricing(responses(spark, sf_dir))
    p = lambda n, to: F.col(f"pricing.{n}").alias(to)
    return found.select(*KEY, p("patientPayAmount.amount", "patient_pay"), p("patientPayAmount.isNegative", "negative"), p("totalAmountPaid.amount", "total"), p("ingredientCostPaid.isValid", "cost_valid"), p("basisOfReimbursement", "basis"), p("dispensingFeePaid.amount", "fee"))


@query("t25_adjudication", f"SELECT k, ln, tx AS code, {DISPOSITION} AS disposition, {AMOUNT} AS total, n_dur AS n_alerts FROM f")
def t25(spark, sf_dir):
    a = lambda n: F.col(f"adjudication.{n}")
    found = C.with_adjudication(responses(spark, sf_dir, only=("kind", "header", "segments")))
    return found.select(*KEY, a("transactionCode").alias("code"), a("status.disposition"), a("pricing.totalAmountPaid.amount").alias("total"), F.size(a("dur")).alias("n_alerts"))


@query("t26_prior_authorization", "SELECT k, ln, TRUE AS present, '1' AS kind, CASE WHEN sk % 2 = 0 THEN CAST(k AS VARCHAR) END AS number FROM f WHERE pk % 11 = 0")
def t26(spark, sf_dir):
    found = C.with_prior_authorization(requests(spark, sf_dir)).where("priorAuthorization IS NOT NULL")
    return found.select(*KEY, F.col("priorAuthorization.present"), F.col("priorAuthorization.typeCode").alias("kind"), F.col("priorAuthorization.numberSubmitted").alias("number"))


@query(
    "t40_response_dur",
    f"""SELECT k, ln, CAST(i - 1 AS INT) AS pos, CASE WHEN (sk + i) % 2 = 0 THEN CAST(i AS VARCHAR) END AS counter, r AS reason, r <> 'ZZ' AS known, {_sql_map('r', codes.DUR_REASONS)} AS reason_name,
    CASE WHEN i = n_dur AND ln % 2 = 0 THEN 'last' ELSE 't' || i END AS note FROM (SELECT *, CASE (pk + i) % 3 WHEN 0 THEN 'DD' WHEN 1 THEN 'TD' ELSE 'ZZ' END AS r FROM f, (VALUES (1), (2)) AS v(i) WHERE i <= n_dur)""",
)
def t40(spark, sf_dir):
    found = C.with_response_dur(responses(spark, sf_dir)).select(*KEY, F.posexplode("alerts").alias("pos", "a"))
    a = lambda n, to: F.col(f"a.{n}").alias(to)
    return found.select(*KEY, "pos", a("counter", "counter"), a("reasonForServiceCode", "reason"), a("reasonKnown", "known"), a("reasonDescription", "reason_name"), a("freeText", "note"))


@query(
    "t41_request_dur",
    "SELECT k, ln, CAST(i AS INT) AS pos, CASE i WHEN 0 THEN 'DD' ELSE 'ZZ' END AS reason, i = 0 AS known, CASE i WHEN 0 THEN 'M0' END AS service, CASE i WHEN 1 THEN '11' END AS effort FROM f, (VALUES (0), (1)) AS v(i) WHERE i < n_dur",
)
def t41(spark, sf_dir):
    found = C.with_request_dur(requests(spark, sf_dir)).select(*KEY, F.posexplode("interventions").alias("pos", "a"))
    a = lambda n, to: F.col(f"a.{n}").alias(to)
    return found.select(*KEY, "pos", a("reasonForServiceCode", "reason"), a("reasonKnown", "known"), a("professionalServiceCode", "service"), a("levelOfEffort", "effort"))


@query(
    "t42_compound",
    f"""SELECT k, ln, CAST(n_ing + ln % 2 AS VARCHAR) AS declared, CAST(i - 1 AS INT) AS pos, pk || '' || i AS product, CASE WHEN bare THEN '' ELSE '03' END AS qualifier, CASE WHEN NOT bare THEN 'NDC' END AS qualifier_name, {MILLI} AS quantity, {AMOUNT} AS cost
    FROM f, (VALUES (1), (2), (3)) AS v(i) WHERE i <= n_ing""",
)
def t42(spark, sf_dir):
    found = C.with_compound(requests(spark, sf_dir)).select(*KEY, F.col("compound.declaredIngredientCount").alias("declared"), F.posexplode("compound.ingredients").alias("pos", "i"))
    i = lambda n, to: F.col(f"i.{n}").alias(to)
    return found.select(*KEY, "declared", "pos", i("productId", "product"), i("productIdQualifier", "qualifier"), i("qualifierMeaning", "qualifier_name"), i("quantity.impliedDecimal", "quantity"), i("drugCost.amount", "cost"))


@query(
    "t45_other_payments",
    f"""SELECT k, ln, CAST(i - 1 AS INT) AS pos, '0' || i AS coverage, CAST(sk AS VARCHAR) AS payer, CAST(j AS INT) AS row_no, CASE j WHEN 0 THEN '07' END AS qualifier, CASE j WHEN 0 THEN {AMOUNT} ELSE '1.00' END AS amount, CASE WHEN sk % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN ln % 3 = 0 THEN 1 ELSE 0 END AS n_responsibility
    FROM f, (VALUES (1), (2)) AS v(i), (VALUES (0), (1)) AS w(j) WHERE i <= n_pay""",
)
def t45(spark, sf_dir):
    found = C.with_other_payments(requests(spark, sf_dir)).select(*KEY, F.posexplode("otherPayments").alias("pos", "p"))
    found = found.select(*KEY, "pos", F.col("p.coverageType").alias("coverage"), F.col("p.payerId").alias("payer"), F.size("p.patientResponsibilityAmounts").alias("n_responsibility"), F.posexplode("p.amountsPaid").alias("row_no", "a"))
    return found.select(*KEY, "pos", "coverage", "payer", "row_no", F.col("a.qualifier").alias("qualifier"), F.col("a.amount.amount").alias("amount"), "n_responsibility")


@query(
    "t43_responsibility",
    f"""SELECT k, ln, pos, row_no, qualifier, amount FROM (SELECT k, ln, CAST(i - 1 AS INT) AS pos, 0 AS row_no, '06' AS qualifier, CASE WHEN sk % 2 = 0 THEN {AMOUNT} ELSE '0.50' END AS amount FROM f, (VALUES (1), (2)) AS v(i) WHERE i <= n_pay AND (sk % 2 = 0 OR ln % 3 = 0)
    UNION ALL SELECT k, ln, CAST(i - 1 AS INT), 1, NULL, '0.50' FROM f, (VALUES (1), (2)) AS v(i) WHERE i <= n_pay AND sk % 2 = 0 AND ln % 3 = 0)""",
)
def t43(spark, sf_dir):
    found = C.with_other_payments(requests(spark, sf_dir)).select(*KEY, F.posexplode("otherPayments").alias("pos", "p"))
    found = found.select(*KEY, "pos", F.posexplode("p.patientResponsibilityAmounts").alias("row_no", "a"))
    return found.select(*KEY, "pos", "row_no", F.col("a.qualifier").alias("qualifier"), F.col("a.amount.amount").alias("amount"))


@query("t46_response_other_payers", "SELECT k, ln, CAST(i - 1 AS INT) AS pos, '0' || i AS coverage, CAST(sk AS VARCHAR) AS payer, 'PCN' AS pcn, CAST(k AS VARCHAR) AS cardholder, CAST(NULL AS VARCHAR) AS group_id FROM f, (VALUES (1), (2)) AS v(i) WHERE i <= n_pay")
def t46(spark, sf_dir):
    found = C.with_response_other_payers(responses(spark, sf_dir)).select(*KEY, F.posexplode("otherPayers").alias("pos", "p"))
    p = lambda n, to: F.col(f"p.{n}").alias(to)
    return found.select(*KEY, "pos", p("coverageType", "coverage"), p("payerId", "payer"), p("processorControlNumber", "pcn"), p("cardholderId", "cardholder"), p("groupId", "group_id"))


@query("t46_payer_names", "SELECT k, ln, CAST(i - 1 AS INT) AS pos, CAST(sk AS VARCHAR) AS payer, s_name AS payer_name, s_name IS NOT NULL AS payer_known FROM f CROSS JOIN (VALUES (1), (2)) AS v(i) LEFT JOIN supplier ON s_suppkey = sk AND s_suppkey % 3 <> 0 WHERE i <= n_pay")
def t46_names(spark, sf_dir):
    """Other payers by the names of a payer table that lacks a third of them."""
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 <> 0")
    found = C.with_response_other_payers(responses(spark, sf_dir)).select(*KEY, F.posexplode("otherPayers").alias("pos", "p")).select(*KEY, "pos", F.col("p.payerId").alias("payer"))
    named = code_tables.with_code_name(found, "payer", table, "payer_name", "s_suppkey", "s_name")
    return named.withColumnRenamed("payer_name_known", "payer_known")


@query("t46_unknown_payers", "SELECT CAST(sk AS VARCHAR) AS code, CAST(sum(n_pay) AS BIGINT) AS n FROM f WHERE sk % 3 = 0 AND n_pay > 0 GROUP BY sk")
def t46_unknown(spark, sf_dir):
    """The payers that the table lacks, with the number of their rows."""
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 3 <> 0")
    found = C.with_response_other_payers(responses(spark, sf_dir)).select(F.explode("otherPayers.payerId").alias("payer"))
    return code_tables.unknown_codes(found, "payer", table, "s_suppkey")


@query(
    "r02_merged_rollup",
    f"""SELECT flag, CAST(pk % 5 AS INT) AS grp, count(*) AS n, CAST(sum(CASE WHEN {DISPOSITION} = 'rejected' THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected, CAST(sum(cents) AS BIGINT) AS paid_cents, CAST(GROUPING(flag) * 2 + GROUPING(pk % 5) AS INT) AS grouping, TRUE AS members_near, TRUE AS median_near
    FROM f GROUP BY GROUPING SETS ((flag, pk % 5), (flag), ())""",
)
def r02(spark, sf_dir):
    """State by day, flag and group, combined over all days; sketches are held against exact figures of the same rows."""
    found = C.with_response_pricing(C.with_response_status(responses(spark, sf_dir, "pk", "ship", only=("responseHeader", "segments"))))
    cents = (F.col("pricing.totalAmountPaid.amount").cast("decimal(20,2)") * 100).cast("long")
    rows = found.select("ship", "flag", (F.col("pk") % 5).cast("int").alias("grp"), F.col("responseHeader.serviceProviderId").alias("member"), (F.col("status.disposition") == "rejected").alias("rejected"), cents.alias("cents"))
    state = rollups.daily_state(rows, ["ship", "flag", "grp"], F.col("member"), F.col("rejected"), F.col("cents"))
    sets, columns = [["flag", "grp"], ["flag"], []], ["flag", "grp"]
    told = rollups.estimates(rollups.combined(state, sets, columns), [0.5])
    exact = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col("flag"), F.col("grp")).agg(F.count_distinct("member").alias("m"), F.percentile_approx("cents", [0.45, 0.55], 10_000).alias("mid"), F.grouping_id().cast("int").alias("g"))
    exact = exact.select(F.col("flag").alias("_f"), F.col("grp").alias("_p"), "m", "mid", "g")
    both = told.join(exact, (F.col("grouping") == F.col("g")) & F.col("flag").eqNullSafe(F.col("_f")) & F.col("grp").eqNullSafe(F.col("_p")))
    near = F.abs(F.col("members") - F.col("m")) <= F.col("m") * 0.06 + 1
    return both.select("flag", "grp", "n", "n_rejected", "paid_cents", "grouping", near.alias("members_near"), F.col("paid_p50").between(F.col("mid")[0], F.col("mid")[1]).alias("median_near"))


@query(
    "t50_response_warnings",
    f"""{RESPONSE_TEXTS} SELECT k, ln, code, byte_offset, field_id, {_sql_map('code', codes.CLAIM_WARNINGS)} AS message FROM (SELECT k, ln, 'UNKNOWN_RESPONSE_STATUS' AS code, 24 AS byte_offset, 'AN' AS field_id FROM f WHERE an = 'X'
    UNION ALL SELECT k, ln, 'UNKNOWN_REJECT_CODE', 24, 'FB' FROM f WHERE n_fb > 1 UNION ALL SELECT k, ln, 'STATUS_CONFLICT', 24, 'AN' FROM f WHERE {CONFLICT}
    UNION ALL SELECT k, ln, 'COB_COUNT_MISMATCH', CAST(length(head) + length(s21) + length(s23) + 2 + coalesce(length(s24) + 1, 0) AS INT), 'NT' FROM w WHERE n_pay > 0 AND ln % 5 = 0)""",
)
def t50(spark, sf_dir):
    return responses(spark, sf_dir, only=("warnings",)).select(*KEY, F.explode("warnings").alias("w")).select(*KEY, F.col("w.code"), F.col("w.byteOffset").alias("byte_offset"), F.col("w.fieldId").alias("field_id"), F.col("w.message").alias("message"))


@query(
    "t06_headers",
    """SELECT k, ln, 'request' AS side, concat_ws('|', '610066', 'D0', tx, 'PCN', '1', '01', 'P' || sk, ship, 'SW') AS header FROM f UNION ALL SELECT k, ln, 'response', concat_ws('|', 'D0', tx, '1', 'A', '01', 'P' || sk) FROM f""",
)
def t06(spark, sf_dir):
    """Every value of both headers, by its name."""
    shown = lambda parsed, column, layout, side: parsed.select(*KEY, F.lit(side).alias("side"), F.concat_ws("|", *[F.col(f"{column}.{n}") for n, _ in layout]).alias("header"))
    return shown(requests(spark, sf_dir, only=("header",)), "header", codes.REQUEST_HEADER, "request").unionByName(shown(responses(spark, sf_dir, only=("responseHeader",)), "responseHeader", codes.RESPONSE_HEADER, "response"))


@query(
    "t02_response_gates",
    """SELECT kind, fatal, n_segments, region, count(*) AS n FROM (SELECT CASE WHEN k % 4 <> 0 THEN 'response' END AS kind, CASE WHEN k % 4 = 0 THEN 'NO_HEADER' END AS fatal, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 1 END AS n_segments,
    CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'D0|B1|1|A|01|SHORT' WHEN 2 THEN 'D0|B1|1|A|01|P' ELSE 'D0|B1|1|R||' END AS region FROM f) GROUP BY ALL""",
)
def t02(spark, sf_dir):
    """Responses that are too short, without a separator, with nothing after it, and with a header cut short."""
    n = F.col("k") % 4
    body = F.when(n == 0, F.lit("D0B1")).when(n == 1, F.lit("D0B11A01SHORT")).when(n == 2, F.lit("D0B11A01P              \x1d")).otherwise(F.lit("D0B11R\x1eAM21\x1cANR"))
    found = C.parse_claims(claim_messages(spark, sf_dir).select(body.alias("payload")))
    region = F.when(F.col("responseHeader").isNotNull(), F.concat_ws("|", *[F.col(f"responseHeader.{c}") for c, _ in codes.RESPONSE_HEADER]))
    keyed = found.select("kind", F.col("fatal.code").alias("fatal"), F.when(F.col("segments").isNotNull(), F.size("segments")).alias("n_segments"), region.alias("region"))
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))


@query("t09_sql_fields", "SELECT field_id, count(*) AS n FROM (SELECT 'AN' AS field_id FROM f UNION ALL SELECT 'FA' FROM f WHERE fa IS NOT NULL UNION ALL SELECT 'FB' FROM f, (VALUES (1), (2), (3)) AS v(i) WHERE i <= n_fb UNION ALL SELECT 'F3' FROM f WHERE sk % 2 = 0 UNION ALL SELECT 'FQ' FROM f WHERE ln % 6 = 0) GROUP BY 1")
def t09(spark, sf_dir):
    """The fields of the status segment through the SQL table function."""
    C.register(spark)
    messages = claim_messages(spark, sf_dir, "response").select("response")
    return spark.sql("SELECT field_id, count(*) AS n FROM {m} AS m, LATERAL claim_fields(m.response) AS f WHERE f.segment_id = '21' GROUP BY field_id", m=messages)


@query(
    "t09_sql_gates",
    """SELECT k, ln, seg_no, segment_id, field_no, field_id, value FROM (SELECT k, ln, 0 AS seg_no, '04' AS segment_id, 0 AS field_no, 'C2' AS field_id, 'X' || pk AS value FROM f WHERE k % 8 IN (5, 7)
    UNION ALL SELECT k, ln, 0, '', 0, 'C2', 'XY' || pk FROM f WHERE k % 8 = 6 UNION ALL SELECT k, ln, 1, '', 0, 'AM', '123' FROM f WHERE k % 8 = 6 UNION ALL SELECT k, ln, 3, '04', 0, '', 'Q' FROM f WHERE k % 8 = 6
    UNION ALL SELECT k, ln, 0, '21', 0, 'AN', 'R' || sk FROM f WHERE k % 4 = 3)""",
)
def t09_gates(spark, sf_dir):
    """The table function over messages that are refused, not decoded, cut short, of several transactions or odd, and their responses."""
    C.register(spark)
    n, head = F.col("k") % 8, F.rpad(F.lit("610066D0B1PCN"), 56, " ")
    value = F.concat(F.lit("C2X"), F.col("pk"))
    request = (
        F.when(n == 0, F.lit(" \t\n")).when(n == 1, F.lit("610066D0B1")).when(n == 2, F.concat(F.rpad(F.lit("61006651B1PCN"), 56, " "), F.lit("\x1eAM04\x1c"), value)).when(n == 3, F.concat(head, F.lit("AM04"), value))
        .when(n == 4, F.concat(F.rpad(F.lit("610066F6B1"), 56, " "), F.lit("\x1eAM04\x1c"), value)).when(n == 5, F.concat(head, F.lit("\x1dAM04\x1c"), value, F.lit("\x1d\x1dAM07")))
        .when(n == 6, F.concat(head, F.lit("\x1eC2XY"), F.col("pk"), F.lit("\x1eAM123\x1eAM99\x1eAM04\x1cQ"))).otherwise(F.concat(head, F.lit("\x1eAM04\x1c"), value))
    )
    m = F.col("k") % 4
    answer = F.when(m == 0, F.lit("D0B1")).when(m == 1, F.lit("D0B11A01SHORT")).when(m == 2, F.lit("D0B11A01P              \x1d")).otherwise(F.concat(F.lit("D0B11R\x1eAM21\x1cANR"), F.col("sk")))
    messages = claim_messages(spark, sf_dir).select(*KEY, F.explode(F.array(request, answer)).alias("payload"))
    return spark.sql("SELECT k, ln, f.* FROM {m} AS m, LATERAL claim_fields(m.payload) AS f", m=messages)


#: The requests of the facts in their canonical form; a masked one has X for each letter of what the scan finds.
REQUEST_TEXTS = """, v AS (SELECT *, pk % 9 = 0 AS named, CASE WHEN ship = '19970101' THEN ship ELSE 'XXXXXXXX' END AS m_ship, CASE WHEN given = 'Ann' THEN 'XXX' ELSE given END AS m_given,
    'XXXXXX' || repeat('X', length(family) + 1) AS m_family, CASE WHEN street = 'Box 9' THEN street ELSE repeat('X', length(street)) END AS m_street, CASE WHEN phone LIKE '(%' THEN repeat('X', length(phone)) ELSE phone END AS m_phone, CASE WHEN patient = '123456' THEN 'XXXXXX' ELSE patient END AS m_patient FROM f),
  q AS (SELECT *, '610066D0' || tx || 'PCN       ' || '101' || rpad('P' || sk, 15, ' ') || ship || 'SW        ' AS head,
    concat_ws(chr(28), 'AM01', 'C4' || ship, CASE WHEN ln % 2 = 0 THEN 'C51' END, CASE WHEN named THEN concat_ws(chr(28), 'CA' || given, 'CBDr. Jo ' || family, 'CM' || street, 'CQ' || phone, 'CY' || patient) END) AS s01,
    concat_ws(chr(28), 'AM01', 'C4' || m_ship, CASE WHEN ln % 2 = 0 THEN 'C51' END, CASE WHEN named THEN concat_ws(chr(28), 'CA' || m_given, 'CB' || m_family, 'CM' || m_street, 'CQ' || m_phone, 'CY' || m_patient) END) AS m01,
    concat_ws(chr(28), 'AM04', 'C2SYNTH' || k, CASE WHEN pk % 2 = 0 THEN 'C1G' || pk END, CASE WHEN pk % 3 = 0 THEN 'C301' END) AS s04,
    concat_ws(chr(28), 'AM07', 'EM1', 'D2' || k || ln, CASE WHEN pk % 7 <> 0 THEN 'D7' || lpad(CAST(pk AS VARCHAR), 11, '0') END, CASE WHEN pk % 7 < 5 THEN 'E1' || lpad(CAST(pk % 5 AS VARCHAR), 2, '0') END, 'E7' || milli, 'D5' || CASE WHEN sk % 2 = 0 THEN '30' ELSE '3x' END, 'D80', 'D30') AS s07,
    concat_ws(chr(28), 'AM03', 'EZ01', 'DBN' || sk) AS s03, CASE WHEN n_dur > 0 THEN concat_ws(chr(28), 'AM08', 'E4DD', 'E5M0', CASE WHEN n_dur > 1 THEN 'E4ZZ' END, CASE WHEN n_dur > 1 THEN '8E11' END) END AS s08,
    CASE WHEN n_ing > 0 THEN concat_ws(chr(28), 'AM10', 'EF01', 'EC' || (n_ing + ln % 2), array_to_string(list_transform(range(1, n_ing + 1), lambda i: concat_ws(chr(28), CASE WHEN NOT bare THEN 'RE03' END, 'TE' || pk || i, 'ED' || milli, 'EE' || cents)), chr(28))) END AS s10,
    CASE WHEN n_pay > 0 THEN concat_ws(chr(28), 'AM05', '4C' || (n_pay + ln % 2), array_to_string(list_transform(range(1, n_pay + 1), lambda i: concat_ws(chr(28), '5C0' || i, '6C99', '7C' || sk, 'HC07', 'DV' || cents, 'DV100', '6E06', CASE WHEN sk % 2 = 0 THEN '7E' || cents END, CASE WHEN ln % 3 = 0 THEN '7E50' END)), chr(28))) END AS s05,
    CASE WHEN pk % 11 = 0 THEN concat_ws(chr(28), 'AM12', 'EU1', CASE WHEN sk % 2 = 0 THEN 'EV' || k END) END AS s12 FROM v)"""


@query("w01_request_text", f"{REQUEST_TEXTS} SELECT k, ln, head || concat_ws(chr(30), s01, s04, s07, s03, s08, s10, s05, s12) AS wire FROM q")
def w01_request_text(spark, sf_dir):
    """Canonical text of requests, byte for byte."""
    return C.with_wire(requests(spark, sf_dir, only=WIRE)).select(*KEY, "wire")


def _long(spark: SparkSession, sf_dir: str, side: str) -> tuple[DataFrame, DataFrame]:
    """(parsed messages with an id of their own, their field rows)."""
    whole = F.struct(*KEY, F.nullif(F.monotonically_increasing_id(), F.lit(-1)).alias("n")).alias("id")
    read = C.parse_claims(claim_messages(spark, sf_dir, side).select(whole, side), side, only=WIRE, names=False)
    return read, L.fields_of(read, "id")


@query("w03_masked_text", f"{REQUEST_TEXTS} SELECT k, ln, head || concat_ws(chr(30), s01, s04, s07, s03, s08, s10, s05, s12) AS wire, head || concat_ws(chr(30), m01, s04, s07, s03, s08, s10, s05, s12) AS masked FROM q")
def w03(spark, sf_dir):
    """Requests written back from their field rows, as they are and with the scan's hits written over."""
    read, fields = _long(spark, sf_dir, "request")
    heads = read.select("id", "kind", "header", "responseHeader")
    at = F.struct("id", "seg_no", "field_no")
    values = fields.select(at.alias("path"), F.col("field_id").alias("location"), S.lookup(scan.FIELD_CATEGORIES, F.col("field_id")).alias("category"), "value").where("category IS NOT NULL")
    hits = scan.check_values(values, scan.allow_rows(spark.createDataFrame(_ALLOW, "kind string, value string"))).select("path.id", "path.seg_no", "path.field_no")
    plain = L.text_of(fields, heads, "id")
    over = L.text_of(L.masked(fields, hits, "id"), heads, "id").withColumnRenamed("wire", "masked")
    return plain.join(over, "id").select("id.k", "id.ln", "wire", "masked")


@query(
    "t40_long_alerts",
    f"""SELECT k, ln, CAST(i - 1 AS INT) AS pos, CASE WHEN (sk + i) % 2 = 0 THEN CAST(i AS VARCHAR) END AS counter, r AS reason, r <> 'ZZ' AS known, {_sql_map('r', codes.DUR_REASONS)} AS reason_name,
    CASE WHEN i = n_dur AND ln % 2 = 0 THEN 'last' ELSE 't' || i END AS note FROM (SELECT *, CASE (pk + i) % 3 WHEN 0 THEN 'DD' WHEN 1 THEN 'TD' ELSE 'ZZ' END AS r FROM f, (VALUES (1), (2)) AS v(i) WHERE i <= n_dur)""",
)
def t40_long(spark, sf_dir):
    """The alerts of t40 from field rows."""
    found = L.alerts(_long(spark, sf_dir, "response")[1], "id")
    return found.select("id.k", "id.ln", F.col("block").alias("pos"), "counter", "reason", F.col("reason_known").alias("known"), "reason_name", "note")


@query(
    "t45_long_payers",
    f"""SELECT k, ln, CAST(i - 1 AS INT) AS pos, '0' || i AS coverage, CAST(sk AS VARCHAR) AS payer, CAST(j AS INT) AS row_no, CASE j WHEN 0 THEN '07' END AS qualifier, CASE j WHEN 0 THEN {AMOUNT} ELSE '1.00' END AS amount FROM f, (VALUES (1), (2)) AS v(i), (VALUES (0), (1)) AS w(j) WHERE i <= n_pay""",
)
def t45_long(spark, sf_dir):
    """Other payers and what they paid, from field rows that are shuffled once."""
    blocks = L.payer_blocks(_long(spark, sf_dir, "request")[1], "id")
    found = L.payers(blocks, "id").join(L.amounts(blocks, "id"), ["id", "block"])
    return found.select("id.k", "id.ln", F.col("block").alias("pos"), "coverage", "payer", "row_no", "qualifier", F.col("amount.amount").alias("amount"))


@query("w01_canonical_text", f"{RESPONSE_TEXTS} SELECT k, ln, head || concat_ws(chr(30), s21, s23, s24, s28) AS wire FROM w")
def w01_text(spark, sf_dir):
    """Canonical text, byte for byte."""
    return C.with_wire(responses(spark, sf_dir, only=WIRE)).select(*KEY, "wire")


@query(
    "t51_request_warnings",
    """SELECT k, ln, code, field_id, CAST(ord AS INT) AS ord FROM (SELECT k, ln, 'COMPOUND_COUNT_MISMATCH' AS code, 'EC' AS field_id, 0 AS ord FROM f WHERE n_ing > 0 AND ln % 2 = 1
    UNION ALL SELECT k, ln, 'COB_COUNT_MISMATCH', '4C', CASE WHEN n_ing > 0 AND ln % 2 = 1 THEN 1 ELSE 0 END FROM f WHERE n_pay > 0 AND ln % 2 = 1
    UNION ALL SELECT k, ln, 'UNKNOWN_DUR_REASON', 'E4', CASE WHEN n_ing > 0 AND ln % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN n_pay > 0 AND ln % 2 = 1 THEN 1 ELSE 0 END FROM f WHERE n_dur > 1)""",
)
def t51(spark, sf_dir):
    found = requests(spark, sf_dir, only=("warnings",)).select(*KEY, F.posexplode("warnings").alias("ord", "w"))
    return found.select(*KEY, F.col("w.code"), F.col("w.fieldId").alias("field_id"), "ord")


_BAD = "CASE k % 8 WHEN 0 THEN 'blank' WHEN 1 THEN 'short' WHEN 2 THEN 'stamp' WHEN 3 THEN 'framing' WHEN 4 THEN 'f6' WHEN 5 THEN 'several' WHEN 6 THEN 'odd' ELSE 'fine' END"


@query(
    "t01_gates",
    f"""SELECT kind, fatal, n_segments, warnings, count(*) AS n FROM (SELECT CASE WHEN b IN ('blank', 'short', 'stamp', 'framing') THEN NULL ELSE 'request' END AS kind,
    CASE b WHEN 'blank' THEN 'EMPTY_INPUT@0' WHEN 'short' THEN 'NO_HEADER@0' WHEN 'stamp' THEN 'UNSUPPORTED_VERSION@6' WHEN 'framing' THEN 'INVALID_FRAMING@56' END AS fatal,
    CASE b WHEN 'f6' THEN 0 WHEN 'several' THEN 1 WHEN 'odd' THEN 4 WHEN 'fine' THEN 1 END AS n_segments,
    CASE b WHEN 'f6' THEN 'VF6_NOT_DECODED@0' WHEN 'several' THEN 'MULTI_TRANSACTION_TRUNCATED@67'
      WHEN 'odd' THEN 'MISSING_SEGMENT_ID@57,MALFORMED_SEGMENT_ID@62,UNKNOWN_SEGMENT@68,MALFORMED_FIELD@78' WHEN 'fine' THEN '' END AS warnings
    FROM (SELECT *, {_BAD} AS b FROM f)) GROUP BY 1, 2, 3, 4""",
)
def t01(spark, sf_dir):
    head = F.rpad(F.lit("610066D0B1PCN"), 56, " ")
    body = (
        F.when(F.col("b") == "blank", F.lit(" \t\n")).when(F.col("b") == "short", F.lit("610066D0B1")).when(F.col("b") == "stamp", F.rpad(F.lit("61006651B1PCN"), 60, " "))
        .when(F.col("b") == "framing", F.concat(head, F.lit("AM04"))).when(F.col("b") == "f6", F.rpad(F.lit("610066F6B1"), 70, " ")).when(F.col("b") == "several", F.concat(head, F.lit("\x1dAM04\x1cC2X\x1d\x1dAM07")))
        .when(F.col("b") == "odd", F.concat(head, F.lit("\x1eC2X\x1cZ\x1eAM123\x1eAM99\x1eAM04\x1cQ"))).otherwise(F.concat(head, F.lit("\x1eAM04\x1cC2X")))
    )
    body = F.when(F.col("b") == "odd", F.concat(head, F.lit("\x1eC2XY\x1eAM123\x1eAM99\x1eAM04\x1cQ"))).otherwise(body)
    raw = claim_messages(spark, sf_dir).selectExpr(*KEY, f"{_BAD} AS b")
    found = C.parse_claims(raw.select("b", body.alias("payload")), names=False)
    at = lambda code, offset: F.concat_ws("@", code, offset.cast("string"))
    listed = F.array_join(F.transform("warnings", lambda w: at(w["code"], w["byteOffset"])), ",")
    keyed = found.select("kind", F.when(F.col("fatal").isNotNull(), at(F.col("fatal.code"), F.col("fatal.byteOffset"))).alias("fatal"), F.when(F.col("segments").isNotNull(), F.size("segments")).alias("n_segments"), listed.alias("warnings"))
    return keyed.groupBy("kind", "fatal", "n_segments", "warnings").agg(F.count("*").alias("n"))


@query("w01_canonical", "SELECT flag, side, count(*) AS n, count(*) AS n_stable, CAST(sum(length(side) * 0 + 1) AS BIGINT) AS n_read FROM f, (VALUES ('request'), ('response')) AS v(side) GROUP BY 1, 2")
def w01(spark, sf_dir):
    """Emitting what was read, reading that and emitting again changes nothing."""
    once = lambda parsed, side: C.with_wire(parsed).select("flag", F.lit(side).alias("side"), F.col("wire").alias("w1"))
    both = once(requests(spark, sf_dir, only=WIRE), "request").unionByName(once(responses(spark, sf_dir, only=WIRE), "response"))
    again = C.with_wire(C.parse_claims(both.withColumn("payload", F.col("w1")), only=WIRE, names=False))
    same = (F.col("w1") == F.col("wire")).cast("long")
    return again.groupBy("flag", "side").agg(F.count("*").alias("n"), F.sum(same).alias("n_stable"), F.sum(F.col("fatal").isNull().cast("long")).alias("n_read"))


@query(
    "w04_build",
    """SELECT b, CASE b WHEN 0 THEN 'MISSING_TRANSACTION_CODE' WHEN 1 THEN 'FIELD_TOO_LONG' WHEN 2 THEN 'EMBEDDED_CONTROL_CHARACTER' WHEN 3 THEN 'MISSING_SEGMENT_ID'
    WHEN 4 THEN 'INVALID_SEGMENT_ID' WHEN 5 THEN 'INVALID_FIELD_ID' WHEN 6 THEN 'EMBEDDED_CONTROL_CHARACTER' END AS code,
    CASE b WHEN 1 THEN 'binNumber' WHEN 2 THEN 'processorControlNumber' END AS header_field, CASE WHEN b = 7 THEN CAST(count(*) AS BIGINT) ELSE 0 END AS n_read, count(*) AS n FROM (SELECT CAST(k % 8 AS INT) AS b FROM f) GROUP BY b""",
)
def w04(spark, sf_dir):
    b = F.col("b")
    header = F.struct(
        F.when(b == 0, " ").otherwise("B1").alias("transactionCode"), F.when(b == 1, "6100661").otherwise("610066").alias("binNumber"), F.when(b == 2, F.lit("P\x1d")).otherwise(F.lit("PCN")).alias("processorControlNumber")
    )
    field = F.struct(F.when(b == 5, "C").otherwise("C2").alias("id"), F.when(b == 6, F.lit("\x1e")).otherwise(F.concat(F.lit("X"), F.col("k"))).alias("value"))
    segments = F.array(F.struct(F.when(b == 3, " ").when(b == 4, "041").otherwise("04").alias("segmentId"), F.array(field).alias("fields")))
    inputs = claim_messages(spark, sf_dir).selectExpr("CAST(k % 8 AS INT) AS b", "k").select("b", "k", header.alias("header"), segments.alias("segments"))
    built = C.with_wire(C.build_requests(inputs)).select("b", "k", "buildError", F.when(F.col("buildError").isNull(), F.col("wire")).alias("payload"))
    read = C.with_claim(C.parse_claims(built))
    same = F.coalesce((F.col("claim.cardholderId") == F.concat(F.lit("X"), F.col("k"))).cast("long"), F.lit(0))
    return read.groupBy("b", F.col("buildError.code").alias("code"), F.col("buildError.headerField").alias("header_field")).agg(F.sum(same).alias("n_read"), F.count("*").alias("n"))


@query("p05_expected_warnings", f"SELECT flag, CAST(sum(CASE WHEN n_fb > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_expected, CAST(sum(CASE WHEN an = 'X' THEN 1 ELSE 0 END + CASE WHEN {CONFLICT} THEN 1 ELSE 0 END + CASE WHEN n_pay > 0 AND ln % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unexpected FROM f GROUP BY flag")
def p05(spark, sf_dir):
    found = profiles.partition_warnings(responses(spark, sf_dir, only=("warnings",)), profiles.PBM)
    return found.groupBy("flag").agg(F.sum(F.size("expected").cast("long")).alias("n_expected"), F.sum(F.size("unexpected").cast("long")).alias("n_unexpected"))


#: Partners from the tables: a region's profile, a nation's that extends it, and a supplier's that extends its nation's and, for
#: every third, a shared one. SQL that Spark and DuckDB read alike.
PARTNERS = """, pr AS (SELECT 'region-' || r_regionkey AS name, 'Rules of ' || r_name AS description FROM region UNION ALL SELECT 'nation-' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Rules of ' || n_name END FROM nation
    UNION ALL SELECT 'shared', 'Shared rules' UNION ALL SELECT 'supplier-' || s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN s_name END FROM supplier),
  pa AS (SELECT 'nation-' || n_nationkey AS name, 'region-' || n_regionkey AS parent, 0 AS ord FROM nation UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 0 FROM supplier UNION ALL SELECT 'supplier-' || s_suppkey, 'shared', 1 FROM supplier WHERE s_suppkey % 3 = 0),
  qu AS (SELECT 'region-' || r_regionkey AS name, 0 AS ord, 'person-code' AS id, 'telecom' AS standard, 'requires' AS effect, 'region' AS summary, CAST(NULL AS STRING) AS code FROM region UNION ALL SELECT 'region-' || r_regionkey, 1, 'routing', 'script', 'adds', 'region', 'VERSION_ABSENT' FROM region WHERE r_regionkey % 2 = 0
    UNION ALL SELECT 'nation-' || n_nationkey, 0, 'reject-depth', 'telecom', 'adds', 'nation', 'UNKNOWN_REJECT_CODE' FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'nation-' || n_nationkey, 1, 'person-code', 'telecom', 'relaxes', 'nation', NULL FROM nation WHERE n_nationkey % 4 = 0
    UNION ALL SELECT 'shared', 0, 'status-conflicts', 'telecom', 'adds', 'shared', 'STATUS_CONFLICT' UNION ALL SELECT 'shared', 1, 'reject-depth', 'telecom', 'relaxes', 'shared', NULL
    UNION ALL SELECT 'supplier-' || s_suppkey, 0, 'payer-counts', 'telecom', 'adds', 'supplier', 'COB_COUNT_MISMATCH' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'supplier-' || s_suppkey, 1, 'person-code', 'telecom', 'adds', 'supplier', NULL FROM supplier WHERE s_suppkey % 2 = 0)"""
#: The layers of every profile in their order, and its quirks, by the depth that the partners have.
MERGED = PARTNERS + """, ly AS (SELECT name, name AS layer, 9 AS rk FROM pr UNION ALL SELECT name, parent, 2 FROM pa WHERE name LIKE 'nation%' UNION ALL SELECT name, parent, 3 + ord FROM pa WHERE name LIKE 'supplier%'
    UNION ALL SELECT s.name, n.parent, 2 FROM pa s JOIN pa n ON n.name = s.parent WHERE s.name LIKE 'supplier%'),
  oc AS (SELECT ly.name, rk * 10 + qu.ord AS place, id, standard, effect, summary, code FROM ly JOIN qu ON qu.name = layer),
  mq AS (SELECT name, id, min(place) AS first, max_by(standard, place) AS standard, max_by(effect, place) AS effect, max_by(summary, place) AS summary, max_by(coalesce(code, ''), place) AS code FROM oc GROUP BY name, id)"""


def partners(spark: SparkSession, sf_dir: str):
    """(profiles, parents, quirks) of the partners."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "supplier")}
    names = ("pr", "pa", "qu")
    text = PARTNERS
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    profiles_, parents, quirks = (spark.sql(f"WITH {text[1:]} SELECT * FROM {n}", **frames) for n in names)
    codes_ = F.array_compact(F.array("code"))
    quirks = quirks.select("name", "ord", "id", "standard", "effect", "summary", F.lit("claims/partner.txt").alias("fixture"), F.lit("Partner sheet").alias("source_category"), codes_.alias("expected_warnings"))
    return profiles_, parents, quirks


@query("p03_merged_profiles", f"{MERGED} SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY first) - 1 AS INT) AS ord, id, standard, effect, summary, code FROM mq")
def p03(spark, sf_dir):
    """The quirks of all partners over three levels: later layers replace one at its first place."""
    profiles_, parents, quirks = partners(spark, sf_dir)
    merged = T.merge_quirks(T.layers_of(profiles_, parents), quirks)
    return merged.select("name", "ord", "id", "standard", "effect", "summary", F.array_join("expected_warnings", ",").alias("code"))


@query(
    "p09_profiles",
    f"""{MERGED} SELECT name, description, lineage, coalesce(standards, '') AS standards, coalesce(expected, '') AS expected, coalesce(n_relaxes, 0) AS n_relaxes, coalesce(n_adds, 0) AS n_adds, coalesce(n_requires, 0) AS n_requires
    FROM (SELECT ly.name, max_by(pr.description, CASE WHEN pr.description IS NOT NULL THEN rk END) AS description, string_agg(layer, '>' ORDER BY rk) AS lineage FROM ly JOIN pr ON pr.name = layer GROUP BY ly.name)
    LEFT JOIN (SELECT name, string_agg(DISTINCT standard, ',' ORDER BY standard) AS standards, string_agg(DISTINCT nullif(code, ''), ',' ORDER BY nullif(code, '')) AS expected, count(*) FILTER (effect = 'relaxes') AS n_relaxes, count(*) FILTER (effect = 'adds') AS n_adds, count(*) FILTER (effect = 'requires') AS n_requires FROM mq GROUP BY name) USING (name)""",
)
def p09(spark, sf_dir):
    """Every partner's description, lineage, standards and expected warnings."""
    profiles_, parents, quirks = partners(spark, sf_dir)
    layers = T.layers_of(profiles_, parents)
    told = T.describe_profiles(profiles_, layers, T.merge_quirks(layers, quirks))
    joined = [F.array_join(c, s).alias(n) for c, s, n in (("lineage", ">", "lineage"), ("standards", ",", "standards"), ("expected_warnings", ",", "expected"))]
    return told.select("name", "description", *joined, "n_relaxes", "n_adds", "n_requires")


@query(
    "p05_partner_warnings",
    f"""{MERGED}, wa AS (SELECT sk, code FROM (SELECT sk, CASE WHEN an = 'X' THEN 'UNKNOWN_RESPONSE_STATUS' END AS code FROM f UNION ALL SELECT sk, 'UNKNOWN_REJECT_CODE' FROM f WHERE n_fb > 1 UNION ALL SELECT sk, 'STATUS_CONFLICT' FROM f WHERE {CONFLICT} UNION ALL SELECT sk, 'COB_COUNT_MISMATCH' FROM f WHERE n_pay > 0 AND ln % 5 = 0) WHERE code IS NOT NULL)
    SELECT sk, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM mq WHERE mq.name = 'supplier-' || sk AND mq.code = wa.code) THEN 1 ELSE 0 END) AS BIGINT) AS n_expected, count(*) AS n FROM wa GROUP BY sk""",
)
def p05_partners(spark, sf_dir):
    """Warnings of responses by whether the partner that the row names expects them."""
    profiles_, parents, quirks = partners(spark, sf_dir)
    layers = T.layers_of(profiles_, parents)
    told = T.describe_profiles(profiles_, layers, T.merge_quirks(layers, quirks))
    found = T.partition_warnings_by(responses(spark, sf_dir, "sk", only=("warnings",)), told, F.concat(F.lit("supplier-"), F.col("sk")))
    return found.groupBy("sk").agg(F.sum(F.size("expected").cast("long")).alias("n_expected"), F.sum(F.size("warnings").cast("long")).alias("n")).where("n > 0")


@query(
    "c01_scalars",
    """SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_partkey || '.' || p_size ELSE p_partkey || '.' END AS source, p_size % 2 = 0 AS is_decimal,
    CASE p_partkey % 7 WHEN 0 THEN '5-4-2' WHEN 1 THEN '5-4-1' WHEN 2 THEN '5-3-2' WHEN 3 THEN '4-4-2' WHEN 4 THEN '11-digit' WHEN 5 THEN '10-digit' ELSE 'unknown' END AS ndc,
    CASE p_size % 6 WHEN 0 THEN 'NDC' WHEN 1 THEN 'RXNORM' WHEN 2 THEN 'SNOMED' WHEN 3 THEN 'NCI' WHEN 4 THEN 'ICD10' ELSE 'UNKNOWN' END AS system, CAST(p_size AS BIGINT) AS prefix FROM part""",
)
def c01(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_size")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    shape = pick(F.col("k") % 7, ["12345-1234-12", "12345-1234-1", "12345-123-12", "1234-1234-12", "12345678901", "1234567890", "123-1-1"])
    qualifier = pick(F.col("p_size") % 6, [" nd", "RxCUI ", "sct", "NCI", "icd-10", "none"])
    source = F.concat(F.col("k"), F.lit("."), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(""))
    step = part.select("k", "p_size", shape.alias("shape"), qualifier.alias("q"), source.alias("source"))
    return step.select("k", "source", S.decimal_value(F.col("source"))["isValid"].alias("is_decimal"), S.ndc_segmentation(F.col("shape")).alias("ndc"), S.code_system(F.col("q")).alias("system"), S.prefix_int(F.concat(F.lit(" "), F.col("p_size"), F.lit("x1"))).cast("long").alias("prefix"))


# -- e-prescribing


def scripts(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return P.parse_scripts(script_messages(spark, sf_dir).select("k", "payload"), only=only or None)


_KINDS = "CASE sort WHEN 0 THEN 'NewRx' WHEN 1 THEN 'RxRenewalRequest' WHEN 2 THEN 'RxChangeRequest' WHEN 3 THEN 'CancelRx' WHEN 4 THEN 'RxRenewalResponse' WHEN 5 THEN 'RxChangeResponse' WHEN 6 THEN 'CancelRxResponse' WHEN 7 THEN 'Status' WHEN 8 THEN 'Error' WHEN 9 THEN 'Verify' WHEN 12 THEN 'NewRx' WHEN 13 THEN NULL ELSE 'unsupported' END"
_MED = "sort IN (0, 1, 2, 12) OR (sort = 4 AND shape = 2)"


@query(
    "s03_messages",
    f"""SELECT k, {_KINDS} AS kind, CASE WHEN sort = 13 THEN 'NOT_XML' END AS fatal, CASE WHEN sort < 13 THEN CASE v WHEN 0 THEN '2017071' WHEN 1 THEN '2023011' WHEN 2 THEN '2099001' WHEN 4 THEN '2017071' END END AS version,
    CASE WHEN sort < 13 THEN 'PH' || ck END AS to_id, CASE WHEN sort < 13 THEN 'DR ' || (k % 10) END AS from_id, CASE WHEN sort >= 4 AND sort < 10 THEN 'M' || (k - 3) END AS relates_to, CASE WHEN sort = 10 THEN 'RxFill' END AS transaction,
    CASE sort WHEN 7 THEN 'success' WHEN 8 THEN 'error' WHEN 9 THEN 'verify' END AS disposition FROM o""",
)
def s03(spark, sf_dir):
    return scripts(spark, sf_dir, "kind", "version", "header", "correlatesTo", "transaction", "disposition").select("k", "kind", F.col("fatal.code").alias("fatal"), "version", F.col("header.to").alias("to_id"), F.col("header.from").alias("from_id"), F.col("correlatesTo").alias("relates_to"), "transaction", "disposition")


@query(
    "s05_headers",
    """SELECT k, 'M' || k AS message, CASE WHEN k % 3 = 0 THEN '2024-01-02T03:04:05Z' END AS sent, CASE WHEN k % 3 = 0 THEN 'O' || k END AS order_number FROM o WHERE sort < 13""",
)
def s05(spark, sf_dir):
    h = lambda n, to: F.col(f"header.{n}").alias(to)
    return scripts(spark, sf_dir, "kind", "header").where("kind IS NOT NULL").select("k", h("messageId", "message"), h("sentTime", "sent"), h("prescriberOrderNumber", "order_number"))


@query(
    "s38_prescriptions",
    f"""SELECT k, {_KINDS} AS kind, CASE WHEN sort IN (0, 1, 2, 3) THEN 'L' || ck END AS last_name, CASE WHEN sort IN (0, 1, 2, 3) THEN CASE WHEN ck % 2 = 0 THEN 'M' ELSE 'F' END END AS gender,
    CASE WHEN sort IN (0, 1, 2, 3) THEN CASE WHEN k % 2 = 0 THEN '1980-01-01' ELSE '1980-01-02' END END AS born, CASE WHEN sort IN (0, 1, 2, 3) THEN 'Store &amp; Co' END AS store, CASE WHEN sort IN (0, 1, 2, 3) THEN CAST(k AS VARCHAR) END AS npi,
    CASE WHEN {_MED} THEN 'Drug ' || (k % 100) END AS drug, CASE WHEN {_MED} THEN CASE shape WHEN 0 THEN 'NDC' END END AS product_system, CASE WHEN {_MED} THEN CASE shape WHEN 1 THEN 'RXNORM' END END AS db_system,
    CASE WHEN {_MED} THEN CASE shape WHEN 1 THEN 'C42' END END AS form, CASE WHEN {_MED} THEN total || CASE shape WHEN 3 THEN '.5' WHEN 4 THEN '.' ELSE '' END END AS quantity, CASE WHEN {_MED} THEN shape <> 4 END AS quantity_valid,
    CASE WHEN {_MED} THEN CASE shape WHEN 5 THEN '3' ELSE '1' END END AS refills, CASE WHEN {_MED} THEN CASE WHEN shape IN (2, 3, 4) THEN NULL ELSE 'none' END END AS directions,
    CASE WHEN sort IN (0, 1, 2, 3) THEN 'F' END AS first_name, CASE WHEN sort IN (0, 1, 2, 3) AND ck % 3 = 0 THEN 'Q' END AS middle_name, CASE WHEN sort IN (0, 1, 2, 3) THEN CAST(1000000 + ck AS VARCHAR) END AS pharmacy_number, CASE WHEN sort IN (0, 1, 2, 3) THEN 'Doc' END AS doctor,
    CASE WHEN sort IN (0, 1, 2, 3) AND k % 2 = 0 THEN 'AB' || k END AS dea, CASE WHEN {_MED} THEN CASE k % 2 WHEN 0 THEN '30' ELSE '3x' END END AS days, CASE WHEN {_MED} THEN k % 2 = 0 END AS days_valid, CASE WHEN ({_MED}) AND k % 2 = 0 THEN '0' END AS substitutions,
    CASE WHEN {_MED} THEN CASE k % 2 WHEN 0 THEN '2024-01-02' ELSE '2024-01-03' END END AS written, CASE WHEN ({_MED}) AND k % 2 = 0 THEN 'take care' END AS note, CASE WHEN {_MED} THEN CASE shape WHEN 2 THEN 'take one' WHEN 3 THEN 'take two' WHEN 4 THEN 'as told' WHEN 5 THEN 'plain' END END AS sig_text,
    CASE WHEN ({_MED}) AND shape = 1 THEN '5' END AS strength, CASE WHEN ({_MED}) AND shape = 1 THEN 'mg' END AS strength_unit FROM o WHERE sort <> 13""",
)
def s38(spark, sf_dir):
    m = lambda n, to: F.col(f"medication.{n}").alias(to)
    found = scripts(spark, sf_dir, "kind", "patient", "pharmacy", "prescriber", "medication").where("fatal IS NULL")
    return found.select(
        "k", "kind", F.col("patient.name.lastName").alias("last_name"), F.col("patient.gender").alias("gender"), F.col("patient.dateOfBirth").alias("born"), F.col("pharmacy.businessName").alias("store"), F.col("prescriber.identification.npi").alias("npi"),
        m("description", "drug"), m("coded.productCode.system", "product_system"), m("coded.drugDbCode.system", "db_system"), m("strength.form", "form"), m("quantity.value.source", "quantity"), m("quantity.value.isValid", "quantity_valid"),
        m("numberOfRefills", "refills"), m("directions", "directions"), F.col("patient.name.firstName").alias("first_name"), F.col("patient.name.middleName").alias("middle_name"),
        F.col("pharmacy.identification.pharmacyNumber").alias("pharmacy_number"), F.col("prescriber.name.lastName").alias("doctor"), F.col("prescriber.identification.deaNumber").alias("dea"),
        m("daysSupply.source", "days"), m("daysSupply.isValid", "days_valid"), m("substitutions", "substitutions"), m("writtenDate", "written"), m("note", "note"), m("sigText", "sig_text"), m("strength.value", "strength"), m("strength.unitOfMeasure", "strength_unit"),
    )


@query(
    "s47_lifecycle",
    """SELECT k, CASE sort WHEN 4 THEN 'RxRenewalResponse' WHEN 5 THEN 'RxChangeResponse' ELSE 'CancelRxResponse' END AS kind, outcome, CASE WHEN outcome IN ('approved', 'approvedWithChanges') THEN 'affirmative' WHEN outcome IN ('denied', 'deniedNewToFollow') THEN 'negative' ELSE 'indeterminate' END AS approval,
    CASE WHEN sort = 4 AND shape = 1 THEN 'no' WHEN sort = 6 THEN 'late' END AS denial, CASE WHEN sort = 4 AND shape = 3 THEN 'AA' END AS code, CASE WHEN sort = 5 AND shape % 2 = 0 THEN 'ok' END AS note, CASE WHEN sort = 4 THEN 'R' || (k - 3) END AS reference
    FROM (SELECT *, CASE sort WHEN 4 THEN CASE shape WHEN 0 THEN 'approved' WHEN 1 THEN 'denied' WHEN 2 THEN 'approvedWithChanges' WHEN 3 THEN 'denied' WHEN 4 THEN 'unknown' ELSE 'deniedNewToFollow' END
      WHEN 5 THEN CASE WHEN shape % 2 = 0 THEN 'validated' ELSE 'replace' END ELSE 'denied' END AS outcome FROM o WHERE sort IN (4, 5, 6))""",
)
def s47(spark, sf_dir):
    found = P.of_kind(scripts(spark, sf_dir, "kind", "outcome", "reason", "requestReferenceNumber"), *codes.LIFECYCLE_RESPONSES)
    return found.select("k", "kind", "outcome", S.approval(F.col("outcome")).alias("approval"), F.col("reason.denialReason").alias("denial"), F.col("reason.code").alias("code"), F.col("reason.note").alias("note"), F.col("requestReferenceNumber").alias("reference"))


@query("s46_answers", "SELECT k, CASE sort WHEN 7 THEN 'Status' WHEN 8 THEN 'Error' ELSE 'Verify' END AS kind, CASE sort WHEN 7 THEN '000' WHEN 8 THEN '600' END AS code, CASE sort WHEN 8 THEN '10' END AS description_code, CASE sort WHEN 7 THEN 'fine' END AS description FROM o WHERE sort IN (7, 8, 9)")
def s46(spark, sf_dir):
    found = P.of_kind(scripts(spark, sf_dir, "kind", "response"), *codes.RESPONSE_KINDS)
    return found.select("k", "kind", F.col("response.code").alias("code"), F.col("response.descriptionCode").alias("description_code"), F.col("response.description").alias("description"))


@query(
    "s49_directions",
    f"""SELECT k, CASE shape WHEN 2 THEN 'take one' WHEN 3 THEN 'take two' ELSE 'as told' END AS sig_text, shape = 2 AS structured, CASE shape WHEN 2 THEN 'derived' ELSE 'absent' END AS dose, CASE shape WHEN 2 THEN 'coded' ELSE 'absent' END AS route,
    CASE shape WHEN 2 THEN 'PO' END AS route_code, CASE shape WHEN 2 THEN 'SNOMED' END AS route_system, CASE shape WHEN 2 THEN 'by mouth' END AS route_text FROM o WHERE ({_MED}) AND shape IN (2, 3, 4)""",
)
def s49(spark, sf_dir):
    s = lambda n, to: F.col(f"medication.sig.{n}").alias(to)
    found = scripts(spark, sf_dir, "medication").where("medication.sig IS NOT NULL")
    return found.select("k", s("sigText", "sig_text"), s("hasStructuredData", "structured"), s("dose.provenance", "dose"), s("route.provenance", "route"), s("route.code.value", "route_code"), s("route.code.system", "route_system"), s("route.text", "route_text"))


@query(
    "s49_sig_components",
    f"""SELECT k, component, CASE WHEN shape = 2 THEN provenance ELSE 'absent' END AS provenance, CASE WHEN shape = 2 THEN text END AS text, CASE WHEN shape = 2 THEN code END AS code, CASE WHEN shape = 2 THEN system END AS system FROM o, (VALUES ('doseDeliveryMethod', 'derived', 'Take', NULL, NULL), ('dose', 'derived', '1', NULL, NULL),
    ('doseUnitOfMeasure', 'coded', NULL, 'C48542', 'NCI'), ('route', 'coded', 'by mouth', 'PO', 'SNOMED'), ('siteOfAdministration', 'derived', 'mouth', NULL, NULL), ('administrationTiming', 'derived', 'daily', NULL, NULL), ('duration', 'coded', 'week', '7', 'UNKNOWN'), ('vehicle', 'absent', NULL, NULL, NULL),
    ('indication', 'derived', 'pain', NULL, NULL), ('maximumDoseRestriction', 'absent', NULL, NULL, NULL)) AS v(component, provenance, text, code, system) WHERE ({_MED}) AND shape IN (2, 3, 4)""",
)
def s49_components(spark, sf_dir):
    """All ten components of structured directions, a row each."""
    one = lambda n: F.struct(F.lit(n).alias("component"), *[F.col(f"medication.sig.{n}.{c}").alias(a) for c, a in (("provenance", "provenance"), ("text", "text"), ("code.value", "code"), ("code.system", "system"))])
    found = scripts(spark, sf_dir, "medication").where("medication.sig IS NOT NULL")
    return found.select("k", F.inline(F.array(*map(one, codes.SIG_COMPONENTS))))


_TX = f"'/Message/Body/' || {_KINDS}"
_MEDPATH = f"({_TX} || CASE WHEN sort = 4 THEN '/Response/ApprovedWithChanges' ELSE '' END || '/MedicationPrescribed')"


@query(
    "s20_script_warnings",
    f"""SELECT k, code, path FROM (SELECT k, 'VERSION_ABSENT' AS code, '/Message' AS path FROM o WHERE sort < 13 AND v = 3 UNION ALL SELECT k, 'UNSUPPORTED_VERSION_TOLERATED', '/Message' FROM o WHERE sort < 13 AND v = 2
    UNION ALL SELECT k, 'STRENGTH_CODED_AND_EXPLICIT', {_MEDPATH} FROM o WHERE ({_MED}) AND shape = 1 UNION ALL SELECT k, 'SIG_STRUCTURED_LOSSY', {_MEDPATH} || '/Sig' FROM o WHERE ({_MED}) AND shape = 2
    UNION ALL SELECT k, 'SIG_AMBIGUOUS_DOSE', {_MEDPATH} || '/Sig/Dose' FROM o WHERE ({_MED}) AND shape = 3 UNION ALL SELECT k, 'LIFECYCLE_AMBIGUOUS_OUTCOME', {_TX} || '/Response' FROM o WHERE sort = 4 AND shape = 1
    UNION ALL SELECT k, 'LIFECYCLE_OUTCOME_UNRECOGNIZED', {_TX} || '/Response' FROM o WHERE sort = 4 AND shape = 4 UNION ALL SELECT k, 'RESPONSE_AMBIGUOUS_DISPOSITION', '/Message/Body' FROM o WHERE sort = 8
    UNION ALL SELECT k, 'MISSING_REQUIRED_ELEMENT', {_TX} FROM o WHERE sort = 9 UNION ALL SELECT k, 'UNSUPPORTED_TRANSACTION', '/Message/Body' FROM o WHERE sort IN (10, 11))""",
)
def s20(spark, sf_dir):
    return scripts(spark, sf_dir, "warnings").select("k", F.explode("warnings").alias("w")).select("k", F.col("w.code"), F.col("w.path"))


@query("s30_nodes", "SELECT name, n FROM (SELECT 'Message' AS name, count(*) AS n FROM o WHERE sort < 13 UNION ALL SELECT 'Header', count(*) FROM o WHERE sort < 13 UNION ALL SELECT 'RelatesToMessageID', count(*) FROM o WHERE sort >= 4 AND sort < 10 UNION ALL SELECT 'RxFill', count(*) FROM o WHERE sort = 10) WHERE n > 0")
def s30(spark, sf_dir):
    nodes = P.script_nodes(script_messages(spark, sf_dir), "k")
    return nodes.where(F.col("name").isin("Message", "Header", "RelatesToMessageID", "RxFill")).groupBy("name").agg(F.count("*").alias("n"))


@query(
    "s31_first_descendants",
    f"""SELECT k, ancestor, descendant, text FROM (SELECT k, 'Patient' AS ancestor, 'Name' AS descendant, '' AS text FROM o WHERE sort IN (0, 1, 2, 3) UNION ALL SELECT k, 'Prescriber', 'LastName', 'Doc' FROM o WHERE sort IN (0, 1, 2, 3) UNION ALL SELECT k, 'Message', 'LastName', 'L' || ck FROM o WHERE sort IN (0, 1, 2, 3)
    UNION ALL SELECT k, 'Body', 'DrugDescription', 'Drug ' || (k % 100) FROM o WHERE {_MED} UNION ALL SELECT k, 'Sig', 'SigText', CASE shape WHEN 2 THEN 'take one' WHEN 3 THEN 'take two' ELSE 'as told' END FROM o WHERE ({_MED}) AND shape IN (2, 3, 4)
    UNION ALL SELECT k, 'Header', 'Header', '' FROM o WHERE sort < 13 UNION ALL SELECT k, 'Body', 'Code', CASE sort WHEN 7 THEN '000' WHEN 8 THEN '600' WHEN 9 THEN ' ' ELSE CASE shape WHEN 1 THEN '77' ELSE 'C48542' END END FROM o WHERE sort IN (7, 8, 9) OR (({_MED}) AND shape IN (1, 2)))""",
)
def s31(spark, sf_dir):
    """For pairs of names, the first element of the one in each element of the other, over all messages' node rows."""
    pairs = spark.createDataFrame([("Patient", "Name"), ("Prescriber", "LastName"), ("Message", "LastName"), ("Body", "DrugDescription"), ("Sig", "SigText"), ("Header", "Header"), ("Body", "Code"), ("Code", "Message")], "ancestor string, descendant string")
    nodes = P.script_nodes(script_messages(spark, sf_dir), "k")
    return L.first_descendants(nodes, pairs, "k", ["text"]).select("k", "ancestor", "descendant", "text")


@query("s37_correlation", "SELECT a.k AS response_id, b.k AS request_id FROM o a JOIN o b ON b.k = a.k - 3 WHERE a.sort IN (4, 5, 6) AND b.sort IN (1, 2, 3)")
def s37(spark, sf_dir):
    found = scripts(spark, sf_dir, "kind", "header", "correlatesTo")
    return P.correlate(P.of_kind(found, *codes.LIFECYCLE_RESPONSES), P.of_kind(found, *codes.LIFECYCLE_REQUESTS), "k")


@query(
    "s37_unanswered",
    """SELECT b.k AS request_id, b.placed AS asked, CASE WHEN a.placed BETWEEN b.placed AND b.placed + 400 THEN 'answered' ELSE 'unanswered' END AS outcome, CASE WHEN a.placed BETWEEN b.placed AND b.placed + 400 THEN a.placed END AS first_answer,
    CAST(CASE WHEN a.placed BETWEEN b.placed AND b.placed + 400 THEN 1 ELSE 0 END AS BIGINT) AS n_answers, CAST(CASE WHEN a.placed < b.placed THEN 1 ELSE 0 END AS BIGINT) AS n_early FROM o b LEFT JOIN o a ON a.k = b.k + 3 AND a.sort IN (4, 5, 6) WHERE b.sort IN (1, 2, 3)""",
)
def s37_unanswered(spark, sf_dir):
    """Every request by whether it was answered within 400 days; early and late answers don't count."""
    found = P.parse_scripts(script_messages(spark, sf_dir).select("k", "placed", "payload"), only=("kind", "header", "correlatesTo"))
    told = answers.answered_requests(P.of_kind(found, *codes.LIFECYCLE_REQUESTS), P.of_kind(found, *codes.LIFECYCLE_RESPONSES), "k", "placed", "400 days")
    return told.select("request_id", F.to_date("request_time").alias("asked"), "outcome", F.to_date("first_answer").alias("first_answer"), "n_answers", "n_early")


@query("w06_canonical_xml", f"SELECT {_KINDS} AS kind, count(*) AS n, count(*) AS n_same_kind, CAST(sum(CASE WHEN sort IN (0, 1, 2, 3) THEN 0 ELSE 1 END) AS BIGINT) AS n_stable FROM o WHERE sort <> 13 GROUP BY 1")
def w06(spark, sf_dir):
    """Emitted XML reads as the same kind, and emits the same again; but for entities, which are escaped once more each time."""
    once = P.with_xml(scripts(spark, sf_dir).where("fatal IS NULL")).select(F.col("kind").alias("was"), F.col("xml").alias("payload"), F.col("xml").alias("first"))
    again = P.with_xml(P.parse_scripts(once))
    return again.groupBy(F.col("was").alias("kind")).agg(F.count("*").alias("n"), F.sum((F.col("kind") == F.col("was")).cast("long")).alias("n_same_kind"), F.sum((F.col("first") == F.col("xml")).cast("long")).alias("n_stable"))


_N = "' || chr(10) || '"


@query(
    "w06_canonical_text",
    f"""SELECT k, '<Message' || CASE v WHEN 0 THEN ' version="2017071"' WHEN 1 THEN ' version="2023011"' WHEN 2 THEN ' version="2099001"' WHEN 4 THEN ' version="2017071"' ELSE '' END || '>{_N}  <Header>{_N}    <To>PH' || ck || '</To>{_N}    <From>DR ' || (k % 10) || '</From>{_N}    <MessageID>M' || k || '</MessageID>' ||
    CASE WHEN sort >= 4 AND sort < 10 THEN '{_N}    <RelatesToMessageID>M' || (k - 3) || '</RelatesToMessageID>' ELSE '' END || CASE WHEN k % 3 = 0 THEN '{_N}    <SentTime>2024-01-02T03:04:05Z</SentTime>{_N}    <PrescriberOrderNumber>O' || k || '</PrescriberOrderNumber>' ELSE '' END ||
    '{_N}  </Header>{_N}  <Body>{_N}    ' || CASE sort WHEN 7 THEN '<Status>{_N}      <Code>000</Code>{_N}      <Description>fine</Description>{_N}    </Status>' WHEN 8 THEN '<Error>{_N}      <Code>600</Code>{_N}      <DescriptionCode>10</DescriptionCode>{_N}    </Error>' WHEN 9 THEN '<Verify/>'
    WHEN 10 THEN '<RxFill/>' WHEN 11 THEN '<UnsupportedTransaction/>' ELSE '<CancelRx>{_N}      <Patient>{_N}        <Name>{_N}          <LastName>L' || ck || '</LastName>{_N}          <FirstName>F</FirstName>' || CASE WHEN ck % 3 = 0 THEN '{_N}          <MiddleName>Q</MiddleName>' ELSE '' END ||
    '{_N}        </Name>{_N}        <Gender>' || CASE WHEN ck % 2 = 0 THEN 'M' ELSE 'F' END || '</Gender>{_N}        <DateOfBirth>' || CASE WHEN k % 2 = 0 THEN '1980-01-01' ELSE '1980-01-02' END || '</DateOfBirth>{_N}      </Patient>{_N}      <Pharmacy>{_N}        <BusinessName>Store &amp;amp; Co</BusinessName>{_N}        <Identification>{_N}          <@>' ||
    (1000000 + ck) || '</@>{_N}        </Identification>{_N}      </Pharmacy>{_N}      <Prescriber>{_N}        <Name>{_N}          <LastName>Doc</LastName>{_N}        </Name>{_N}        <Identification>{_N}          <NPI>' || k || '</NPI>' || CASE WHEN k % 2 = 0 THEN '{_N}          <DEANumber>AB' || k || '</DEANumber>' ELSE '' END ||
    '{_N}        </Identification>{_N}      </Prescriber>{_N}    </CancelRx>' END || '{_N}  </Body>{_N}</Message>' AS xml FROM o WHERE sort IN (3, 7, 8, 9, 10, 11)""".replace("@>", codes.IDENTIFICATIONS["pharmacyNumber"] + ">"),
)
def w06_text(spark, sf_dir):
    """Canonical XML, byte for byte."""
    found = P.of_kind(scripts(spark, sf_dir), "CancelRx", *codes.RESPONSE_KINDS, "unsupported")
    return P.with_xml(found).select("k", "xml")


# The lines of written prescriptions and answers: depth, text with SQL in braces, and when the line is there.
_DRUG, _ASKS, _ANSWERS = "(sort IN (0, 1, 2, 12) OR sort = 4 AND shape = 2)", "sort IN (0, 1, 2)", "sort IN (4, 5, 6)"
_CODED_SIG = f"{_DRUG} AND shape = 2"
_OUTCOME = "CASE sort WHEN 4 THEN CASE shape WHEN 0 THEN 'Approved' WHEN 1 THEN 'Denied' WHEN 2 THEN 'ApprovedWithChanges' WHEN 3 THEN 'Denied' WHEN 5 THEN 'DenyNewToFollow' END WHEN 5 THEN CASE WHEN shape % 2 = 0 THEN 'Validated' ELSE 'Replace' END ELSE 'Denied' END"
_REASONED = "(sort = 4 AND shape IN (1, 3) OR sort = 5 AND shape % 2 = 0 OR sort = 6)"
_SCRIPT_LINES = [
    (0, """<Message{CASE v WHEN 2 THEN ' version="2099001"' WHEN 1 THEN ' version="2023011"' WHEN 3 THEN '' ELSE ' version="2017071"' END}>""", None),
    (1, "<Header>", None), (2, "<To>PH{ck}</To>", None), (2, "<From>DR {k % 10}</From>", None), (2, "<MessageID>M{k}</MessageID>", None), (2, "<RelatesToMessageID>M{k - 3}</RelatesToMessageID>", _ANSWERS),
    (2, "<SentTime>2024-01-02T03:04:05Z</SentTime>", "k % 3 = 0"), (2, "<PrescriberOrderNumber>O{k}</PrescriberOrderNumber>", "k % 3 = 0"), (1, "</Header>", None), (1, "<Body>", None), (2, "<{kind}>", None),
    (3, "<RequestReferenceNumber>R{CASE sort WHEN 1 THEN k ELSE k - 3 END}</RequestReferenceNumber>", "sort IN (1, 4)"), (3, "<Response/>", "sort = 4 AND shape = 4"), (3, "<Response>", f"{_ANSWERS} AND NOT (sort = 4 AND shape = 4)"),
    (4, "<{outcome}/>", f"outcome IS NOT NULL AND {_ANSWERS} AND NOT {_REASONED}"), (4, "<{outcome}>", _REASONED), (5, "<ReasonCode>AA</ReasonCode>", "sort = 4 AND shape = 3"), (5, "<DenialReason>no</DenialReason>", "sort = 4 AND shape = 1"),
    (5, "<DenialReason>late</DenialReason>", "sort = 6"), (5, "<Note>ok</Note>", "sort = 5 AND shape % 2 = 0"), (4, "</{outcome}>", _REASONED), (3, "</Response>", f"{_ANSWERS} AND NOT (sort = 4 AND shape = 4)"),
    (3, "<Patient>", _ASKS), (4, "<Name>", _ASKS), (5, "<LastName>L{ck}</LastName>", _ASKS), (5, "<FirstName>F</FirstName>", _ASKS), (5, "<MiddleName>Q</MiddleName>", f"{_ASKS} AND ck % 3 = 0"), (4, "</Name>", _ASKS),
    (4, "<Gender>{CASE WHEN ck % 2 = 0 THEN 'M' ELSE 'F' END}</Gender>", _ASKS), (4, "<DateOfBirth>1980-01-0{1 + k % 2}</DateOfBirth>", _ASKS), (3, "</Patient>", _ASKS),
    (3, "<Pharmacy>", _ASKS), (4, "<BusinessName>Store &amp;amp; Co</BusinessName>", _ASKS), (4, "<Identification>", _ASKS), (5, f"<{codes.IDENTIFICATIONS['pharmacyNumber']}>{{1000000 + ck}}</{codes.IDENTIFICATIONS['pharmacyNumber']}>", _ASKS), (4, "</Identification>", _ASKS), (3, "</Pharmacy>", _ASKS),
    (3, "<Prescriber>", _ASKS), (4, "<Name>", _ASKS), (5, "<LastName>Doc</LastName>", _ASKS), (4, "</Name>", _ASKS), (4, "<Identification>", _ASKS), (5, "<NPI>{k}</NPI>", _ASKS), (5, "<DEANumber>AB{k}</DEANumber>", f"{_ASKS} AND k % 2 = 0"), (4, "</Identification>", _ASKS), (3, "</Prescriber>", _ASKS),
    (3, "<MedicationPrescribed>", _DRUG), (4, "<DrugDescription>Drug {k % 100}</DrugDescription>", _DRUG), (4, "<DrugCoded>", f"{_DRUG} AND shape < 2"), (5, '<ProductCode Qualifier="ND">{total}</ProductCode>', f"{_DRUG} AND shape = 0"),
    *[(d, t, f"{_DRUG} AND shape = 1") for d, t in ((5, "<DrugDBCode>"), (6, "<Code>77</Code>"), (6, "<Qualifier>RxCUI</Qualifier>"), (5, "</DrugDBCode>"))], (4, "</DrugCoded>", f"{_DRUG} AND shape < 2"),
    *[(d, t, f"{_DRUG} AND shape = 1") for d, t in ((4, "<Strength>"), (5, "<StrengthValue>5</StrengthValue>"), (5, "<StrengthForm>C42</StrengthForm>"), (5, "<StrengthUnitOfMeasure>mg</StrengthUnitOfMeasure>"), (4, "</Strength>"))],
    (4, "<Quantity>", _DRUG), (5, "<Value>{total}{CASE shape WHEN 3 THEN '.5' WHEN 4 THEN '.' ELSE '' END}</Value>", _DRUG), (4, "</Quantity>", _DRUG), (4, "<DaysSupply>{CASE WHEN k % 2 = 0 THEN '30' ELSE '3x' END}</DaysSupply>", _DRUG),
    (4, "<Substitutions>0</Substitutions>", f"{_DRUG} AND k % 2 = 0"), (4, "<NumberOfRefills>{CASE shape WHEN 5 THEN 3 ELSE 1 END}</NumberOfRefills>", _DRUG), (4, "<WrittenDate>2024-01-0{2 + k % 2}</WrittenDate>", _DRUG), (4, "<Directions>none</Directions>", f"{_DRUG} AND shape IN (0, 1, 5)"),
    (4, "<Sig>", f"{_DRUG} AND shape IN (2, 3, 4)"), (5, "<SigText>{CASE shape WHEN 2 THEN 'take one' WHEN 3 THEN 'take two' ELSE 'as told' END}</SigText>", f"{_DRUG} AND shape IN (2, 3, 4)"),
    *[
        (d, t, _CODED_SIG)
        for d, t in (
            (5, "<DoseDeliveryMethod>Take</DoseDeliveryMethod>"), (5, "<DoseQuantity>1</DoseQuantity>"), (5, "<DoseUnitOfMeasure>"), (6, "<Code>C48542</Code>"), (6, "<Qualifier>NCI</Qualifier>"), (5, "</DoseUnitOfMeasure>"),
            (5, "<RouteOfAdministration>"), (6, "<Code>PO</Code>"), (6, "<Qualifier>SNOMED</Qualifier>"), (6, "<Text>by mouth</Text>"), (5, "</RouteOfAdministration>"), (5, "<SiteOfAdministration>mouth</SiteOfAdministration>"),
            (5, "<AdministrationTiming>daily</AdministrationTiming>"), (5, "<Duration>"), (6, "<Code>7</Code>"), (6, "<Qualifier>none</Qualifier>"), (6, "<Text>week</Text>"), (5, "</Duration>"), (5, "<Indication>pain</Indication>"),
        )
    ],
    (4, "</Sig>", f"{_DRUG} AND shape IN (2, 3, 4)"), (4, "<SigText>plain</SigText>", f"{_DRUG} AND shape = 5"), (4, "<Note>take care</Note>", f"{_DRUG} AND k % 2 = 0"), (3, "</MedicationPrescribed>", _DRUG),
    (2, "</{kind}>", None), (1, "</Body>", None), (0, "</Message>", None),
]


def _sql_line(depth: int, text: str, when: str | None) -> str:
    whole = "'" + "  " * depth + text.replace("{", "' || (").replace("}", ") || '") + "'"
    return whole if when is None else f"CASE WHEN {when} THEN {whole} END"


@query(
    "w07_prescription_text",
    f"SELECT k, kind, concat_ws(chr(10), {', '.join(_sql_line(*line) for line in _SCRIPT_LINES)}) AS xml FROM (SELECT *, {_KINDS} AS kind, {_OUTCOME} AS outcome FROM o WHERE sort IN (0, 1, 2, 4, 5, 6, 12))",
)
def w07_text(spark, sf_dir):
    """Canonical XML of prescriptions (parties, medication, directions) and of lifecycle answers, byte for byte."""
    asked = [k for k in codes.LIFECYCLE_REQUESTS if k != "CancelRx"]
    return P.with_xml(P.of_kind(scripts(spark, sf_dir), "NewRx", *asked, *codes.LIFECYCLE_RESPONSES)).select("k", "kind", "xml")


@query(
    "s02_sql_nodes",
    """SELECT depth, name, count(*) AS n FROM (SELECT 0 AS depth, 'Message' AS name FROM o WHERE sort < 13 UNION ALL SELECT 1, 'Header' FROM o WHERE sort < 13 UNION ALL SELECT 1, 'Body' FROM o WHERE sort < 13 UNION ALL SELECT 2, 'To' FROM o WHERE sort < 13
    UNION ALL SELECT 2, 'RelatesToMessageID' FROM o WHERE sort >= 4 AND sort < 10 UNION ALL SELECT 3, 'MedicationPrescribed' FROM o WHERE sort IN (0, 1, 2, 12) UNION ALL SELECT 5, 'MedicationPrescribed' FROM o WHERE sort = 4 AND shape = 2) GROUP BY ALL""",
)
def s02_sql(spark, sf_dir):
    """Nodes by depth and name through the SQL table function; texts that can't be read have none."""
    xml.register(spark)
    wanted = "'Message', 'Header', 'Body', 'To', 'RelatesToMessageID', 'MedicationPrescribed'"
    return spark.sql(f"SELECT n.depth, n.name, count(*) AS n FROM {{m}} AS m, LATERAL script_nodes(m.payload) AS n WHERE n.name IN ({wanted}) GROUP BY n.depth, n.name", m=script_messages(spark, sf_dir).select("payload"))


@query(
    "s01_gate",
    """SELECT fatal, path, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(html, '')) = '' THEN 'EMPTY_INPUT' WHEN page_id % 3 <> 1 AND regexp_matches(html, '(?i)<!(?:DOCTYPE|ENTITY)\\b') THEN 'NOT_XML' WHEN page_id % 3 = 2 THEN 'NOT_XML' ELSE 'NO_MESSAGE_ROOT' END AS fatal,
    CASE WHEN page_id % 3 = 1 AND trim(coalesce(html, '')) <> '' THEN '/' END AS path FROM pages) GROUP BY ALL""",
)
def s01(spark, sf_dir):
    """Every page: as it is (refused for its document type), without it (read, but another root), and broken off inside a tag."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    plain = F.regexp_replace("html", "(?i)<!DOCTYPE[^>]*>", "")
    payload = F.when(F.col("page_id") % 3 == 1, plain).when((F.col("page_id") % 3 == 2) & (F.trim("html") != ""), F.concat(plain, F.lit("<p class='"))).otherwise(F.col("html"))
    return P.parse_scripts(pages.select(payload.alias("payload")), only=()).groupBy(F.col("fatal.code").alias("fatal"), F.col("fatal.path").alias("path")).agg(F.count("*").alias("n"))


@query(
    "w10_build_script",
    """SELECT b, CASE b WHEN 0 THEN 'MISSING_MEDICATION' WHEN 1 THEN 'INVALID_CHARACTER' WHEN 3 THEN 'MISSING_RESPONSE_CODE' END AS code, CASE WHEN b IN (0, 1, 3) THEN 0 ELSE count(*) END AS n_read, count(*) AS n FROM (SELECT CAST(k % 5 AS INT) AS b FROM o) GROUP BY b""",
)
def w10(spark, sf_dir):
    orders = script_messages(spark, sf_dir).selectExpr("CAST(k % 5 AS INT) AS b", "k")
    cast = lambda c, name: c.cast(P._MODEL[name]).alias(name)  # noqa: E731, SLF001
    none = lambda name: cast(F.lit(None), name)
    head = F.from_json(F.concat(F.lit('{"version":"2017071","messageId":"'), F.col("k"), F.lit('"}')), P._MODEL["header"]).alias("header")  # noqa: SLF001
    drug = F.when(F.col("b") == 0, F.lit(" ")).when(F.col("b") == 1, F.lit("a\x01")).otherwise(F.concat(F.lit("D<"), F.col("k")))
    names = [f.name for f in spark.createDataFrame([], "m " + P._MODEL["medication"]).schema["m"].dataType.fields]  # noqa: SLF001
    medication = F.struct(*[(drug if n == "description" else F.lit(None)).alias(n) for n in names])
    rx = P.build_new_rx(orders.where("b < 3").select("b", "k", head, none("patient"), none("pharmacy"), none("prescriber"), cast(medication, "medication")))
    answer = F.struct(F.lit("Status").alias("kind"), F.when(F.col("b") == 3, F.lit("")).otherwise(F.lit("000")).alias("code"), F.lit(None).alias("descriptionCode"), F.lit("a&b").alias("description"))
    status = P.build_response(orders.where("b >= 3").select("b", "k", head, cast(answer, "response")))
    columns = ["b", F.col("buildError.code").alias("code"), F.col("kind").alias("was"), F.col("xml").alias("payload")]
    emitted = P.with_xml(rx).select(*columns).unionByName(P.with_xml(status).select(*columns))
    read = P.parse_scripts(emitted)
    same = F.coalesce((F.col("kind") == F.col("was")).cast("long"), F.lit(0))
    return read.groupBy("b", "code").agg(F.sum(same).alias("n_read"), F.count("*").alias("n"))


# -- governance

_ALLOW = [("email-domain", "example.com"), ("id", "SYNTH"), ("dob", "19970101"), ("name", "Testcase"), ("name", "Probe")]


@query(
    "g08_common_shapes",
    r"""SELECT doc_id, category, value FROM (SELECT doc_id, 'email' AS category, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS value FROM documents
    UNION ALL SELECT doc_id, 'ssn', unnest(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) FROM documents) WHERE category = 'ssn' OR lower(regexp_extract(value, '@(.*)$', 1)) <> 'example.com'""",
)
def g08(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    allow = scan.allow_rows(spark.createDataFrame(_ALLOW, "kind string, value string"))
    hits = scan.common_shapes(docs.select(F.col("doc_id").alias("path"), "text"), allow)
    return hits.select(F.col("path").cast("long").alias("doc_id"), "category", "value")


@query(
    "g10_report",
    r"""SELECT doc_id, n_hits, categories, (SELECT count(*) FROM documents) AS n_texts FROM (SELECT doc_id, count(*) AS n_hits, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM (
    SELECT doc_id, 'email' AS category, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS value FROM documents UNION ALL SELECT doc_id, 'ssn', unnest(regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) FROM documents)
    WHERE category = 'ssn' OR lower(regexp_extract(value, '@(.*)$', 1)) <> 'example.com' GROUP BY doc_id)""",
)
def g10(spark, sf_dir):
    """Hits grouped by text, with the number of texts looked at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    allow = scan.allow_rows(spark.createDataFrame(_ALLOW, "kind string, value string"))
    return scan.report(scan.common_shapes(docs, allow), docs).select(F.col("path").cast("long").alias("doc_id"), "n_hits", "categories", "n_texts")


_REASON = _sql_map("category", scan.REASONS)


@query(
    "g04_scan_claims",
    f"""SELECT location, category, value, {_REASON} AS reason, count(*) AS n FROM (SELECT 'C4' AS location, 'dob' AS category, '' AS value FROM f WHERE ship <> '19970101' UNION ALL SELECT 'CA', 'name', given FROM f WHERE pk % 9 = 0 AND given = 'Ann' UNION ALL SELECT 'CB', 'name', 'Jo' FROM f WHERE pk % 9 = 0
    UNION ALL SELECT 'CB', 'name', family FROM f WHERE pk % 9 = 0 AND family = 'Real' UNION ALL SELECT 'CM', 'address', street FROM f WHERE pk % 9 = 0 AND street <> 'Box 9' UNION ALL SELECT 'CQ', 'phone', phone FROM f WHERE pk % 9 = 0 AND phone LIKE '(%' UNION ALL SELECT 'CY', 'id', patient FROM f WHERE pk % 9 = 0 AND patient = '123456') GROUP BY 1, 2, 3""",
)
def g04(spark, sf_dir):
    texts = claim_messages(spark, sf_dir, "request").select(F.concat_ws("-", "k", "ln").alias("path"), F.col("request").alias("text"))
    allow = scan.allow_rows(spark.createDataFrame(_ALLOW, "kind string, value string"))
    value = F.when(F.col("category") == "dob", "").otherwise(F.col("value"))
    return scan.scan_texts(texts, allow).groupBy("location", "category", value.alias("value"), "reason").agg(F.count("*").alias("n"))


@query(
    "g03_scan_scripts",
    f"""SELECT location, category, value, {_REASON} AS reason, n FROM (SELECT '<LastName>' AS location, 'name' AS category, 'Doc' AS value, count(*) AS n FROM o WHERE sort IN (0, 1, 2, 3, 13) UNION ALL SELECT '<DateOfBirth>', 'dob', '19800101', count(*) FROM o WHERE sort IN (0, 1, 2, 3, 13) AND k % 2 = 0
    UNION ALL SELECT '<DateOfBirth>', 'dob', '19800102', count(*) FROM o WHERE sort IN (0, 1, 2, 3, 13) AND k % 2 = 1) WHERE n > 0""",
)
def g03(spark, sf_dir):
    texts = script_messages(spark, sf_dir).select(F.col("k").cast("string").alias("path"), F.col("payload").alias("text"))
    allow = scan.allow_rows(spark.createDataFrame(_ALLOW, "kind string, value string"))
    return scan.scan_texts(texts, allow).groupBy("location", "category", "value", "reason").agg(F.count("*").alias("n"))


_LEAVES = """SELECT CAST(c_custkey AS STRING) AS path, concat('<Message><Patient><Name><LastName>', c_mktsegment, '</LastName><FirstName>', CASE c_custkey % 4 WHEN 0 THEN 'Dr X Ana' WHEN 1 THEN 'Probe' WHEN 2 THEN '' ELSE 'Ana-Bea' END, '</FirstName></Name><DateOfBirth>',
    CASE c_custkey % 6 WHEN 0 THEN '1980-01-02' WHEN 1 THEN '1997-01-01' WHEN 2 THEN 'Jan 5, 80' WHEN 3 THEN '198013' WHEN 4 THEN 'unknown' ELSE '<Date> 1975 </Date>' END, '</DateOfBirth><SSN>', CASE c_custkey % 3 WHEN 0 THEN '123-45-6789' WHEN 1 THEN CAST(900000 + c_custkey AS STRING) ELSE '12345' END,
    '</SSN><ElectronicMail>u', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '@Example.com' ELSE '@mail.org' END, '</ElectronicMail><Communication><PhoneNumber>', CASE c_custkey % 5 WHEN 0 THEN '(212) 867-5309' WHEN 1 THEN '(212) 555-0100' WHEN 2 THEN '867-5309' WHEN 3 THEN '+1 212 867 53 09' ELSE '' END, '</PhoneNumber>',
    CASE c_custkey % 7 WHEN 0 THEN '<CommunicationNumber><Number>2128675309</Number></CommunicationNumber>' WHEN 1 THEN '<Number>2128675309</Number>' ELSE '' END, '</Communication><m:MemberID>', 7000000 + c_custkey, '<Address><AddressLine1>', CASE WHEN c_custkey % 2 = 0 THEN concat(c_custkey, ' Main &amp; 1st St') ELSE 'PO Box 7' END, '</AddressLine1></Address></Patient></Message>') AS text
FROM {customer}"""


@query(
    "g03_scan_leaves",
    f"""SELECT CAST(path AS VARCHAR) AS path, location, category, value, {_sql_map('why', scan.REASONS)} AS reason FROM (SELECT c_custkey AS path, '<LastName>' AS location, 'name' AS category, c_mktsegment AS value, 'name' AS why FROM customer
    UNION ALL SELECT c_custkey, '<FirstName>', 'name', 'Ana', 'name' FROM customer WHERE c_custkey % 4 IN (0, 3) UNION ALL SELECT c_custkey, '<FirstName>', 'name', 'Bea', 'name' FROM customer WHERE c_custkey % 4 = 3
    UNION ALL SELECT c_custkey, '<DateOfBirth>', 'dob', CASE c_custkey % 6 WHEN 0 THEN '19800102' WHEN 2 THEN 'Jan 5, 80' WHEN 3 THEN '198013' ELSE '1975' END, CASE WHEN c_custkey % 6 IN (2, 3) THEN 'odd-dob' ELSE 'dob' END FROM customer WHERE c_custkey % 6 IN (0, 2, 3, 5)
    UNION ALL SELECT c_custkey, '(ssn)', 'ssn', '123-45-6789', 'ssn' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, '<SSN>', 'id', CAST(900000 + c_custkey AS VARCHAR), 'id' FROM customer WHERE c_custkey % 3 = 1 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT c_custkey, '(email)', 'email', 'u' || c_custkey || '@mail.org', 'email' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, '<PhoneNumber>', 'phone', CASE c_custkey % 5 WHEN 0 THEN '(212) 867-5309' ELSE '+1 212 867 53 09' END, 'phone' FROM customer WHERE c_custkey % 5 IN (0, 3)
    UNION ALL SELECT c_custkey, '<Number>', 'phone', '2128675309', 'phone' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, '<MemberID>', 'id', CAST(7000000 + c_custkey AS VARCHAR), 'id' FROM customer
    UNION ALL SELECT c_custkey, '<AddressLine1>', 'address', c_custkey || ' Main & 1st St', 'address' FROM customer WHERE c_custkey % 2 = 0)""",
)
def g03_leaves(spark, sf_dir):
    """Ids, phones, streets, names and dates (also those that can't be read) of prescriptions for each customer, some elements
    never closed; the suppliers' numbers are on the allow-list."""
    texts = spark.sql(_LEAVES, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    listed = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("id").alias("kind"), (F.lit(900000) + F.col("s_suppkey")).cast("string").alias("value"))
    allow = scan.allow_rows(spark.createDataFrame(_ALLOW, "kind string, value string").unionByName(listed))
    return scan.scan_texts(texts, allow).select("path", "location", "category", "value", "reason")
