"""Claim transmissions: a fixed-width header, then segments and fields between control characters.

A message is cut into its tokens over whole Arrow batches (``sources.tokens``); everything else is a column expression, so a
batch table and a stream run the same plan, with no shuffle. Lookups are by the place of an id in an array of ids, which Spark
compiles, and not by a lambda over the fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave import codes
from rxweave.codes import FS, GS, RS
from rxweave.functions.scalars import BLANK, MODES, check_mode, decimal_value, known, let, lookup, money, prefix_int, quantity, settled, trim_blank
from rxweave.sources.tokens import SEGMENT, cut_messages

WARNING = "struct<code:string,message:string,byteOffset:int,fieldId:string>"


# -- warnings and positions


def warning(code: str, offset: Column, field: str | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(codes.CLAIM_WARNINGS[code]).alias("message"), offset.cast("int").alias("byteOffset"), F.lit(field).cast("string").alias("fieldId")
    ).cast(WARNING)


def _none() -> Column:
    return F.array().cast(f"array<{WARNING}>")


def _if(condition: Column, *found: Column) -> Column:
    return F.when(condition, F.array(*found)).otherwise(_none())


# -- headers and gates


def _header(text: Column, layout: Sequence[tuple[str, int]]) -> Column:
    at, columns = 1, []
    for name, width in layout:
        columns.append(trim_blank(F.substring(text, at, width)).alias(name))
        at += width
    return F.struct(*columns)


def decode_request_header(text: Column) -> Column:
    return _header(text, codes.REQUEST_HEADER)


def decode_response_header(region: Column) -> Column:
    return _header(region, codes.RESPONSE_HEADER)


def is_response(text: Column) -> Column:
    """The request's shape is tested first: its version stands at the seventh character."""
    return (F.substring(text, 7, 2) != "D0") & (F.substring(text, 1, 2) == "D0")


def version_of(text: Column) -> Column:
    return F.when(F.substring(text, 7, 2) == "D0", "d0").when((F.substring(text, 9, 2) == "F6") | (F.substring(text, 7, 2) == "F6"), "f6").otherwise("unsupported")


def has_framing(body: Column) -> Column:
    return body.rlike("[\\x1C-\\x1E]")


def _segment_warnings(segment: Column) -> Column:
    """In the order in which a reader meets them: fields, then the segment's id."""
    at, unnamed = segment["byteOffset"], segment["segmentId"] == ""
    starts = F.coalesce(F.get(segment["fields"], F.lit(0))["id"] == "AM", F.lit(False))
    short = F.transform(F.filter(segment["fields"], lambda f: f["id"] == ""), lambda f: warning("MALFORMED_FIELD", f["byteOffset"]))
    return F.concat(
        short, _if(unnamed & ~starts, warning("MISSING_SEGMENT_ID", at)), _if(unnamed & starts, warning("MALFORMED_SEGMENT_ID", at, "AM")),
        _if(~unnamed & segment["name"].isNull(), warning("UNKNOWN_SEGMENT", at, "AM")),
    )


# -- lookups: the first segment of an id, and the first or all values of a field


def find_segment(segments: Column, segment_id: str) -> Column:
    return F.get(segments, F.array_position(segments["segmentId"], segment_id).cast("int") - 1)


def field_value(segment: Column, field_id: str) -> Column:
    return F.get(segment["fields"], F.array_position(segment["fields"]["id"], field_id).cast("int") - 1)["value"]


def field_values(segment: Column, field_id: str) -> Column:
    found = F.transform(F.filter(segment["fields"], lambda f: f["id"] == field_id), lambda f: f["value"])
    return F.coalesce(found, F.array().cast("array<string>"))


# -- reading


RESULTS = ("kind", "header", "responseHeader", "segments", "transactionCount", "warnings")


def parse_claims(
    raw: DataFrame, payload: str = "payload", *, encoding: str = "ISO-8859-1", mode: str = "PERMISSIVE", keep: Sequence[str] | None = None, only: Sequence[str] | None = None, names: bool = True
) -> DataFrame:
    """Decode each message (binary or string ``payload``): the ``keep`` columns (default: all others) and kind, header,
    responseHeader, segments, transactionCount, warnings, fatal.

    ``fatal`` (code, message, byteOffset, fieldId) is set where a message can't be read, and the other results are then null.
    Modes: PERMISSIVE keeps such rows, DROPMALFORMED leaves them out, FAILFAST raises an error. Null payloads count as empty.
    ``only`` names the results that are wanted (``fatal`` always is), and no others are worked out. Without ``names`` those of
    the fields in ``segments`` are null: no view reads them, and much fewer bytes come back from the cutting.
    """
    check_mode(mode)
    if only is not None and (unknown := set(only) - {*RESULTS, "fatal"}):
        raise ValueError(f"no such results: {sorted(unknown)}")
    results = [r for r in RESULTS if only is None or r in only]
    kept = [c for c in raw.columns if c != payload] if keep is None else list(keep)
    is_binary = raw.schema[payload].dataType.typeName() == "binary"
    text = F.coalesce(F.decode(F.col(payload), encoding) if is_binary else F.col(payload), F.lit(""))
    rest = F.struct(F.lit(0).alias("_"), *kept).alias("_rest")  # so that their names don't meet ours
    step = raw.select(rest, text.alias("_t"))
    t = F.col("_t")
    request_body = F.substring(t, codes.REQUEST_HEADER_LENGTH + 1, 1 << 30)
    step = step.select(
        "_rest", "_t", is_response(t).alias("_r"), version_of(t).alias("_v"),
        (F.regexp_instr(t, F.lit("[\\x1D\\x1E]")) - 1).alias("_sep"), request_body.alias("_b"),
    )
    short = F.length(t) < codes.REQUEST_HEADER_LENGTH
    fatal = (
        F.when(trim_blank(t) == "", _fatal("EMPTY_INPUT", 0))
        .when(F.col("_r"), F.when(F.length(t) < codes.RESPONSE_HEADER_MIN_LENGTH, _fatal("NO_HEADER", 0)))
        .when(short, _fatal("NO_HEADER", 0))
        .when(F.col("_v") == "unsupported", _fatal("UNSUPPORTED_VERSION", 6, "A2"))
        .when((F.col("_v") == "d0") & (F.col("_b") != "") & ~has_framing(F.col("_b")), _fatal("INVALID_FRAMING", codes.REQUEST_HEADER_LENGTH))
    )
    step = step.withColumn("fatal", fatal)
    fine, response, f6 = F.col("fatal").isNull(), F.col("_r"), (F.col("_v") == "f6") & ~F.col("_r")
    base = F.when(response, F.col("_sep")).otherwise(codes.REQUEST_HEADER_LENGTH)
    body = F.when(fine, F.when(f6 | (response & (F.col("_sep") < 0)), "").when(response, F.expr("substring(_t, _sep + 1)")).otherwise(F.col("_b")))
    head = F.when(~response, F.substring(t, 1, codes.REQUEST_HEADER_LENGTH)).when(F.col("_sep") < 0, t).otherwise(F.expr("substring(_t, 1, _sep)"))
    step = step.select("_rest", "fatal", response.alias("_r"), f6.alias("_f6"), F.when(fine, head).alias("_head"), body.alias("_body"), base.cast("int").alias("_base"))
    if {"segments", "warnings"} & set(results):
        step = cut_messages(step, "_body", "_base", names)
    else:
        step = settled(step.drop("_body", "_base"), ["fatal", "_r", "_f6", "_head"])
    empty = F.struct(*[F.lit("").alias(n) if n != "versionRelease" else F.lit("F6").alias(n) for n, _ in codes.REQUEST_HEADER])
    response_header = decode_response_header(F.col("_head"))
    own = {n for n, _ in codes.RESPONSE_HEADER}
    from_response = F.struct(*[(response_header[n] if n in own else F.lit("")).alias(n) for n, _ in codes.REQUEST_HEADER])
    header = F.when(F.col("_r"), from_response).when(F.col("_f6"), empty).otherwise(decode_request_header(F.col("_head")))
    # warnings follow from the segments: a query that shows none doesn't work them out
    first_of = dict(zip(("05", "28", "10", "21", "08"), ("_s05", "_s28", "_s10", "_s21", "_s08"), strict=True))
    if "warnings" in results:
        step = step.select("*", *[find_segment(F.col("segments"), i).alias(n) for i, n in first_of.items()])
    named = {
        "kind": lambda: F.when(fine, F.when(F.col("_r"), "response").otherwise("request")), "header": lambda: F.when(fine, header), "responseHeader": lambda: F.when(fine & F.col("_r"), response_header),
        "segments": lambda: F.col("segments"), "transactionCount": lambda: F.when(fine, header)["transactionCount"], "warnings": lambda: F.when(fine, _claim_warnings(*[F.col(n) for n in first_of.values()])),
    }
    done = step.select(*[F.col("_rest")[c].alias(c) for c in kept], *[named[r]().alias(r) for r in results], "fatal")
    if mode == "DROPMALFORMED":
        return done.where("fatal IS NULL")
    if mode == "FAILFAST":
        stop = F.raise_error(F.concat_ws(": ", "fatal.code", "fatal.message"))
        return done.withColumn("fatal", F.when(F.col("fatal").isNotNull(), stop.cast(done.schema["fatal"].dataType)).otherwise(F.col("fatal")))
    return done


def _claim_warnings(cob: Column, response_cob: Column, compound: Column, status: Column, dur: Column) -> Column:
    """The warnings of the message's columns, in the order in which a reader meets them; segments are the first of their id."""
    both = [_count_warning("COB_COUNT_MISMATCH", s, count, _payer_count(s, count)) for s, count in ((cob, "4C"), (response_cob, "NT"))]
    first = [
        _if(F.col("_f6"), warning("VF6_NOT_DECODED", F.lit(0), "A2")), _if(F.col("second").isNotNull(), warning("MULTI_TRANSACTION_TRUNCATED", F.col("second"))),
        F.when(F.col("odd"), F.flatten(F.transform("segments", _segment_warnings))).otherwise(_none()),
    ]
    ours = F.concat(_count_warning("COMPOUND_COUNT_MISMATCH", compound, "EC", F.size(ingredient_blocks(compound))), *both, _dur_warnings(dur))
    return F.concat(*first, F.when(F.col("_r"), F.concat(_response_warnings(status), *both)).otherwise(ours))


def _payer_count(segment: Column, count_id: str) -> Column:
    """The number of ``payer_blocks``: its fields of coverage types, and the first field if it is another."""
    ids = F.array_remove(segment["fields"]["id"], count_id)
    return F.size(ids) - F.size(F.array_remove(ids, "5C")) + F.coalesce(F.get(ids, F.lit(0)) != "5C", F.lit(False)).cast("int")


def _fatal(code: str, offset: int, field: str | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(codes.CLAIM_FATALS[code]).alias("message"), F.lit(offset).alias("byteOffset"), F.lit(field).cast("string").alias("fieldId"))


def _count_warning(code: str, segment: Column, field_id: str, actual: Column) -> Column:
    declared = prefix_int(field_value(segment, field_id))
    return _if(F.coalesce(F.when(declared.isNotNull(), declared != actual), F.lit(False)), warning(code, segment["byteOffset"], field_id))


def _dur_warnings(segment: Column) -> Column:
    odd = F.filter(segment["fields"], lambda f: (f["id"] == "E4") & (f["value"] != "") & ~known(codes.DUR_REASONS, f["value"]))
    return F.coalesce(F.transform(odd, lambda f: warning("UNKNOWN_DUR_REASON", segment["byteOffset"], "E4")), _none())


def _response_warnings(segment: Column) -> Column:
    status = F.coalesce(field_value(segment, "AN"), F.lit(""))
    odd = F.filter(field_values(segment, "FB"), lambda v: ~known(codes.REJECT_CODES, v))
    at = segment["byteOffset"]
    found = F.concat(
        _if((status != "") & ~known(codes.RESPONSE_DISPOSITIONS, status), warning("UNKNOWN_RESPONSE_STATUS", at, "AN")),
        F.transform(odd, lambda v: warning("UNKNOWN_REJECT_CODE", at, "FB")),
        _if(_disposition(segment)["conflict"], warning("STATUS_CONFLICT", at, "AN")),
    )
    return F.when(segment.isNotNull(), found).otherwise(_none())


# -- classifying


def combine_disposition(status: Column, has_rejects: Column) -> Column:
    """A reject always wins; a status outside the table is unknown, never paid. conflict: rejects beside a positive status."""
    base = F.coalesce(lookup(codes.RESPONSE_DISPOSITIONS, status), F.lit("unknown"))
    return F.struct(F.when(has_rejects, "rejected").otherwise(base).alias("disposition"), (has_rejects & base.isin(*codes.POSITIVE_DISPOSITIONS)).alias("conflict"))


def count_declared(raw: Column) -> Column:
    return F.coalesce(prefix_int(raw) > 0, F.lit(False))


def _disposition(segment: Column) -> Column:
    rejects = (F.size(field_values(segment, "FB")) > 0) | count_declared(field_value(segment, "FA"))
    return combine_disposition(F.coalesce(field_value(segment, "AN"), F.lit("")), rejects)


def reject_code(code: Column) -> Column:
    return F.struct(code.alias("code"), known(codes.REJECT_CODES, code).alias("known"), lookup(codes.REJECT_CODES, code).alias("description"))


# -- views: each adds a column; segments may be any parsed table's


def _view(parsed: DataFrame, ids: Sequence[str], name: str, build, extra: Sequence[str] = ()) -> DataFrame:
    """Add column ``name`` from the first segments of ``ids`` (filtered once, in a projection of their own)."""
    names = [f"_seg{i}" for i in ids]
    step = parsed.select("*", *[find_segment(F.col("segments"), i).alias(n) for i, n in zip(ids, names, strict=True)])
    return step.withColumn(name, build(*[F.col(n) for n in names])).drop(*names)


def with_claim(parsed: DataFrame, name: str = "claim") -> DataFrame:
    """The claim's lifted values; null only without segments. Responses answer too."""

    def build(insurance: Column, patient: Column, claim: Column, prescriber: Column) -> Column:
        product_id, qualifier = field_value(claim, "D7"), field_value(claim, "E1")
        product = F.when(
            product_id.isNotNull() | qualifier.isNotNull(),
            F.struct(F.coalesce(product_id, F.lit("")).alias("id"), F.coalesce(qualifier, F.lit("")).alias("qualifier"), lookup(codes.PRODUCT_QUALIFIERS, F.coalesce(qualifier, F.lit(""))).alias("qualifierMeaning")),
        )
        lifted = F.struct(
            F.col("header.transactionCode").alias("transactionCode"),
            *[field_value(insurance, i).alias(n) for i, n in (("C1", "groupId"), ("C2", "cardholderId"), ("C3", "personCode"))],
            *[field_value(patient, i).alias(n) for i, n in (("C4", "dateOfBirth"), ("C5", "genderCode"))],
            *[field_value(claim, i).alias(n) for i, n in (("D2", "prescriptionReferenceNumber"), ("EM", "prescriptionReferenceQualifier"), ("D3", "fillNumber"))],
            product.alias("product"), quantity(field_value(claim, "E7")).alias("quantityDispensed"), decimal_value(field_value(claim, "D5")).alias("daysSupply"),
            field_value(claim, "D8").alias("dispenseAsWritten"), field_value(prescriber, "DB").alias("prescriberId"), field_value(prescriber, "EZ").alias("prescriberIdQualifier"),
        )
        return F.when(F.size("segments") > 0, lifted)

    return _view(parsed, ("04", "01", "07", "03"), name, build)


def _status(segment: Column) -> Column:
    def build(status: Column, both: Column) -> Column:
        return F.struct(
            status.alias("transactionResponseStatus"), lookup(codes.RESPONSE_STATUS_NAMES, status).alias("statusDescription"), both["disposition"].alias("disposition"),
            both["conflict"].alias("statusConflict"), field_value(segment, "FA").alias("rejectCount"), F.transform(field_values(segment, "FB"), reject_code).alias("rejectCodes"),
            field_value(segment, "F3").alias("authorizationNumber"), field_value(segment, "FQ").alias("additionalMessage"),
        )

    status = F.coalesce(field_value(segment, "AN"), F.lit(""))
    return F.when(segment.isNotNull(), let(status, lambda s: let(_disposition(segment), lambda both: build(s, both))))


def with_response_status(parsed: DataFrame, name: str = "status") -> DataFrame:
    return _view(parsed, ("21",), name, _status)


def _pricing(segment: Column) -> Column:
    amounts = (("F5", "patientPayAmount"), ("F9", "totalAmountPaid"), ("F6", "ingredientCostPaid"), ("F7", "dispensingFeePaid"))
    return F.when(segment.isNotNull(), F.struct(*[money(field_value(segment, i)).alias(n) for i, n in amounts], field_value(segment, "FM").alias("basisOfReimbursement")))


def with_response_pricing(parsed: DataFrame, name: str = "pricing") -> DataFrame:
    return _view(parsed, ("23",), name, _pricing)


def with_prior_authorization(parsed: DataFrame, name: str = "priorAuthorization") -> DataFrame:
    """What was submitted; it never says whether a claim is authorized."""
    build = lambda s: F.when(s.isNotNull(), F.struct(F.lit(True).alias("present"), field_value(s, "EU").alias("typeCode"), field_value(s, "EV").alias("numberSubmitted")))
    return _view(parsed, ("12",), name, build)


def with_adjudication(parsed: DataFrame, name: str = "adjudication") -> DataFrame:
    """Status, pricing and alerts of a response with segments; null for anything else."""
    build = lambda s21, s23, s24: F.when(
        (F.col("kind") == "response") & (F.size("segments") > 0),
        F.struct(F.col("header.transactionCode").alias("transactionCode"), _status(s21).alias("status"), _pricing(s23).alias("pricing"), _dur_alerts(s24).alias("dur")),
    )
    return _view(parsed, ("21", "23", "24"), name, build)


# -- repeating groups: the places where blocks start cut the segment's fields into slices

_BLOCKS = "array<array<struct<id:string,value:string,name:string,byteOffset:int>>>"


def _sliced(fields: Column, starts: Column) -> Column:
    """The fields from each start (a place, from 1) to the next."""
    build = lambda s: F.transform(s, lambda at, i: F.slice(fields, at, F.coalesce(F.get(s, i + 1), F.size(fields) + 1) - at))
    return F.coalesce(let(starts, build), F.array().cast(_BLOCKS))


def _events(fields: Column, ids: Sequence[str]) -> Column:
    """array<struct<at,id,value>> of the fields of these ids, with their places (from 1)."""
    placed = F.transform(fields, lambda f, i: F.struct((i + 1).alias("at"), f["id"].alias("id"), f["value"].alias("value")))
    return F.filter(placed, lambda e: e["id"].isin(*ids))


def _first(block: Column, field_id: str) -> Column:
    return F.get(F.filter(block, lambda x: x["id"] == field_id), F.lit(0))["value"]


def _last(block: Column, field_id: str) -> Column:
    return F.try_element_at(F.filter(block, lambda x: x["id"] == field_id), F.lit(-1))["value"]


def alert_blocks(segment: Column, counter: str | None) -> Column:
    """A block starts at the first field, at each ``counter`` field, and at a reason where the block has one already: that
    is, where the counter or reason before it is a reason."""

    def starts(events: Column) -> Column:
        again = F.transform(events, lambda e, i: F.when((e["id"] != "E4") | (F.get(events, i - 1)["id"] == "E4"), e["at"]))
        return F.array_distinct(F.concat(F.slice(F.array(F.lit(1)), F.lit(1), F.least(F.size(segment["fields"]), F.lit(1))), F.array_compact(again)))

    return _sliced(segment["fields"], let(_events(segment["fields"], ["E4"] if counter is None else [counter, "E4"]), starts))


def _alert(fields: Sequence[tuple[str, str]]):
    def build(block: Column) -> Column:
        named = lambda r: F.struct(*[_last(block, i).alias(n) for i, n in fields], known(codes.DUR_REASONS, r).alias("reasonKnown"), lookup(codes.DUR_REASONS, r).alias("reasonDescription"))
        return let(_last(block, "E4"), named)

    return build


def _dur_alerts(segment: Column) -> Column:
    fields = (
        ("J6", "counter"), ("E4", "reasonForServiceCode"), ("FS", "clinicalSignificanceCode"), ("E5", "professionalServiceCode"), ("E6", "resultOfServiceCode"),
        ("8E", "levelOfEffort"), ("FU", "previousDateOfFill"), ("FV", "quantityOfPreviousFill"), ("FY", "freeText"),
    )
    return F.transform(alert_blocks(segment, "J6"), _alert(fields))


def with_response_dur(parsed: DataFrame, name: str = "alerts") -> DataFrame:
    return _view(parsed, ("24",), name, _dur_alerts)


def with_request_dur(parsed: DataFrame, name: str = "interventions") -> DataFrame:
    fields = (
        ("E4", "reasonForServiceCode"), ("E5", "professionalServiceCode"), ("E6", "resultOfServiceCode"), ("8E", "levelOfEffort"), ("J9", "coAgentIdQualifier"), ("H7", "coAgentId"),
    )
    return _view(parsed, ("08",), name, lambda s: F.transform(alert_blocks(s, None), _alert(fields)))


def ingredient_blocks(segment: Column) -> Column:
    """A block starts at a qualifier or product id that the block has already, or at the first of them. An empty value is
    as if it weren't there; fields before the first anchor belong to no block."""
    kind = "struct<q:boolean,p:boolean,starts:array<int>>"

    def step(s: Column, e: Column) -> Column:
        q, full = e["id"] == "RE", e["value"] != ""
        start = (F.size(s["starts"]) == 0) | F.when(q, s["q"]).otherwise(s["p"])
        return F.struct(
            F.when(q, full).otherwise(s["q"] & ~start).alias("q"), F.when(~q, full).otherwise(s["p"] & ~start).alias("p"),
            F.when(start, F.array_append(s["starts"], e["at"])).otherwise(s["starts"]).alias("starts"),
        )

    zero = F.struct(F.lit(False).alias("q"), F.lit(False).alias("p"), F.array().cast("array<int>").alias("starts")).cast(kind)
    return _sliced(segment["fields"], F.aggregate(_events(segment["fields"], ["RE", "TE"]), zero, step)["starts"])


def with_compound(parsed: DataFrame, name: str = "compound") -> DataFrame:
    def ingredient(block: Column) -> Column:
        qualifier = F.coalesce(_last(block, "RE"), F.lit(""))
        return F.struct(
            F.coalesce(_last(block, "TE"), F.lit("")).alias("productId"), qualifier.alias("productIdQualifier"), lookup(codes.PRODUCT_QUALIFIERS, qualifier).alias("qualifierMeaning"),
            quantity(_last(block, "ED")).alias("quantity"), money(_last(block, "EE")).alias("drugCost"), _last(block, "UE").alias("basisOfCostDetermination"),
        )

    def build(s: Column) -> Column:
        lifted = F.struct(
            field_value(s, "EF").alias("dosageFormCode"), field_value(s, "EG").alias("dispensingUnitFormIndicator"), field_value(s, "EC").alias("declaredIngredientCount"),
            F.transform(ingredient_blocks(s), ingredient).alias("ingredients"),
        )
        return F.when(s.isNotNull(), lifted)

    return _view(parsed, ("10",), name, build)


def payer_blocks(segment: Column, count_id: str) -> Column:
    """Without the count field: a block starts at the first field and at each coverage type."""

    def blocks(fields: Column) -> Column:
        starts = F.transform(fields, lambda f, i: F.when((i == 0) | (f["id"] == "5C"), i + 1))
        return _sliced(fields, F.array_compact(starts))

    return F.coalesce(let(F.filter(segment["fields"], lambda f: f["id"] != count_id), blocks), F.array().cast(_BLOCKS))


def amount_rows(block: Column, qualifier_id: str, amount_id: str) -> Column:
    """Each amount with the qualifier right before it among qualifiers and amounts; a qualifier without an amount is dropped."""

    def rows(events: Column) -> Column:
        def row(e: Column, i: Column) -> Column:
            before = let(F.get(events, i - 1), lambda b: F.when(b["id"] == qualifier_id, b["value"]))
            return F.when(e["id"] == amount_id, F.struct(before.alias("qualifier"), money(e["value"]).alias("amount")))

        return F.array_compact(F.transform(events, row))

    return let(_events(block, [qualifier_id, amount_id]), rows)


def with_other_payments(parsed: DataFrame, name: str = "otherPayments") -> DataFrame:
    fields = (("5C", "coverageType"), ("6C", "payerIdQualifier"), ("7C", "payerId"), ("E8", "payerDate"))
    payer = lambda b: F.struct(*[_first(b, i).alias(n) for i, n in fields], amount_rows(b, "HC", "DV").alias("amountsPaid"), amount_rows(b, "6E", "7E").alias("patientResponsibilityAmounts"))
    return _view(parsed, ("05",), name, lambda s: F.transform(payer_blocks(s, "4C"), payer))


def with_response_other_payers(parsed: DataFrame, name: str = "otherPayers") -> DataFrame:
    fields = (("5C", "coverageType"), ("6C", "payerIdQualifier"), ("7C", "payerId"), ("MH", "processorControlNumber"), ("NU", "cardholderId"), ("MJ", "groupId"))
    return _view(parsed, ("28",), name, lambda s: F.transform(payer_blocks(s, "NT"), lambda b: F.struct(*[_first(b, i).alias(n) for i, n in fields])))


# -- writing


def _padded(value: Column, width: int) -> Column:
    return F.rpad(F.coalesce(value, F.lit("")), width, " ")


def serialize_claims(header: Column, response_header: Column, kind: Column, segments: Column) -> Column:
    """Canonical text: padded header, then segments and fields between separators.

    A segment without any token (only separators were read) is left out, and a request body of one token gets a separator at
    its end, so what is written is always read back as the same.
    """
    token = lambda f: F.concat(f["id"], f["value"])
    lead = lambda s: F.when(s["segmentId"] != "", F.array(F.concat(F.lit("AM"), s["segmentId"]))).otherwise(F.array().cast("array<string>"))
    parts = F.transform(segments, lambda s: F.array_join(F.concat(lead(s), F.transform(s["fields"], token)), FS))
    body = F.array_join(F.filter(parts, lambda p: p != ""), RS)
    framed = let(body, lambda b: F.when((b == "") | has_framing(b), b).otherwise(F.concat(b, F.lit(RS))))
    request = F.concat(*[_padded(header[n], w) for n, w in codes.REQUEST_HEADER], framed)
    response = F.concat(*[_padded(response_header[n], w) for n, w in codes.RESPONSE_HEADER], F.lit(GS), body)
    return F.when(kind == "response", response).otherwise(request)


def with_wire(parsed: DataFrame, name: str = "wire") -> DataFrame:
    return parsed.withColumn(name, serialize_claims(F.col("header"), F.col("responseHeader"), F.col("kind"), F.col("segments")))


def build_requests(inputs: DataFrame, header: str = "header", segments: str = "segments", *, mode: str = "PERMISSIVE") -> DataFrame:
    """Requests from inputs: ``header`` is a struct of header values (absent ones null), ``segments`` an array of
    struct<segmentId, fields array<struct<id, value>>>.

    Columns added: buildError (code, message, headerField; null if it is fine), and then kind, header, segments,
    transactionCount as a parsed request has them. Checks run in a fixed order and the first failure counts. FAILFAST raises.
    """
    check_mode(mode, (MODES[0], MODES[2]))
    given = {f.name for f in inputs.schema[header].dataType.fields}
    defaults = {"versionRelease": "D0", "transactionCount": "1"}
    h = F.col(header)
    columns = []
    for n, _ in codes.REQUEST_HEADER:
        value = h[n] if n in given else F.lit(None).cast("string")
        value = trim_blank(F.coalesce(value, F.lit(""))) if n == "transactionCode" else F.coalesce(value, F.lit(defaults.get(n, "")))
        columns.append(value.alias(n))
    control = lambda c: c.rlike("[\\x1C-\\x1E]")
    step = inputs.withColumn("_h", F.struct(*columns))

    def error(code: str, field: str | None = None) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(codes.CLAIM_BUILD_ERRORS[code]).alias("message"), F.lit(field).cast("string").alias("headerField"))

    found = F.when(F.col("_h.transactionCode") == "", error("MISSING_TRANSACTION_CODE"))
    for n, width in codes.REQUEST_HEADER:
        found = found.when(control(F.col("_h")[n]), error("EMBEDDED_CONTROL_CHARACTER", n)).when(F.length(F.col("_h")[n]) > width, error("FIELD_TOO_LONG", n))
    field_error = lambda f: F.when(F.length(f["id"]) != 2, error("INVALID_FIELD_ID")).when(control(f["id"]) | control(f["value"]), error("EMBEDDED_CONTROL_CHARACTER"))
    segment_error = lambda s: (
        F.when(trim_blank(s["segmentId"]) == "", error("MISSING_SEGMENT_ID"))
        .when(control(s["segmentId"]), error("EMBEDDED_CONTROL_CHARACTER"))
        .when(F.length(s["segmentId"]) != codes.SEGMENT_ID_LENGTH, error("INVALID_SEGMENT_ID"))
        .otherwise(F.get(F.filter(F.transform(s["fields"], field_error), lambda e: e.isNotNull()), F.lit(0)))
    )
    in_segments = F.get(F.filter(F.transform(F.col(segments), segment_error), lambda e: e.isNotNull()), F.lit(0))
    step = step.withColumn("buildError", F.coalesce(found, in_segments))
    if mode == "FAILFAST":
        kind = step.schema["buildError"].dataType
        step = step.withColumn("buildError", F.when(F.col("buildError").isNotNull(), F.raise_error(F.concat_ws(": ", "buildError.code", "buildError.message")).cast(kind)))
    made = F.transform(
        F.col(segments),
        lambda s: F.struct(
            s["segmentId"].alias("segmentId"), lookup(codes.SEGMENT_NAMES, s["segmentId"]).alias("name"), F.lit(0).alias("byteOffset"),
            F.transform(s["fields"], lambda f: F.struct(f["id"].alias("id"), f["value"].alias("value"), lookup(codes.FIELD_NAMES, f["id"]).alias("name"), F.lit(0).alias("byteOffset"))).alias("fields"),
        ).cast(SEGMENT),
    )
    fine = F.col("buildError").isNull()
    others = [c for c in inputs.columns if c not in (header, segments)]
    return step.select(
        *others, "buildError", F.when(fine, "request").alias("kind"), F.when(fine, F.col("_h")).alias("header"), F.lit(None).cast("struct<" + ",".join(f"{n}:string" for n, _ in codes.RESPONSE_HEADER) + ">").alias("responseHeader"),
        F.when(fine, made).alias("segments"), F.when(fine, F.col("_h.transactionCount")).alias("transactionCount"), F.when(fine, _none()).alias("warnings"),
    )


# -- the long form


def long_fields(parsed: DataFrame, key: str) -> DataFrame:
    """A row for each field: key, seg_no, segment_id, segment_name, seg_offset, field_no, field_id, field_name, value, field_offset."""
    segments = parsed.select(key, F.posexplode("segments").alias("seg_no", "s"))
    fields = segments.select(key, "seg_no", "s.segmentId", "s.name", "s.byteOffset", F.posexplode("s.fields").alias("field_no", "f"))
    return fields.select(
        key, "seg_no", F.col("segmentId").alias("segment_id"), F.col("name").alias("segment_name"), F.col("byteOffset").alias("seg_offset"), "field_no",
        F.col("f.id").alias("field_id"), F.col("f.name").alias("field_name"), F.col("f.value").alias("value"), F.col("f.byteOffset").alias("field_offset"),
    )


def long_warnings(parsed: DataFrame, key: str) -> DataFrame:
    """A row for each warning: key, ord, code, message, byteOffset, fieldId."""
    return parsed.select(key, F.posexplode("warnings").alias("ord", "w")).select(key, "ord", "w.*")


# -- SQL


def register(spark: SparkSession) -> None:
    """The session's table function ``claim_fields(payload)``: seg_no, segment_id, field_no, field_id, value of each field of the
    first transaction. It is SQL, for use in a LATERAL join, and has the gates of ``parse_claims``: a message that isn't read
    there, or isn't decoded, has no rows here. ``parse_claims`` also has names, positions, warnings and errors."""
    blank, controls = BLANK.replace("\\", "\\\\"), "[\\\\x1c-\\\\x1e]"
    head = codes.REQUEST_HEADER_LENGTH
    response = "substring(payload, 7, 2) <> 'D0' AND substring(payload, 1, 2) = 'D0'"
    refused = (
        f"payload IS NULL OR payload RLIKE '^{blank}*\\\\z' OR CASE WHEN {response} THEN length(payload) < {codes.RESPONSE_HEADER_MIN_LENGTH} ELSE length(payload) < {head} "
        f"OR substring(payload, 7, 2) <> 'D0' OR (length(payload) > {head} AND NOT substring(payload, {head + 1}) RLIKE '{controls}') END"
    )
    body = f"CASE WHEN {refused} THEN '' WHEN {response} THEN regexp_replace(payload, '^[^\\\\x1d\\\\x1e]*', '') ELSE substring(payload, {head + 1}) END"
    spark.sql(
        rf"""CREATE OR REPLACE TEMPORARY FUNCTION claim_fields(payload STRING) RETURNS TABLE (seg_no INT, segment_id STRING, field_no INT, field_id STRING, value STRING) RETURN
        SELECT s.seg_no, n.segment_id, f.field_no, CASE WHEN length(f.token) < 2 THEN '' ELSE substring(f.token, 1, 2) END, CASE WHEN length(f.token) < 2 THEN f.token ELSE substring(f.token, 3) END
        FROM posexplode(filter(split(regexp_extract({body}, '[^\\x1d]+', 0), '\\x1e'), x -> x <> '')) AS s(seg_no, segment),
          LATERAL (SELECT filter(split(s.segment, '\\x1c'), x -> x <> '') AS tokens) AS t,
          LATERAL (SELECT CASE WHEN get(t.tokens, 0) RLIKE '^AM..\\z' THEN substring(t.tokens[0], 3) ELSE '' END AS segment_id) AS n,
          LATERAL posexplode(CASE WHEN n.segment_id <> '' THEN slice(t.tokens, 2, size(t.tokens)) ELSE t.tokens END) AS f(field_no, token)"""
    )
