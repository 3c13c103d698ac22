"""E-prescribing messages: an XML tree per row as an array of nodes, read by column expressions.

Elements are found level by level, each level in a projection of its own, so a lookup below an element refers to a column and
not to another lookup.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave import codes
from rxweave.functions.scalars import BLANKS, check_mode, coded_value, decimal_value, disposition_of_kind, let, settled, sql_text, text_or_null, trim_blank
from rxweave.sources.xml import DEEP, KEYS, NODE, REFUSED, shred_messages

WARNING = "struct<code:string,message:string,path:string>"
NODES, INDEX = "_nodes", "_index"


def warning(code: str, path: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(codes.SCRIPT_WARNINGS[code]).alias("message"), path.alias("path")).cast(WARNING)


def _if(condition: Column, found: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(found)).otherwise(F.array().cast(f"array<{WARNING}>"))


# -- navigation: elements are named by the columns that hold them, and each lookup is one SQL expression


def _found(el: str, name: str, deep: bool = False) -> str:
    """A node by its key in the message's index: an integer, since a map is searched key by key."""
    number = DEEP + codes.DEEP_ELEMENTS.index(name) if deep else codes.CHILD_ELEMENTS.index(name)
    return f"get({NODES}, try_element_at({INDEX}, CAST({el}.id AS BIGINT) * {KEYS} + {number}))"


def _trimmed(text: str) -> str:
    return f"nullif(btrim({text}, {sql_text(BLANKS)}), '')"


def _child_text(el: str, name: str) -> str:
    return _trimmed(_found(el, name) + ".text")


def _attribute(el: str, name: str) -> str:
    return f"try_element_at({el}.attrs, {sql_text(name)})"


def first_child(el: str, name: str) -> Column:
    return F.expr(_found(el, name))


def first_descendant(el: str, name: str) -> Column:
    """In document order, the element itself included; for the names that the index has at any depth."""
    if name not in codes.DEEP_ELEMENTS:
        raise ValueError(f"{name} isn't indexed at any depth")
    return F.expr(_found(el, name, deep=True))


def first_named(el: str, names: Sequence[str]) -> Column:
    """The first alias that occurs decides, before document order."""
    return F.coalesce(*[first_descendant(el, n) for n in names])


def own_text(el: str) -> Column:
    return F.expr(_trimmed(f"{el}.text"))


def child_text(el: str, name: str) -> Column:
    """Trimmed text of the first child of the name; blank is absent, and a second child isn't tried."""
    return F.expr(_child_text(el, name))


def attribute(el: str, name: str) -> Column:
    return F.expr(_attribute(el, name))


def _present(**members: Column) -> Column:
    """A struct, or null if all its members are absent."""
    there = lambda s: reduce(or_, [s[k].isNotNull() for k in members])
    return let(F.struct(*[c.alias(k) for k, c in members.items()]), lambda s: F.when(there(s), s))


def _add(df: DataFrame, **found: Column) -> DataFrame:
    return df.select("*", *[c.alias(k) for k, c in found.items()])


def _how_many(found: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in found])


# -- versions


def classify_version(v: Column) -> Column:
    t = trim_blank(v)
    return (
        F.when(v.isNull() | (t == ""), "absent").when(t.isin(*codes.KNOWN_SCRIPT_VERSIONS), "known").when(t.rlike("^[0-9]{1,2}\\.[0-9]+\\z"), "unsupported").otherwise("tolerated")
    )


def _fatal(code: str, path: str | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(codes.SCRIPT_FATALS[code]).alias("message"), F.lit(path).cast("string").alias("path"))


# -- extraction


def _party(df: DataFrame, parent: str, to: str) -> DataFrame:
    """Columns {to}patient, {to}pharmacy, {to}prescriber below the element in column ``parent``."""
    p = parent
    df = _add(df, _patient=first_child(p, "Patient"), _pharmacy=first_child(p, "Pharmacy"), _prescriber=first_child(p, "Prescriber"))
    a, b, c = "_patient", "_pharmacy", "_prescriber"
    df = _add(
        df, _pname=first_descendant(a, "Name"), _pgender=first_descendant(a, "Gender"), _pdob=first_descendant(a, "DateOfBirth"),
        _bname=first_descendant(b, "BusinessName"), _bid=first_descendant(b, "Identification"), _cname=first_descendant(c, "Name"), _cid=first_descendant(c, "Identification"),
    )
    name = lambda x: _present(lastName=child_text(x, "LastName"), firstName=child_text(x, "FirstName"), middleName=child_text(x, "MiddleName"))
    ident = lambda x: _present(**{member: child_text(x, tag) for member, tag in codes.IDENTIFICATIONS.items()})
    df = _add(df, _n1=name("_pname"), _n2=name("_cname"), _i1=ident("_bid"), _i2=ident("_cid"))
    df = _add(
        df,
        **{
            f"{to}patient": _present(name=F.col("_n1"), gender=own_text("_pgender"), dateOfBirth=_date("_pdob")),
            f"{to}pharmacy": _present(businessName=own_text("_bname"), identification=F.col("_i1")),
            f"{to}prescriber": _present(name=F.col("_n2"), identification=F.col("_i2")),
        },
    )
    return df.drop("_patient", "_pharmacy", "_prescriber", "_pname", "_pgender", "_pdob", "_bname", "_bid", "_cname", "_cid", "_n1", "_n2", "_i1", "_i2")


def _date(el: str) -> Column:
    return F.coalesce(child_text(el, "Date"), own_text(el))


def _code_or_text(el: str) -> Column:
    return F.coalesce(child_text(el, "Code"), own_text(el))


SIG_FIELD = "struct<provenance:string,text:string,code:struct<value:string,qualifier:string,system:string>>"


def _sig_field(el: str) -> Column:
    code, text = _child_text(el, "Code"), f"coalesce({_child_text(el, 'Text')}, {_trimmed(el + '.text')})"
    qualifier = "coalesce(" + ", ".join([*(_child_text(el, n) for n in ("Qualifier", "CodeSystem")), *(_attribute(el, n) for n in ("Qualifier", "CodeSystem")), "''"]) + ")"
    given = F.expr(f"named_struct('code', {code}, 'text', {text}, 'qualifier', {qualifier})")

    def build(x: Column) -> Column:
        provenance = F.when(x["code"].isNotNull(), "coded").when(x["text"].isNotNull(), "derived").otherwise("absent")
        return F.struct(provenance.alias("provenance"), x["text"].alias("text"), coded_value(x["code"], x["qualifier"]).alias("code")).cast(SIG_FIELD)

    return let(given, build)


def _medication(df: DataFrame, parent: str, path: Column, to: str) -> DataFrame:
    """Columns {to}medication and {to}medicationWarnings of the MedicationPrescribed below column ``parent``."""
    df = _add(df, _med=first_child(parent, "MedicationPrescribed"), _mpath=path)
    m = "_med"
    df = _add(
        df, _coded=first_child(m, "DrugCoded"), _strength=first_child(m, "Strength"), _quantity=first_child(m, "Quantity"), _refills=first_child(m, "Refills"),
        _written=first_descendant(m, "WrittenDate"), _sigtext=first_descendant(m, "SigText"), _sig=first_child(m, "Sig"),
    )
    sig, strength, coded, amount = "_sig", "_strength", "_coded", "_quantity"
    df = _add(
        df, _product=first_child(coded, "ProductCode"), _db=first_child(coded, "DrugDBCode"), _form=first_child(strength, "StrengthForm"),
        _sunit=first_child(strength, "StrengthUnitOfMeasure"), _qunit=first_child(amount, "QuantityUnitOfMeasure"), _sigown=first_descendant(sig, "SigText"),
        **{f"_sig_{k}": first_named(sig, names) for k, names in codes.SIG_COMPONENTS.items()},
    )
    product, db = "_product", "_db"
    df = _add(df, **{f"_field_{k}": _sig_field(f"_sig_{k}") for k in codes.SIG_COMPONENTS}, _qvalue=child_text(amount, "Value"), _days=child_text(m, "DaysSupply"))
    decoded = F.greatest(*[F.col(f"_field_{k}.provenance") != "absent" for k in codes.SIG_COMPONENTS])
    df = _add(
        df,
        _c=_present(
            productCode=coded_value(own_text(product), F.coalesce(attribute(product, "Qualifier"), F.lit(""))),
            drugDbCode=coded_value(_code_or_text(db), F.coalesce(child_text(db, "Qualifier"), attribute(db, "Qualifier"), F.lit(""))),
        ),
        _s=_present(value=child_text(strength, "StrengthValue"), form=_code_or_text("_form"), unitOfMeasure=_code_or_text("_sunit")),
        _q=_present(value=decimal_value(F.col("_qvalue")), unitOfMeasure=_code_or_text("_qunit"), codeListQualifier=child_text(amount, "CodeListQualifier")),
        _g=F.when(F.col(sig).isNotNull(), F.struct(own_text("_sigown").alias("sigText"), *[F.col(f"_field_{k}").alias(k) for k in codes.SIG_COMPONENTS], decoded.alias("hasStructuredData"))),
    )
    found = F.concat(
        _if(F.col("_c").isNotNull() & F.col("_s").isNotNull(), warning("STRENGTH_CODED_AND_EXPLICIT", F.col("_mpath"))),
        _if(F.col("_sig_dose").isNotNull() & (F.col("_field_dose.provenance") == "absent"), warning("SIG_AMBIGUOUS_DOSE", F.concat_ws("/", "_mpath", F.lit("Sig"), "_sig_dose.name"))),
        _if(F.col("_g.hasStructuredData"), warning("SIG_STRUCTURED_LOSSY", F.concat_ws("/", "_mpath", F.lit("Sig")))),
    )
    medication = _present(
        description=child_text(m, "DrugDescription"), coded=F.col("_c"), strength=F.col("_s"), quantity=F.col("_q"), daysSupply=decimal_value(F.col("_days")),
        numberOfRefills=F.coalesce(child_text(m, "NumberOfRefills"), child_text("_refills", "Value")), substitutions=child_text(m, "Substitutions"),
        writtenDate=_date("_written"), directions=child_text(m, "Directions"), sigText=own_text("_sigtext"), sig=F.col("_g"), note=child_text(m, "Note"),
    )
    own = [c for c in df.columns if c.startswith(("_sig_", "_field_"))]
    df = _add(df, **{f"{to}medication": medication, f"{to}medicationWarnings": found})
    return df.drop(
        "_med", "_mpath", "_coded", "_strength", "_quantity", "_refills", "_written", "_sigtext", "_sig", "_product", "_db", "_form", "_sunit", "_qunit", "_sigown", "_qvalue", "_days", "_c", "_s", "_q", "_g", *own
    )


def parse_scripts(raw: DataFrame, payload: str = "payload", *, mode: str = "PERMISSIVE", keep: Sequence[str] | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Read each message: the ``keep`` columns (default: all but the payload) and version, header, kind, transaction, patient, pharmacy,
    prescriber, medication, requestReferenceNumber, outcome, reason, response, disposition, correlatesTo, warnings, fatal.

    kind is NewRx, one of the lifecycle requests and responses, Error, Status, Verify or ``unsupported`` (whose transaction is
    named only if it is in the fixed list). A denial wins over an approval beside it, an error over a status; no outcome is
    ``unknown``. The gates come first: blank, a document type or entity declaration anywhere in the text, XML that isn't well
    formed, another root, a legacy version. ``fatal`` (code, message, path) is set there and the rest is null. Modes as for
    claims. A null payload counts as empty. ``only`` names the results that are wanted (``fatal`` always is), and no others are
    worked out.
    """
    check_mode(mode)
    kept = [c for c in raw.columns if c != payload] if keep is None else list(keep)
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    refused = text.rlike(REFUSED)
    gate = F.when(trim_blank(text) == "", _fatal("EMPTY_INPUT")).when(refused, _fatal("NOT_XML"))
    step = raw.select(F.struct(F.lit(0).alias("_"), *kept).alias("_rest"), gate.alias("_gate"), F.when(gate.isNull(), text).alias("_text"))
    step = shred_messages(step, "_text", NODES, index=INDEX, children=codes.CHILD_ELEMENTS, deep=codes.DEEP_ELEMENTS).drop("_text")
    step = _add(step, _root=F.get(F.col(NODES), F.lit(0)))
    root = "_root"
    step = _add(step, _head=first_child(root, "Header"), _body0=first_child(root, "Body"))
    stamp = text_or_null(F.coalesce(attribute(root, "version"), attribute(root, "Version")))
    step = _add(step, version=F.coalesce(stamp, child_text("_head", "Version")), _body=F.coalesce("_body0", "_root"), _bpath=F.when(F.col("_body0").isNull(), "/Message").otherwise("/Message/Body"))
    sort = classify_version(F.col("version"))
    fatal = (
        F.when(F.col("_gate").isNotNull(), F.col("_gate"))
        .when(F.col(NODES).isNull(), _fatal("NOT_XML"))
        .when(F.col("_root.name") != "Message", _fatal("NO_MESSAGE_ROOT", "/"))
        .when(sort == "unsupported", _fatal("UNSUPPORTED_VERSION", "/Message"))
    )
    head = "_head"
    names = (("to", "To"), ("from", "From"), ("messageId", "MessageID"), ("relatesToMessageId", "RelatesToMessageID"), ("sentTime", "SentTime"), ("prescriberOrderNumber", "PrescriberOrderNumber"))
    header = F.struct(F.col("version"), *[child_text(head, tag).alias(n) for n, tag in names])
    order = ("NewRx", *codes.LIFECYCLE_REQUESTS, *codes.LIFECYCLE_RESPONSES, *codes.RESPONSE_KINDS)
    step = _add(step, fatal=fatal, header=header, _sort=sort, _tx=F.coalesce(*[first_child("_body", k) for k in order]))
    step = _add(step, kind=F.coalesce(F.col("_tx.name"), F.lit("unsupported")), _tpath=F.concat_ws("/", "_bpath", "_tx.name"))
    is_response = F.col("kind").isin(*codes.LIFECYCLE_RESPONSES)
    answers = F.col("kind").isin(*codes.RESPONSE_KINDS)
    has_parties = F.col("kind").isin("NewRx", *codes.LIFECYCLE_REQUESTS)
    step = _add(step, _resp0=F.when(is_response, first_child("_tx", "Response")), _parties=F.when(has_parties, F.col("_tx")), _withmed=F.when(has_parties | is_response, F.col("_tx")))
    step = _add(step, _resp=F.when(is_response, F.coalesce("_resp0", "_tx")), _rpath=F.when(F.col("_resp0").isNull(), F.col("_tpath")).otherwise(F.concat_ws("/", "_tpath", F.lit("Response"))))
    outcomes = [first_child("_resp", k) for k in codes.OUTCOMES]
    step = _add(step, _out=F.coalesce(*outcomes), _nouts=_how_many(outcomes))
    out = "_out"
    outcome = F.when(is_response, F.coalesce(*[F.when(F.col("_out.name") == k, v) for k, v in codes.OUTCOMES.items()], F.lit("unknown")))
    reason = _present(code=child_text(out, "ReasonCode"), referenceNumber=child_text(out, "ReferenceNumber"), denialReason=child_text(out, "DenialReason"), note=child_text(out, "Note"))
    step = _add(step, outcome=outcome, reason=reason)
    step = _party(step, "_parties", "")
    step = _medication(step, "_withmed", F.concat_ws("/", "_tpath", F.lit("MedicationPrescribed")), "_a")
    nested = F.concat_ws("/", "_rpath", "_out.name", F.lit("MedicationPrescribed"))
    step = _add(step, _nest=F.when(is_response & F.col("_amedication").isNull(), F.col(out)))
    step = _medication(step, "_nest", nested, "_b")
    tx = "_tx"
    code = child_text(tx, "Code")
    response = F.when(answers, F.struct(F.col("kind"), code.alias("code"), child_text(tx, "DescriptionCode").alias("descriptionCode"), child_text(tx, "Description").alias("description")))
    seen = _how_many([first_child("_body", k) for k in codes.RESPONSE_KINDS])
    first = let(F.col("_body")["id"], lambda i: F.get(F.filter(NODES, lambda n: (n["parent"] == i) & (n["name"] != "Header")), F.lit(0)))["name"]
    found = F.concat(
        _if(F.col("_sort") == "absent", warning("VERSION_ABSENT", F.lit("/Message"))), _if(F.col("_sort") == "tolerated", warning("UNSUPPORTED_VERSION_TOLERATED", F.lit("/Message"))),
        _if(is_response & (F.col("_nouts") == 0), warning("LIFECYCLE_OUTCOME_UNRECOGNIZED", F.col("_rpath"))), _if(is_response & (F.col("_nouts") > 1), warning("LIFECYCLE_AMBIGUOUS_OUTCOME", F.col("_rpath"))),
        "_amedicationWarnings", "_bmedicationWarnings", _if(answers & (seen > 1), warning("RESPONSE_AMBIGUOUS_DISPOSITION", F.col("_bpath"))),
        _if(answers & code.isNull(), warning("MISSING_REQUIRED_ELEMENT", F.col("_tpath"))), _if(F.col("kind") == "unsupported", warning("UNSUPPORTED_TRANSACTION", F.col("_bpath"))),
    )
    step = _add(
        step, transaction=F.when((F.col("kind") == "unsupported") & first.isin(*codes.SCRIPT_TRANSACTIONS), first), medication=F.coalesce("_amedication", "_bmedication"),
        requestReferenceNumber=F.when(F.col("kind").isin(*codes.LIFECYCLE_REQUESTS, *codes.LIFECYCLE_RESPONSES), child_text(tx, "RequestReferenceNumber")),
        response=response, disposition=disposition_of_kind(F.col("kind")), correlatesTo=F.col("header.relatesToMessageId"), warnings=found,
    )
    fine = F.col("fatal").isNull()
    results = ("version", "header", "kind", "transaction", "patient", "pharmacy", "prescriber", "medication", "requestReferenceNumber", "outcome", "reason", "response", "disposition", "correlatesTo", "warnings")
    if only is not None:
        if unknown := set(only) - {*results, "fatal"}:
            raise ValueError(f"no such results: {sorted(unknown)}")
        results = tuple(r for r in results if r in only)
    done = step.select(*[F.col("_rest")[c].alias(c) for c in kept], *[F.when(fine, F.col(c)).alias(c) for c in results], "fatal")
    done = settled(done, [*results, "fatal"])
    if mode == "DROPMALFORMED":
        return done.where("fatal IS NULL")
    if mode == "FAILFAST":
        stop = F.raise_error(F.concat_ws(": ", "fatal.code", "fatal.message"))
        return done.withColumn("fatal", F.when(F.col("fatal").isNotNull(), stop.cast(done.schema["fatal"].dataType)).otherwise(F.col("fatal")))
    return done


def of_kind(parsed: DataFrame, *kinds: str) -> DataFrame:
    """The messages of one variant or family."""
    return parsed.where(F.col("kind").isin(*kinds))


def correlate(responses: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Pairs of a response and the request that it relates to: an equi-join on the message id."""
    left = responses.select(F.col(key).alias("response_id"), F.col("correlatesTo").alias("_id"))
    right = requests.select(F.col(key).alias("request_id"), F.col("header.messageId").alias("_id"))
    return left.join(right, "_id").drop("_id")


# -- writing


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _escape_attr(c: Column) -> Column:
    return F.replace(_escape(c), F.lit('"'), F.lit("&quot;"))


def leaf(depth: int, tag: str | Column, value: Column, attrs: Column | None = None) -> Column:
    """One line, or null without a value."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(F.lit("  " * depth + "<"), name, F.lit("") if attrs is None else attrs, F.lit(">"), _escape(value), F.lit("</"), name, F.lit(">"))


def container(depth: int, tag: str | Column, children: Sequence[Column], present: Column | None = None, attrs: Column | None = None) -> Column:
    """The children that are there between the tags; null without any, unless ``present``: then an empty element."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    opening = F.concat(F.lit("  " * depth + "<"), name, F.lit("") if attrs is None else attrs)
    empty = F.when(F.lit(False) if present is None else present, F.concat(opening, F.lit("/>")))
    if not children:
        return empty

    def around(inner: Column) -> Column:
        return F.when(inner != "", F.concat(opening, F.lit(">\n"), inner, F.lit("\n" + "  " * depth + "</"), name, F.lit(">"))).otherwise(empty)

    return let(F.concat_ws("\n", *children), around)


def _parties_xml(depth: int) -> list[Column]:
    def name(of: str) -> Column:
        return container(depth + 1, "Name", [leaf(depth + 2, t, F.col(f"{of}.name.{c}")) for t, c in (("LastName", "lastName"), ("FirstName", "firstName"), ("MiddleName", "middleName"))])

    def ident(of: str) -> Column:
        return container(depth + 1, "Identification", [leaf(depth + 2, t, F.col(f"{of}.identification.{c}")) for c, t in codes.IDENTIFICATIONS.items()])

    return [
        container(depth, "Patient", [name("patient"), leaf(depth + 1, "Gender", F.col("patient.gender")), leaf(depth + 1, "DateOfBirth", F.col("patient.dateOfBirth"))]),
        container(depth, "Pharmacy", [leaf(depth + 1, "BusinessName", F.col("pharmacy.businessName")), ident("pharmacy")]),
        container(depth, "Prescriber", [name("prescriber"), ident("prescriber")]),
    ]


def _medication_xml(depth: int) -> Column:
    d = depth + 1
    m = lambda path: F.col(f"medication.{path}")
    plain = lambda c: F.when(c != "", c)
    qualifier = F.when(m("coded.productCode.qualifier") != "", F.concat(F.lit(' Qualifier="'), _escape_attr(m("coded.productCode.qualifier")), F.lit('"'))).otherwise("")
    coded = container(
        d, "DrugCoded",
        [leaf(d + 1, "ProductCode", m("coded.productCode.value"), qualifier), container(d + 1, "DrugDBCode", [leaf(d + 2, "Code", m("coded.drugDbCode.value")), leaf(d + 2, "Qualifier", plain(m("coded.drugDbCode.qualifier")))])],
    )
    strength = container(d, "Strength", [leaf(d + 1, t, m(f"strength.{c}")) for t, c in (("StrengthValue", "value"), ("StrengthForm", "form"), ("StrengthUnitOfMeasure", "unitOfMeasure"))])
    amount = container(d, "Quantity", [leaf(d + 1, "Value", m("quantity.value.source")), leaf(d + 1, "CodeListQualifier", m("quantity.codeListQualifier")), leaf(d + 1, "QuantityUnitOfMeasure", m("quantity.unitOfMeasure"))])

    def component(name: str) -> Column:
        f, tag = f"sig.{name}", codes.SIG_COMPONENTS[name][0]
        whole = container(d + 1, tag, [leaf(d + 2, "Code", m(f"{f}.code.value")), leaf(d + 2, "Qualifier", plain(m(f"{f}.code.qualifier"))), leaf(d + 2, "Text", m(f"{f}.text"))])
        return F.when(m(f"{f}.provenance") == "coded", whole).when(m(f"{f}.provenance") == "derived", leaf(d + 1, tag, m(f"{f}.text")))

    sig = container(d, "Sig", [leaf(d + 1, "SigText", m("sig.sigText")), *[component(k) for k in codes.SIG_COMPONENTS]], present=F.lit(True))
    return container(
        depth, "MedicationPrescribed",
        [
            leaf(d, "DrugDescription", m("description")), coded, strength, amount, leaf(d, "DaysSupply", m("daysSupply.source")), leaf(d, "Substitutions", m("substitutions")),
            leaf(d, "NumberOfRefills", m("numberOfRefills")), leaf(d, "WrittenDate", m("writtenDate")), leaf(d, "Directions", m("directions")),
            F.when(m("sig").isNotNull(), sig).otherwise(leaf(d, "SigText", m("sigText"))), leaf(d, "Note", m("note")),
        ],
    )


def with_xml(parsed: DataFrame, name: str = "xml") -> DataFrame:
    """Canonical XML of parsed or built messages: two-space indent, no declaration, absent values left out."""
    kind = F.col("kind")
    parties, medication = _parties_xml(3), _medication_xml(3)
    reference = leaf(3, "RequestReferenceNumber", F.col("requestReferenceNumber"))
    tag = F.coalesce(*[F.when(F.col("outcome") == v, k) for k, v in codes.OUTCOMES.items()])
    reasons = [leaf(5, t, F.col(f"reason.{c}")) for t, c in (("ReasonCode", "code"), ("ReferenceNumber", "referenceNumber"), ("DenialReason", "denialReason"), ("Note", "note"))]
    outcome = F.when(tag.isNotNull(), container(4, tag, reasons, present=F.lit(True)))
    answer = [leaf(3, t, F.col(f"response.{c}")) for t, c in (("Code", "code"), ("DescriptionCode", "descriptionCode"), ("Description", "description"))]
    always = F.lit(True)
    body = (
        F.when(kind == "NewRx", container(2, "NewRx", [*parties, medication], present=always))
        .when(kind.isin(*codes.LIFECYCLE_REQUESTS), container(2, kind, [reference, *parties, medication], present=always))
        .when(kind.isin(*codes.LIFECYCLE_RESPONSES), container(2, kind, [reference, container(3, "Response", [outcome], present=always), medication], present=always))
        .when(kind.isin(*codes.RESPONSE_KINDS), container(2, kind, answer, present=always))
        .otherwise(container(2, F.coalesce("transaction", F.lit("UnsupportedTransaction")), [], present=always))
    )
    lines = (("To", "to"), ("From", "from"), ("MessageID", "messageId"), ("RelatesToMessageID", "relatesToMessageId"), ("SentTime", "sentTime"), ("PrescriberOrderNumber", "prescriberOrderNumber"))
    header = container(1, "Header", [leaf(2, t, F.col(f"header.{c}")) for t, c in lines])
    stamp = F.coalesce(F.concat(F.lit(' version="'), _escape_attr(F.col("header.version")), F.lit('"')), F.lit(""))
    step = parsed.select("*", body.alias("_bodyXml"), header.alias("_headXml"))
    whole = container(0, "Message", [F.col("_headXml"), container(1, "Body", [F.col("_bodyXml")])], attrs=stamp)
    return step.withColumn(name, F.when(kind.isNotNull(), whole)).drop("_bodyXml", "_headXml")


def _build_error(code: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(codes.SCRIPT_BUILD_ERRORS[code]).alias("message"))


def _strings(column: Column, kind) -> list[Column]:
    """All strings inside a struct column."""
    if kind.typeName() == "string":
        return [column]
    if kind.typeName() == "struct":
        return [x for f in kind.fields for x in _strings(column[f.name], f.dataType)]
    return []


def _illegal(df: DataFrame, columns: Sequence[str]) -> Column:
    checks = [F.coalesce(s.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), F.lit(False)) for c in columns for s in _strings(F.col(c), df.schema[c].dataType)]
    bad = F.lit(False)
    for c in checks:
        bad = bad | c
    return bad


def build_new_rx(inputs: DataFrame) -> DataFrame:
    """NewRx messages from columns header, patient, pharmacy, prescriber, medication (structs as parsed; the first four may be null).

    Adds buildError (a blank drug description comes before illegal characters) and kind.
    """
    blank = F.coalesce(trim_blank(F.col("medication.description")), F.lit("")) == ""
    columns = ["header", "patient", "pharmacy", "prescriber", "medication"]
    return _built(inputs, F.when(blank, _build_error("MISSING_MEDICATION")).when(_illegal(inputs, columns), _build_error("INVALID_CHARACTER")), F.lit("NewRx"))


def build_response(inputs: DataFrame) -> DataFrame:
    """Status, Error and Verify messages from columns header (may be null) and response (kind, code, descriptionCode, description)."""
    blank = F.coalesce(trim_blank(F.col("response.code")), F.lit("")) == ""
    return _built(inputs, F.when(blank, _build_error("MISSING_RESPONSE_CODE")).when(_illegal(inputs, ["header", "response"]), _build_error("INVALID_CHARACTER")), F.col("response.kind"))


#: Result columns that a built message may lack, and their types.
_MODEL = {"transaction": "string", "requestReferenceNumber": "string", "outcome": "string", "reason": "struct<code:string,referenceNumber:string,denialReason:string,note:string>"}
_NAME, _IDENT = "struct<lastName:string,firstName:string,middleName:string>", "struct<" + ",".join(f"{member}:string" for member in codes.IDENTIFICATIONS) + ">"
_CODED, _DECIMAL = "struct<value:string,qualifier:string,system:string>", "struct<source:string,isValid:boolean>"
_MODEL |= {
    "patient": f"struct<name:{_NAME},gender:string,dateOfBirth:string>", "pharmacy": f"struct<businessName:string,identification:{_IDENT}>", "prescriber": f"struct<name:{_NAME},identification:{_IDENT}>",
    "medication": f"struct<description:string,coded:struct<productCode:{_CODED},drugDbCode:{_CODED}>,strength:struct<value:string,form:string,unitOfMeasure:string>,"
    f"quantity:struct<value:{_DECIMAL},unitOfMeasure:string,codeListQualifier:string>,daysSupply:{_DECIMAL},numberOfRefills:string,substitutions:string,writtenDate:string,directions:string,"
    f"sigText:string,sig:struct<sigText:string,{','.join(f'{k}:{SIG_FIELD}' for k in codes.SIG_COMPONENTS)},hasStructuredData:boolean>,note:string>",
    "response": "struct<kind:string,code:string,descriptionCode:string,description:string>",
    "header": "struct<version:string,to:string,from:string,messageId:string,relatesToMessageId:string,sentTime:string,prescriberOrderNumber:string>",
}


def _built(inputs: DataFrame, error: Column, kind: Column) -> DataFrame:
    step = inputs.select("*", error.alias("buildError"))
    missing = {k: F.lit(None).cast(t) for k, t in _MODEL.items() if k not in inputs.columns}
    return step.select("*", *[c.alias(k) for k, c in missing.items()], F.when(F.col("buildError").isNull(), kind).alias("kind"), F.array().cast(f"array<{WARNING}>").alias("warnings"))


def script_nodes(raw: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """A row for each element: key and the node's columns. Null, blank and unreadable texts, and those with a document type or an
    entity declaration, have no rows."""
    text = F.col(payload).cast("string")
    return shred_messages(raw.select(key, F.when(~text.rlike(REFUSED), text).alias(payload)), payload).select(key, F.explode("nodes").alias("n")).select(key, "n.*")


__all__ = ["NODE"] + [n for n in dir() if not n.startswith("_")]
