"""Cutting of claims against a plain reading of each text, and what a query that needs less leaves out."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rxweave import codes
from rxweave.operators import claims as C
from rxweave.sources.tokens import cut

FS, GS, RS = codes.FS, codes.GS, codes.RS
HEAD = "610014D0B1PCN       1" + "01" + "1234567890     " + "20240101" + "VENDOR    "


def parts(text, separator, base):
    at, found = base, []
    for part in text.split(separator):
        if part:
            found.append((part, at))
        at += len(part) + 1
    return found


def plainly(text, base):
    groups = parts(text, GS, base)
    segments = []
    for segment, at in parts(*([groups[0][0], RS, groups[0][1]] if groups else ["", RS, 0])):
        fields = [dict(id=t[:2], value=t[2:], name=codes.FIELD_NAMES.get(t[:2]), byteOffset=p) if len(t) > 1 else dict(id="", value=t, name=None, byteOffset=p) for t, p in parts(segment, FS, at)]
        named = bool(fields) and fields[0]["id"] == "AM" and len(fields[0]["value"]) == 2
        code = fields[0]["value"] if named else ""
        segments.append(dict(segmentId=code, name=codes.SEGMENT_NAMES.get(code), byteOffset=at, fields=fields[named:]))
    return segments, groups[1][1] if len(groups) > 1 else None, any(s["name"] is None or any(f["id"] == "" for f in s["fields"]) for s in segments)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cutting_is_a_plain_reading(seed):
    pick = random.Random(seed)
    pieces = [FS, GS, RS, FS, RS, "AM", "AM05", "AM21", "AM99", "AM0", "AM漢字", "E4DD", "FB", "Z", "é", "éa", "漢字x", " "]
    texts = [None if pick.random() < 0.05 else "".join(pick.choice(pieces[: 14 if seed == 1 else None]) for _ in range(pick.randrange(30))) for _ in range(2_000)]
    bases = np.array([pick.randrange(99) for _ in texts])
    array = pa.array(["skipped", *texts], pa.string()).slice(1)
    segments, second, odd = (x.to_pylist() for x in cut(array, bases))
    want = [([], None, False) if t is None else plainly(t, int(b)) for t, b in zip(texts, bases, strict=True)]
    assert segments == [None if t is None else w[0] for t, w in zip(texts, want, strict=True)]
    assert second == [w[1] for w in want] and odd == [w[2] for w in want]
    assert cut(pa.array([], pa.string()), np.zeros(0))[0].to_pylist() == []


def test_only_what_is_wanted_is_worked_out(spark):
    texts = spark.createDataFrame([(1, HEAD + RS + "AM04" + FS + "C2X")], "i int, payload string")
    heads = C.parse_claims(texts, only=("header",))
    assert heads.columns == ["i", "header", "fatal"] and heads.first().header == C.parse_claims(texts).first().header
    assert "MapInArrow" not in heads._jdf.queryExecution().toString()  # noqa: SLF001
    assert "lambda" not in C.parse_claims(texts, only=("header", "segments"))._jdf.queryExecution().toString()  # noqa: SLF001
    bare = C.parse_claims(texts, names=False).first()
    assert bare.segments[0].fields[0].name is None and bare.segments[0].name == "Insurance"
    with pytest.raises(ValueError, match="no such results"):
        C.parse_claims(texts, only=("heads",))


def test_texts_of_plain_markup_are_read_as_all_others():
    from rxweave.sources import xml

    lookups = xml._Lookups(codes.CHILD_ELEMENTS, codes.DEEP_ELEMENTS)  # noqa: SLF001
    pick = random.Random(7)
    pieces = ["<a>", "</a>", "<Name>", "</Name>", "<Sig/>", "<c d='1'>", '<m:Name x="y>z">', "<x / >", "t", "é", "<!-- n -->", "<!--->", "<?xml version='1'?>", "<?pi a?>", "<![CDATA[q]]>", "<", ">", "< q>", "<é>", "<a'>"]

    def tree(depth):
        name = pick.choice(["a", "Name", "m:Sig", "Code", "Body a='1'", "Text", "Date "])
        inner = "".join(pick.choice(["", "t", "é", " <!-- c -->x"]) + tree(depth + 1) for _ in range(pick.randrange(4) if depth < 5 else 0))
        return f"<{name}>{inner}tail</{name.split()[0]}>"

    texts = [None, "", "<a>" * 99 + "</a>" * 99, *("".join(pick.choice(pieces) for _ in range(pick.randrange(12))) for _ in range(3_000)), *(tree(0) for _ in range(500))]
    for strict in (True, False):
        nodes, index = xml.shred(pa.array(["skipped", *texts]).slice(1), strict, lookups)
        plainly = [None if t is None else xml.read_nodes(t, strict) for t in texts]
        assert nodes.to_pylist() == xml._array(plainly).to_pylist()  # noqa: SLF001
        assert [None if x is None else dict(x) for x in index.to_pylist()] == [None if n is None else dict(lookups.of(n)) for n in plainly]
    assert xml._marks(*xml.text_bytes(pa.array(texts[-500:])))[0].all()  # noqa: SLF001


def test_a_scan_reads_its_texts_once_for_each_format(spark):
    from rxweave.operators import scan

    texts = spark.createDataFrame([("a", "AM01\x1cCAJo Doe\x1cC419800102\x1cCQ(212) 867-5309"), ("b", "<p><LastName>Roe 王</LastName><SSN>123-45-6789</SSN></p>")], "path string, text string")
    allow = scan.allow_rows(spark.createDataFrame([("name", "Doe")], "kind string, value string"))
    hits = scan.scan_texts(texts, allow)
    assert sorted((r.path, r.category, r.value) for r in hits.collect()) == [("a", "dob", "19800102"), ("a", "name", "Jo"), ("a", "phone", "(212) 867-5309"), ("b", "name", "Roe"), ("b", "name", "王"), ("b", "ssn", "123-45-6789")]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # noqa: SLF001


def test_first_descendants_read_their_nodes_once(spark):
    from rxweave.operators import longform
    from rxweave.operators import prescriptions as P

    nodes = P.script_nodes(spark.createDataFrame([(1, "<a>x<b>y</b><b>z</b></a>")], "k int, payload string"), "k")
    found = longform.first_descendants(nodes, spark.createDataFrame([("a", "b"), ("a", "a")], "ancestor string, descendant string"), "k", ["text"])
    assert sorted((r.descendant, r.found, r.text) for r in found.collect()) == [("a", 0, "x"), ("b", 1, "y")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # noqa: SLF001
