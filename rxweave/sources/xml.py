"""XML messages as flat nodes: a small lenient reader inside Arrow batches; all interpretation is done on columns.

Nodes are written as flat Arrow columns, not as an object each. Texts whose markup is plain (``_plain``) are read together, by the
places of their tags in the whole batch; all others, one by one, by ``read_nodes``. A reader by column expressions alone (pieces
by one regular expression, depths by running sums, texts and ends by a sort) gave the same nodes and was slower than either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.sources.tokens import offsets, strings, text_bytes

#: A document type or an entity declaration, wherever it stands: such a text is refused before it is read.
REFUSED = "(?i)<!(?:DOCTYPE|ENTITY)\\b"
NODE = "struct<id:int,parent:int,last:int,depth:int,name:string,text:string,attrs:map<string,string>>"
_NODE = pa.struct(
    [("id", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))]
)
#: One piece of markup, from its ``<`` to its end: comment, CDATA, processing instruction, end tag or start tag. Quotes in a start
#: tag may hold ``>``.
_MARK = re.compile(
    r"<(?:!--.*?-->|!\[.{6}(?P<cdata>.*?)\]\]>|\?(?P<pi>[^\s?]*)(?P<about>.*?)\?>|(?P<end>/)[^>]*>|(?!!--|!\[|[?/])(?P<start>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S
)
_ATTR = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')|[^\s=]+")


def local_name(name: str) -> str:
    return name.rpartition(":")[2]


def _attributes(text: str) -> list[tuple[str, str]]:
    """Attributes with a quoted value; others are left out, and of two with one local name the later counts."""
    return list({local_name(m[1]): m[2] or m[3] or "" for m in _ATTR.finditer(text) if m[1]}.items())


@dataclass
class Nodes:
    """The nodes of one message or of many, a list for each member; a node's id is its place in its message."""

    parent: list[int | None] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    attrs: list[list[tuple[str, str]]] = field(default_factory=list)

    def add(self, other: Nodes) -> None:
        for f in fields(self):
            getattr(self, f.name).extend(getattr(other, f.name))


def read_nodes(text: str, strict: bool = True) -> Nodes | None:
    """Nodes in document order; None if the text isn't readable as XML.

    What is readable: every piece of markup ends, there is an element, and no element, CDATA or instruction follows an end tag
    that closes nothing. An end tag closes the open element whatever name it bears, open elements end with the text,
    attributes without a quoted value are left out, text outside the elements is ignored, and only the first of several
    roots counts. An instruction other than the XML declaration is an element whose name starts with ``?``. With
    ``strict`` off the text is read as far as it is readable.

    ``last`` is the last node below. Prefixes are cut off; text is the element's own, untrimmed, with CDATA and with
    entities as they stand.
    """
    nodes = Nodes()
    names = nodes.name
    texts: list[list[str]] = []
    stack: list[int] = []  # open elements; -1 for those of later roots
    at, closed_too_often = 0, False

    def element(name: str, attrs: list[tuple[str, str]]) -> int:
        if names and (not stack or stack[-1] < 0):
            return -1
        nodes.parent.append(stack[-1] if stack else None)
        nodes.last.append(len(names))
        nodes.depth.append(len(stack))
        nodes.attrs.append(attrs)
        names.append(name)
        texts.append([])
        return len(names) - 1

    while (start := text.find("<", at)) >= 0:
        m = _MARK.match(text, start)
        if m is None or (closed_too_often and (m["start"] is not None or m["cdata"] is not None or m["pi"] is not None)):
            if strict:
                return None
            break
        if stack and stack[-1] >= 0:
            texts[stack[-1]] += [text[at:start], m["cdata"] or ""]
        at = m.end()
        if m["start"] is not None:
            inner = m["start"].strip()
            name = (inner.split(None, 1) or [""])[0]
            rest = inner[len(name) :]
            node = element(local_name(name.rstrip("/")), _attributes(rest.rstrip("/")) if "=" in rest else [])
            if not inner.endswith("/"):
                stack.append(node)
        elif m["end"]:
            if not stack:
                closed_too_often = True
            elif (n := stack.pop()) >= 0:
                nodes.last[n] = len(names) - 1
        elif m["pi"] is not None and m["pi"] != "xml":
            element("?" + local_name(m["pi"]), _attributes(m["about"]))
    for n in stack:
        if n >= 0:
            nodes.last[n] = len(names) - 1
    nodes.text = ["".join(parts) for parts in texts]
    return nodes if names else None


#: A key of the index is an element's id times KEYS and the number of a name: of its children's, or from DEEP on of those at any depth.
KEYS, DEEP = 512, 256
#: A text whose elements are deeper is read on its own.
_DEPTH = 64
_KINDS = _OPEN, _EMPTY, _END, _SKIP = range(4)


class _Lookups:
    """The names by which columns look nodes up: an element's first child of a name, and the first below it, itself included."""

    def __init__(self, children: Sequence[str], deep: Sequence[str]) -> None:
        if len(children) > DEEP or len(deep) > KEYS - DEEP:
            raise ValueError("too many names")
        self.children = {name: n for n, name in enumerate(children)}
        self.deep = {name: DEEP + n for n, name in enumerate(deep)}

    def of(self, nodes: Nodes) -> list[tuple[int, int]]:
        """Key and place of every first. Work grows with the nodes: who has a key of a name has told all above."""
        found: dict[int, int] = {}
        for n, (name, up) in enumerate(zip(nodes.name, nodes.parent, strict=True)):
            if up is not None and (code := self.children.get(name)) is not None:
                found.setdefault(up * KEYS + code, n)
            if (code := self.deep.get(name)) is not None:
                up = n
                while up is not None and (key := up * KEYS + code) not in found:
                    found[key] = n
                    up = nodes.parent[up]
        return list(found.items())

    def of_all(self, names: pa.Array, parent: np.ndarray, firsts: np.ndarray, whose: np.ndarray) -> pa.Array:
        """The same for the nodes of many messages, by their places in the batch; ``parent`` is -1 for a root."""
        encoded = names.dictionary_encode()
        words, at = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)
        code = lambda table: np.array([*(table.get(w, -1) for w in words), -1])[at]
        child, deep = code(self.children), code(self.deep)
        n = np.flatnonzero((child >= 0) & (parent >= 0))
        keys, found = [parent[n] * KEYS + child[n]], [n]
        n = up = np.flatnonzero(deep >= 0)
        while len(n):
            keys.append(up * KEYS + deep[n])
            found.append(n)
            up = parent[up]
            n, up = n[up >= 0], up[up >= 0]
        key, n = np.concatenate(keys), np.concatenate(found)
        order = np.lexsort((n, key))
        key, n = key[order], n[order]
        is_first = np.append(True, key[1:] != key[:-1])[: len(key)]
        key, n = key[is_first], n[is_first]
        message = whose[n]
        sizes = np.bincount(message, minlength=len(firsts))
        return pa.MapArray.from_arrays(offsets(sizes), pa.array(key - firsts[message] * KEYS), pa.array((n - firsts[message]).astype(np.int32)))


_MAP = pa.map_(pa.int64(), pa.int32())


def _array(found: list[Nodes | None]) -> pa.Array:
    every = Nodes()
    for nodes in found:
        if nodes is not None:
            every.add(nodes)
    sizes = np.array([0 if nodes is None else len(nodes.name) for nodes in found], np.int64)
    ids = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0)]).astype(np.int32)
    columns = [pa.array(x, pa.int32()) for x in (ids, every.parent, every.last, every.depth)] + [pa.array(x, pa.string()) for x in (every.name, every.text)]
    return _lists(sizes, np.array([nodes is None for nodes in found], bool), columns, [len(a) for a in every.attrs], [p for attrs in every.attrs for p in attrs])


def _lists(sizes: np.ndarray, nulls: np.ndarray, columns: list[pa.Array], n_attrs: Sequence[int], pairs: list[tuple[str, str]]) -> pa.Array:
    maps = pa.MapArray.from_arrays(offsets(np.asarray(n_attrs, np.int64)), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string()))
    return pa.ListArray.from_arrays(offsets(sizes, nulls), pa.StructArray.from_arrays([*columns, maps], fields=list(_NODE)))


def _rich(tag: bytes) -> tuple[str, list[tuple[str, str]], bool] | None:
    """Name, attributes and whether it is empty, of a start tag with more than a name; None if it doesn't end where it seems to."""
    text = tag.decode()
    m = _MARK.fullmatch(text)
    if m is None or m["start"] is None:
        return None
    inner = m["start"].strip()
    name = (inner.split(None, 1) or [""])[0]
    rest = inner[len(name) :]
    return local_name(name.rstrip("/")), _attributes(rest.rstrip("/")) if "=" in rest else [], inner.endswith("/")


def _marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which texts are plain, and the marks of these: message, first byte, last byte, kind, depth before, place among ``told``; and
    ``told``, what ``_rich`` says of tags with more than a name.

    Plain is a text of one root whose elements all end, where < and > take turns, and whose marks are tags, comments and the XML
    declaration.
    """
    n = len(at) - 1
    low, high = np.flatnonzero(data == ord("<")), np.flatnonzero(data == ord(">"))
    n_low, n_high = np.diff(np.searchsorted(low, at)), np.diff(np.searchsorted(high, at))
    fine = (n_low == n_high) & (n_low > 0)
    low, high = low[np.repeat(fine, n_low)], high[np.repeat(fine, n_high)]
    whose = np.repeat(np.arange(n), np.where(fine, n_low, 0))
    same = np.append(whose[1:] == whose[:-1], False) if len(whose) else np.zeros(0, bool)
    bad = (low >= high) | (same & (high >= np.append(low[1:], 0)))
    fine[whose[bad]] = False
    keep = fine[whose]
    low, high, whose = low[keep], high[keep], whose[keep]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    is_ = lambda places, c: padded[places] == ord(c)
    comment = is_(low + 1, "!") & is_(low + 2, "-") & is_(low + 3, "-") & is_(high - 1, "-") & is_(high - 2, "-") & (high - low >= 6)
    declared = is_(low + 1, "?") & is_(low + 2, "x") & is_(low + 3, "m") & is_(low + 4, "l") & (is_(low + 5, " ") | is_(low + 5, "?")) & is_(high - 1, "?")
    kind = np.where(comment | declared, _SKIP, np.where(is_(low + 1, "/"), _END, np.where(is_(high - 1, "/"), _EMPTY, _OPEN)))
    starts = kind <= _EMPTY
    bad = starts & (is_(low + 1, "!") | is_(low + 1, "?") | (padded[low + 1] <= 32) | (high - low < 2) | ((kind == _EMPTY) & (high - low < 3)))
    special = np.isin(data, np.frombuffer(bytes(range(33)) + b"=:/'\"" + bytes(range(128, 256)), np.uint8))
    n_special = np.concatenate([[0], np.cumsum(special)])
    rich = np.flatnonzero(starts & ~bad & (n_special[high - (kind == _EMPTY)] > n_special[low + 1]))
    told: list = []
    seen: dict[bytes, int] = {}
    place = np.full(len(low), -1)
    whole = data.tobytes()
    for j, a, b in zip(rich.tolist(), low[rich].tolist(), high[rich].tolist(), strict=True):
        tag = whole[a : b + 1]
        k = seen.get(tag)
        if k is None:
            k = seen[tag] = len(told)
            told.append(_rich(tag) if tag.isascii() else None)
        place[j] = k
        if told[k] is None:
            bad[j] = True
        else:
            kind[j] = _EMPTY if told[k][2] else _OPEN
    fine[whose[bad]] = False
    change = np.array([1, 0, -1, 0])[kind]
    total = np.cumsum(change)
    first = np.append(True, whose[1:] != whose[:-1])[: len(whose)]
    base = (total - change)[first][np.cumsum(first) - 1] if len(whose) else total
    depth = total - change - base
    fine[whose[(depth < 0) | (depth > _DEPTH) | (depth + change < 0)]] = False
    last = np.append(first[1:], True)[: len(whose)]
    fine[whose[last & (depth + change != 0)]] = False
    fine &= np.bincount(whose[(kind <= _EMPTY) & (depth == 0)], minlength=n) == 1
    keep = fine[whose]
    return fine, *(x[keep] for x in (whose, low, high, kind, depth, place)), told


def _plain(data: np.ndarray, whose: np.ndarray, low: np.ndarray, high: np.ndarray, kind: np.ndarray, depth: np.ndarray, place: np.ndarray, told: list, n: int, lookups: _Lookups | None) -> tuple[pa.Array, pa.Array | None]:
    """Nodes, and their index, of the plain texts among ``n`` by their marks; the other texts have none."""
    is_node = kind <= _EMPTY
    node_of = np.cumsum(is_node) - 1  # the last node up to a mark
    after = depth + np.array([1, 0, -1, 0])[kind]
    inside = np.full(len(kind), -1)  # the element that is open after a mark
    opens = np.flatnonzero(kind == _OPEN)
    for level in range(int(after.max(initial=0))):
        ours, theirs = np.flatnonzero(after == level + 1), opens[depth[opens] == level]
        inside[ours] = node_of[theirs[np.searchsorted(theirs, ours, side="right") - 1]]
    before = np.append(-1, inside[:-1])[: len(inside)]
    before[depth == 0] = -1
    parent = before[is_node]
    count = len(parent)
    last = np.arange(count)
    ends = kind == _END
    last[before[ends]] = node_of[ends]
    node_whose = whose[is_node]
    sizes = np.bincount(node_whose, minlength=n)
    firsts = np.cumsum(sizes) - sizes
    shift = firsts[node_whose]

    # texts: what stands between two marks belongs to the element that is open there
    a, b = high[:-1] + 1, low[1:]
    some = np.flatnonzero((whose[1:] == whose[:-1]) & (b > a) & (inside[:-1] >= 0))
    some = some[np.argsort(inside[:-1][some], kind="stable")]
    lengths = b[some] - a[some]
    where = np.repeat(a[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    sizes_of_texts = np.bincount(inside[:-1][some], weights=lengths, minlength=count).astype(np.int64)
    texts = pa.StringArray.from_buffers(count, offsets(sizes_of_texts).buffers()[1], pa.py_buffer(data[where]))

    place, low, high, kind = place[is_node], low[is_node], high[is_node], kind[is_node]
    is_rich = place >= 0
    names = strings(data, low + 1, np.where(is_rich, low + 1, high - (kind == _EMPTY)))
    n_attrs, pairs = np.zeros(count, np.int64), []
    if is_rich.any():
        rich = place[is_rich]
        names = pc.replace_with_mask(names, pa.array(is_rich), pa.array([None if t is None else t[0] for t in told], pa.string()).take(pa.array(rich)))
        n_attrs[is_rich] = np.array([0 if t is None else len(t[1]) for t in told])[rich]
        pairs = [p for k in rich.tolist() for p in told[k][1]]
    up = pa.array((parent - shift).astype(np.int32), mask=parent < 0)
    columns = [pa.array((np.arange(count) - shift).astype(np.int32)), up, pa.array((last - shift).astype(np.int32)), pa.array(depth[is_node].astype(np.int32)), names, texts]
    return _lists(sizes, np.zeros(n, bool), columns, n_attrs, pairs), None if lookups is None else lookups.of_all(names, parent, firsts, node_whose)


def shred(texts: pa.StringArray, strict: bool = True, lookups: _Lookups | None = None) -> list[pa.Array]:
    """The nodes of each text, and their index if there are ``lookups``; null where a text isn't readable."""
    data, at = text_bytes(texts)
    fine, *marks, told = _marks(data, at)
    nodes, index = _plain(data, *marks, told, len(texts), lookups)
    if not fine.all():
        others = np.flatnonzero(~fine)
        found = [None if t is None else read_nodes(t, strict) for t in texts.take(pa.array(others)).to_pylist()]
        order = np.arange(len(texts))
        order[others] = len(texts) + np.arange(len(others))
        nodes = pa.concat_arrays([nodes, _array(found)]).take(pa.array(order))
        if lookups is not None:
            index = pa.concat_arrays([index, pa.array([None if f is None else lookups.of(f) for f in found], _MAP)]).take(pa.array(order))
    return [nodes] if lookups is None else [nodes, index]


def shred_messages(raw: DataFrame, payload: str = "payload", name: str = "nodes", *, strict: bool = True, index: str | None = None, children: Sequence[str] = (), deep: Sequence[str] = ()) -> DataFrame:
    """Add array column ``name`` of nodes, and map column ``index`` if it is named (see ``KEYS``); null where the payload isn't
    readable. Other columns pass through."""
    lookups = _Lookups(children, deep) if index else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0), *shred(batch.column(batch.num_columns - 1), strict, lookups)]
            yield pa.RecordBatch.from_arrays(columns, names=["rest", "nodes", "index"][: len(columns)])

    rows = raw.select(F.struct("*").alias("rest"), F.col(payload).alias("text"))
    kind = f"rest {rows.schema['rest'].dataType.simpleString()}, nodes array<{NODE}>" + (", index map<bigint,int>" if index else "")
    done = rows.mapInArrow(run, kind)
    return done.select("rest.*", F.col("nodes").alias(name), *([F.col("index").alias(index)] if index else []))


class ScriptNodes:
    """The rows of ``script_nodes(payload)``: a node each, as ``read_nodes`` has them; none for a text that is refused."""

    refused = re.compile(REFUSED)

    def eval(self, payload: str | None) -> Iterator[tuple]:
        nodes = None if payload is None or self.refused.search(payload) else read_nodes(payload)
        if nodes is not None:
            for n, (parent, last, depth, name, text, attrs) in enumerate(zip(nodes.parent, nodes.last, nodes.depth, nodes.name, nodes.text, nodes.attrs, strict=True)):
                yield n, parent, last, depth, name, text, dict(attrs)


def register(spark: SparkSession) -> None:
    """The session's table function ``script_nodes(payload)``: id, parent, last, depth, name, text, attrs of each node.

    It is for use in a LATERAL join, which takes no Arrow functions, so rows pass to Python one by one: for large tables
    ``prescriptions.script_nodes`` gives the same rows by Arrow batches. Null, blank, refused and unreadable texts have no rows.
    """
    spark.udtf.register("script_nodes", F.udtf(ScriptNodes, returnType=NODE, useArrow=False))
