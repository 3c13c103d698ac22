"""Claim bodies as segments and fields: places of separators over whole Arrow batches, without a loop over messages or tokens.

All interpretation is done on columns; here a text is only cut, and its pieces are named by two fixed tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave import codes

FIELD = "struct<id:string,value:string,name:string,byteOffset:int>"
SEGMENT = f"struct<segmentId:string,name:string,byteOffset:int,fields:array<{FIELD}>>"
_FIELD = pa.struct([("id", pa.string()), ("value", pa.string()), ("name", pa.string()), ("byteOffset", pa.int32())])
_SEGMENT = pa.struct([("segmentId", pa.string()), ("name", pa.string()), ("byteOffset", pa.int32()), ("fields", pa.list_(_FIELD))])
_FS, _GS, _RS = (ord(c) for c in (codes.FS, codes.GS, codes.RS))


class _Names:
    """Labels by the two bytes of a code."""

    def __init__(self, table: dict[str, str]) -> None:
        self.labels = pa.array([*table.values(), None], pa.string())
        self.places = np.full(1 << 16, len(table), np.int32)
        for n, code in enumerate(table):
            self.places[ord(code[0]) << 8 | ord(code[1])] = n

    def of(self, data: np.ndarray, starts: np.ndarray, are_codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(labels of the codes at these places, which of them are in the table)."""
        found = np.full(len(starts), len(self.labels) - 1, np.int32)
        at = starts[are_codes]
        found[are_codes] = self.places[data[at].astype(np.int32) << 8 | data[at + 1]]
        return self.labels.take(pa.array(found)), found < len(self.labels) - 1


_FIELD_NAMES, _SEGMENT_NAMES = _Names(codes.FIELD_NAMES), _Names(codes.SEGMENT_NAMES)


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends); a null has none."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of ``data`` from ``starts`` to ``ends``, which are in order and don't overlap."""
    full = ends > starts
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[full]] += 1
    edges[ends[full]] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(np.bool_)
    return pa.StringArray.from_buffers(len(starts), offsets(ends - starts).buffers()[1], pa.py_buffer(data[inside]))


def offsets(sizes: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """Where each list begins; null for a list that is null."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.array(at, mask=None if nulls is None or not nulls.any() else np.append(nulls, False))


def cut(bodies: pa.StringArray, bases: np.ndarray, names: bool = True) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(segments of each body's first group, place of its second group or null, whether a segment or token is odd).

    Groups, segments and tokens without a byte are left out. A null body has null segments. Places count characters from
    ``bases``. Odd is a segment without an id or outside the table, or a token too short for an id. Without ``names`` those of the
    fields are null.
    """
    data, at = text_bytes(bodies)
    n, starts, ends = len(bodies), at[:-1], at[1:]
    nulls = bodies.is_null().to_numpy(zero_copy_only=False)
    plain = len(data) == 0 or data.max() < 128
    before = None if plain else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before a byte
    leads = None if plain else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    chars = (lambda x: x) if plain else (lambda x: before[x])
    shift = bases - chars(starts)

    # groups: from the first byte that isn't a separator to the next one that is
    gs = np.flatnonzero(data == _GS)
    runs = np.append(gs[np.append(np.diff(gs) != 1, True)] if len(gs) else gs, len(data))  # where runs of them end
    gs = np.append(gs, len(data))
    after = lambda x, is_gs: np.where(is_gs, runs[np.searchsorted(runs, x)] + 1, x)
    padded = np.append(data, 0)
    first = np.minimum(after(starts, padded[starts] == _GS), ends)
    stop = np.minimum(gs[np.searchsorted(gs, first)], ends)
    next_one = np.where(stop < ends, after(stop, stop < ends), ends)
    has_next = next_one < ends
    second = pa.array((chars(np.minimum(next_one, len(data))) + shift).astype(np.int32), mask=~has_next)

    # tokens: between separators of either kind; one is the first of its segment at the group's start and after RS
    some = np.flatnonzero(stop > first)
    seps = np.flatnonzero((data == _FS) | (data == _RS))
    low, high = np.searchsorted(seps, first[some]), np.searchsorted(seps, stop[some])
    counts = high - low
    inside = seps[np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())] if len(some) else seps[:0]
    heads = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int64)
    t0, t1 = np.empty(heads[-1], np.int64), np.empty(heads[-1], np.int64)
    is_head = np.zeros(heads[-1], bool)
    is_head[heads[:-1]] = True
    is_last = np.roll(is_head, -1)
    t0[is_head], t0[~is_head], t1[is_last], t1[~is_last] = first[some], inside + 1, stop[some], inside
    opens = is_head.copy()
    opens[~is_head] = data[inside] == _RS
    part = np.cumsum(opens) - 1
    p0, p1 = t0[opens], t1[np.roll(opens, -1)]
    whose = np.repeat(some, counts + 1)  # the message of each token
    full_part, full = p1 > p0, t1 > t0
    message, p0 = whose[opens][full_part], p0[full_part]
    part = (np.cumsum(full_part) - 1)[part][full]
    t0, t1, whose = t0[full], t1[full], whose[full]

    # a segment's id is its first token, if that is AM and two characters
    lengths = chars(t1) - chars(t0)
    leading = np.append(True, part[1:] != part[:-1]) if len(part) else np.zeros(0, bool)
    named = leading & (lengths == 2 + codes.SEGMENT_ID_LENGTH) & (padded[t0] == ord("A")) & (padded[np.minimum(t0 + 1, len(data))] == ord("M"))
    n_parts = len(p0)
    ids0, ids1, has_id = p0.copy(), p0.copy(), np.zeros(n_parts, bool)
    ids0[part[named]], ids1[part[named]], has_id[part[named]] = t0[named] + 2, t1[named], True
    part_names, is_known = _SEGMENT_NAMES.of(data, ids0, has_id & (ids1 - ids0 == 2))
    f0, f1, part, whose, lengths = (x[~named] for x in (t0, t1, part, whose, lengths))
    short = lengths < 2
    middle = np.where(short, f0, f0 + 2 if plain else leads[np.minimum(before[f0] + 2, len(leads) - 1)])
    middle = np.minimum(middle, f1)
    field_names = _FIELD_NAMES.of(data, f0, ~short & (middle - f0 == 2))[0] if names else pa.nulls(len(f0), pa.string())
    place = lambda x, of: pa.array((chars(x) + shift[of]).astype(np.int32))
    fields = pa.StructArray.from_arrays([strings(data, f0, middle), strings(data, middle, f1), field_names, place(f0, whose)], fields=list(_FIELD))
    lists = pa.ListArray.from_arrays(offsets(np.bincount(part, minlength=n_parts)), fields)
    parts = pa.StructArray.from_arrays([strings(data, ids0, ids1), part_names, place(p0, message), lists], fields=list(_SEGMENT))
    odd = np.zeros(n, bool)
    odd[message[~is_known]] = True
    odd[whose[short]] = True
    return pa.ListArray.from_arrays(offsets(np.bincount(message, minlength=n), nulls), parts), second, pa.array(odd)


def cut_messages(raw: DataFrame, body: str, base: str, names: bool = True) -> DataFrame:
    """The other columns of ``raw`` and segments, second, odd (see ``cut``) of the text ``body``, whose places begin at ``base``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, text, place = batch.columns
            yield pa.RecordBatch.from_arrays([rest, *cut(text, place.fill_null(0).to_numpy(), names)], names=["rest", "segments", "second", "odd"])

    others = [c for c in raw.columns if c not in (body, base)]
    rows = raw.select(F.struct(*others).alias("rest"), F.col(body).alias("text"), F.col(base).alias("base"))
    done = rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, segments array<{SEGMENT}>, second int, odd boolean")
    return done.select("rest.*", "segments", "second", "odd")
