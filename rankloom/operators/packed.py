"""Several values packed in one field: one row for each value, in order of writing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Opening and closing quotes.  A quote that closes with itself can be escaped by doubling.
QUOTES = (
    ('"', '"'), ("'", "'"), ("`", "`"), ("＂", "＂"), ("“", "”"), ("‘", "’"), ("„", "“"), ("「", "」"), ("『", "』"),
    ("«", "»"), ("‹", "›"), ("《", "》"), ("〝", "〞"),
)
#: Words that stand for no value in a JSON or list literal.
NO_VALUES = ("null", "true", "false", "None", "True", "False")

_BARE = np.zeros(128, bool)
_BARE[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ:._/#-"]] = True
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_COLON, _BACKSLASH = ord(":"), ord("\\")


def _after(sorted_positions: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """First position >= at, or -1 if there is none before end."""
    if not len(sorted_positions):
        return np.full(len(at), -1, np.int64)
    i = np.searchsorted(sorted_positions, at)
    p = sorted_positions[np.minimum(i, len(sorted_positions) - 1)]
    return np.where((i < len(sorted_positions)) & (p < end), p, -1)


def _runs(mask: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values; a run doesn't cross a border (the first character of a row)."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[borders[borders < n]] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False]))
    next_first = np.concatenate((first[1:n], [True]))
    starts = np.flatnonzero(mask & (~before | first[:n]))
    return starts, np.flatnonzero(mask & (~after | next_first)) + 1


def _quoted(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the opening and closing quotes of all quoted values.

    The masks of quotes are made once over all characters.  Where a quote closes depends on where it opened, so the
    values are matched by their ordinal: the first of every row at once, then the second of every row, and so on.
    """
    codes = {ord(c) for pair in QUOTES for c in pair}
    special = np.flatnonzero(np.isin(cp, np.fromiter(codes, np.uint32)))
    slashes = np.flatnonzero(cp == _BACKSLASH)
    if len(slashes) and len(special):  # a quote behind an odd number of backslashes is no quote
        s0, s1 = _runs(cp == _BACKSLASH, begin)
        i = np.searchsorted(s1, special)
        i = np.minimum(i, len(s1) - 1)
        escaped = (s1[i] == special) & ((s1[i] - s0[i]) % 2 == 1) & ~np.isin(special, begin)  # not by the row before
        special = special[~escaped]
    kinds = cp[special]
    opens, closers = {}, {}
    for o, c in QUOTES:
        o, c = ord(o), ord(c)
        at = special[kinds == o]
        opens[o] = at
        if o == c:
            mask = np.zeros(len(cp), bool)
            mask[at] = True
            s, e = _runs(mask, begin)
            odd = (e - s) % 2 == 1
            closers[o] = (c, s, e, s[odd], e[odd])
        else:
            closers[o] = (c, special[kinds == c])
    starts = np.sort(np.concatenate(list(opens.values()))) if len(special) else special
    got_open, got_close = [], []
    cur, stop = begin.copy(), end
    active = np.flatnonzero(begin < end)
    while len(active) and len(starts):
        at = _after(starts, cur[active], stop[active])
        active, at = active[at >= 0], at[at >= 0]
        close = np.full(len(at), -1, np.int64)
        for o, how in closers.items():
            m = np.flatnonzero(cp[at] == o)
            if not len(m):
                continue
            a, z = at[m], stop[active[m]]
            if len(how) == 2:
                close[m] = _after(how[1], a + 1, z)
            else:
                _, _, e, odd_s, odd_e = how
                own_end = e[np.searchsorted(e, a, side="right")]
                rest_odd = (own_end - (a + 1)) % 2 == 1
                nxt = np.searchsorted(odd_s, own_end)
                found = nxt < len(odd_s)
                later = np.where(found, odd_e[np.minimum(nxt, len(odd_e) - 1)] - 1 if len(odd_e) else -1, -1)
                later = np.where(later < z, later, -1)
                close[m] = np.where(rest_odd, own_end - 1, later)
        ok = close >= 0
        got_open.append(at[ok])
        got_close.append(close[ok])
        cur[active] = np.where(ok, close, at) + 1
    none = np.zeros(0, np.int64)
    a = np.concatenate(got_open) if got_open else none
    z = np.concatenate(got_close) if got_close else none
    order = np.argsort(a, kind="stable")
    return a[order], z[order]


def _undo(s: str, quote: str, in_json: bool) -> str:
    """The value behind a quoted string that holds escapes or doubled quotes."""
    if in_json and "\\" in s:
        if quote == '"':
            try:
                return json.loads(f'"{s}"', strict=False)
            except ValueError:
                pass
        else:
            try:
                return json.loads('"' + s.replace("\\'", "'").replace('"', '\\"') + '"', strict=False)
            except ValueError:
                pass
    return s.replace("\\" + quote, quote).replace(quote * 2, quote)


def parse_packed(values: pa.Array) -> pa.Array:
    """List array of the values held by each string; a null string gives an empty list.

    Outside quotes, runs of ASCII letters, digits and ``: . _ / # -`` are values and all else separates them.  What
    stands in a pair of quotes of any kind is one value without its quotes, escaped or doubled quotes undone.  In a
    row that is JSON (or a list literal), object keys, null and booleans are no values, and numbers count as written.
    Empty values don't count, repeated ones stay.  A quote without its partner separates like other punctuation.
    """
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_string()), "")
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1] if n else np.zeros(1, np.int64)
    data = values.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    lead = (raw & 0xC0) != 0x80  # the first byte of each character
    byte_at = np.append(np.flatnonzero(lead), len(raw))
    chars = np.concatenate(([0], np.cumsum(lead)))[offsets]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begin, end = chars[:-1].astype(np.int64), chars[1:].astype(np.int64)

    opened, closed = _quoted(cp, begin, end)
    depth = np.zeros(len(cp) + 1, np.int8)
    depth[opened] += 1
    depth[closed + 1] -= 1
    inside = np.cumsum(depth[:-1]) > 0  # the parity of quotes, the quotes themselves included
    ascii_ = cp < 128
    small = np.where(ascii_, cp, 0)
    space = ascii_ & _SPACE[small]

    solid = np.flatnonzero(~space)
    head = _after(solid, begin, end)
    is_json = np.zeros(n, bool)
    some = head >= 0
    is_json[some] = np.isin(cp[head[some]], [ord("["), ord("{")])

    row_of = np.searchsorted(end, opened, side="right")
    after = _after(solid, closed + 1, end[row_of]) if len(opened) else closed
    key = is_json[row_of] & (after >= 0)
    key[key] = cp[after[key]] == _COLON
    bare = ascii_ & _BARE[small] & ~inside
    bare[after[key]] = False  # the colon behind a key

    s, e = _runs(bare, begin)
    r = np.searchsorted(end, s, side="right")
    a, z = np.concatenate((s, opened[~key] + 1)), np.concatenate((e, closed[~key]))
    row = np.concatenate((r, row_of[~key]))
    in_quotes = np.concatenate((np.zeros(len(s), bool), np.ones(int((~key).sum()), bool)))
    order = np.argsort(a, kind="stable")
    order = order[z[order] > a[order]]
    a, z, row, in_quotes = a[order], z[order], row[order], in_quotes[order]

    b0, b1 = byte_at[a], byte_at[z]
    size = b1 - b0
    child = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    pick = np.repeat(b0 - child[:-1], size) + np.arange(child[-1])
    items = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(child.tobytes()), pa.py_buffer(raw[pick].tobytes()))

    marks = np.concatenate(([0], np.cumsum((cp == _BACKSLASH) | np.isin(cp, [ord(o) for o, c in QUOTES if o == c]))))
    todo = np.flatnonzero(in_quotes & (marks[z] > marks[a]))
    if len(todo):
        mask = np.zeros(len(a), bool)
        mask[todo] = True
        undone = [_undo(items[int(i)].as_py(), chr(cp[a[i] - 1]), bool(is_json[row[i]])) for i in todo]
        items = pc.replace_with_mask(items, pa.array(mask), pa.array(undone, pa.large_string()))
    plain = ~in_quotes & is_json[row]
    if plain.any():
        keep = ~(plain & pc.is_in(items, pa.array(NO_VALUES, pa.large_string())).to_numpy(zero_copy_only=False))
        items, row = items.filter(pa.array(keep)), row[keep]
    counts = np.bincount(row, minlength=n)
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64()), items)


def unpack(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    """(*keep, pos from 1, item): one row for each value packed in ``value``, see parse_packed.

    Null, empty and blank strings give no row; repeated rows and ids stand as they are.  Columns other than ``keep``
    don't reach Python.  There is no shuffle.
    """
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = parse_packed(batch.column(len(keep)))
            parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            first = lists.offsets.to_numpy()[parent] if len(parent) else parent
            pos = np.arange(len(parent)) - first + 1
            columns = [batch.column(i).take(pa.array(parent, pa.int64())) for i in range(len(keep))]
            columns += [pa.array(pos, pa.int32()), lists.flatten().cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "pos", "item"])

    return df.where(F.col(value).isNotNull()).select(*keep, value).mapInArrow(run, schema)
