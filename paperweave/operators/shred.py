"""Deeply nested records to related flat tables.

Each record is read once by a streaming scanner that emits path-value-ordinal triples; triples are grouped by their
nearest repeated ancestor and each group is pivoted into one table row that carries the ordinals of all its ancestors,
so every child leads to its parent and place. A record's triples never leave its task: there is no shuffle, and memory
is that of one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<p>[{}\[\],:])|"(?P<s>[^"\\\x00-\x1f]*)"|"(?P<e>(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"'
    r"|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<w>true|false|null))"
)
_ESCAPE = re.compile(r'\\(?:u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(["\\/bfnrt]))')
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _char(m: re.Match) -> str:
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) - 0xD800) << 10) + (int(m[2], 16) - 0xDC00))
    if m[3]:
        return chr(int(m[3], 16))
    return _SHORT.get(m[4], m[4])


class Invalid(ValueError):
    """The text isn't one JSON value."""


def triples(text: str) -> list[tuple[tuple[str, ...], tuple[int, ...], str | None]]:
    """Path, ordinals and value of each scalar of one JSON text, in one pass over its tokens.

    A path names object keys, with ``[]`` for a list level; the ordinals are the places, counted from 0, at the path's
    list levels. Scalars keep their spelling (a string its characters). A null is a triple without value; an empty
    object or list gives none. Where a key is repeated in an object the last one holds. Raises ``Invalid`` otherwise.
    """
    out: list = []
    stack: list = []  # of [kind, keys seen or None, first triple of this container]
    path: list[str] = []
    places: list[int] = []
    pos, end, want = 0, len(text), "value"
    match = _TOKEN.match
    while pos < end:
        m = match(text, pos)
        if m is None:
            break
        pos = m.end()
        p = m["p"]
        if p is None:
            if want == "key":
                if m["s"] is None and m["e"] is None:
                    raise Invalid
                key = m["s"] if m["s"] is not None else _ESCAPE.sub(_char, m["e"])
                top = stack[-1]
                if key in top[1]:
                    depth, whole = len(path), (*path, key)
                    at = tuple(places)
                    out[top[2] :] = [t for t in out[top[2] :] if t[0][: depth + 1] != whole or t[1][: len(at)] != at]
                top[1].add(key)
                path.append(key)
                want = ":"
                continue
            if want not in ("value", "value]"):
                raise Invalid
            v = m["s"]
            if v is None:
                v = _ESCAPE.sub(_char, m["e"]) if m["e"] is not None else m["n"] if m["n"] is not None else m["w"]
                if m["w"] == "null":
                    v = None
            out.append((tuple(path), tuple(places), v))
            want = "next"
        elif p == "{" or p == "[":
            if want not in ("value", "value]"):
                raise Invalid
            if p == "{":
                stack.append(["{", set(), len(out)])
                want = "key}"
            else:
                stack.append(["[", None, len(out)])
                path.append("[]")
                places.append(0)
                want = "value]"
            if want == "key}":
                m2 = match(text, pos)
                if m2 is not None and m2["p"] != "}":
                    want = "key"
            continue
        elif p == ":":
            if want != ":":
                raise Invalid
            want = "value"
            continue
        elif p == ",":
            if want != "next" or not stack:
                raise Invalid
            if stack[-1][0] == "{":
                want = "key"
            else:
                places[-1] += 1
                want = "value"
            continue
        else:  # a closing bracket
            if not stack or stack[-1][0] != ("{" if p == "}" else "["):
                raise Invalid
            if want not in ("next", "key}" if p == "}" else "value]"):
                raise Invalid
            if p == "]":
                path.pop()
                places.pop()
            stack.pop()
            want = "next"
        # a value has ended: leave its key
        if stack and stack[-1][0] == "{":
            path.pop()
    if stack or want != "next" or text[pos:].strip(" \t\n\r"):
        raise Invalid
    return out


def valid_triples(text: str | None) -> list:
    """``triples``, and none at all for a null or invalid text."""
    if text is None:
        return []
    try:
        return triples(text)
    except Invalid:
        return []


@dataclass(frozen=True)
class FlatTable:
    """One flat table: the rows below ``ancestor`` (a path ending at a list level, or () for the record itself).

    ``columns`` maps a column to the path of its scalar below the ancestor. ``needs``: columns that must be non-empty,
    here and in the table's ``parent``; without them neither the row nor its children come out. ``open_map``: a path
    below the ancestor whose keys aren't known; its non-empty entries come out as key and value rows instead.
    ``lone``: a scalar at the list's own place counts as a list of one.
    """

    name: str
    ancestor: tuple[str, ...]
    columns: dict[str, tuple[str, ...]]
    needs: tuple[str, ...] = ()
    parent: str | None = None
    open_map: tuple[str, ...] | None = None
    lone: bool = False


def pivot(rows: list, tables: list[FlatTable], uses: dict[tuple[str, ...], list] | None = None) -> Iterator[tuple[str, tuple[int, ...], dict[str, str | None]]]:
    """Group triples by repeated ancestor and pivot each group: table name, ordinals, columns.

    ``tables`` must list parents before children. Rows come out per table, in the order of their ordinals. ``uses`` keeps
    what each path means to the tables, from record to record.
    """
    uses = {} if uses is None else uses
    groups: list[dict[tuple, dict[str, str | None]]] = [{} for _ in tables]
    for path, places, value in rows:
        for i, n, column, how in uses.get(path) or _uses(path, tables, uses):
            if how == "cell":
                g = groups[i].get(places[:n])
                if g is None:
                    g = groups[i][places[:n]] = {}
                if column is not None:
                    g[column] = value
            elif how == "entry":
                if value:
                    groups[i][(*places[:n], column)] = {"key": column, "value": value}
            elif value is not None:  # a lone scalar
                groups[i].setdefault((*places[: n - 1], 0), {})[column] = value
    kept: dict[str, set] = {}
    levels = {t.name: sum(a == "[]" for a in t.ancestor) for t in tables}
    for t, found in zip(tables, groups):
        n, ok = levels[t.name], set()
        kept[t.name] = ok
        for at, cols in sorted(found.items(), key=_order):
            if any(not cols.get(c) for c in t.needs):
                continue
            if t.parent is not None and at[: levels[t.parent]] not in kept[t.parent]:
                continue
            ok.add(at[:n])
            yield t.name, at[:n], cols


def _order(item: tuple) -> tuple:
    return tuple((isinstance(x, str), x) for x in item[0])


def _uses(path: tuple[str, ...], tables: list[FlatTable], uses: dict) -> list[tuple[int, int, str | None, str]]:
    """What a triple's path means to each table: its number, its list levels, the column, and how."""
    if path in uses:
        return uses[path]
    use: list[tuple[int, int, str | None, str]] = []
    for i, t in enumerate(tables):
        depth, n = len(t.ancestor), sum(a == "[]" for a in t.ancestor)
        if t.open_map is not None:
            base = t.ancestor + t.open_map
            if len(path) == len(base) + 1 and path[:-1] == base and path[-1] != "[]":
                use.append((i, n, path[-1], "entry"))
        elif path[:depth] == t.ancestor:
            use.append((i, n, next((k for k, v in t.columns.items() if path[depth:] == v), None), "cell"))
        elif t.lone and path == t.ancestor[:-1]:
            use.append((i, n, next(iter(t.columns)), "lone"))
    if len(uses) > 20_000:  # open maps can bring any number of paths
        uses.clear()
    uses[path] = use
    return use


def shred(df: DataFrame, key: str, body: str, tables: list[FlatTable], route: str | None = None) -> DataFrame:
    """Flat rows of all ``tables`` of each record: ``key``, ``table_name``, ``ordinals``, ``columns``.

    ``columns`` is a map of the table's columns. ``route``: a column of ``df``; only tables whose name begins with its
    value and a dot apply to a row. Null, empty and invalid bodies give no rows; repeated keys of ``df`` are separate
    records. Other columns of ``df`` are not read.
    """
    names = [key, body] + ([route] if route else [])
    by: dict[str, list[FlatTable]] = {}
    for t in tables:
        by.setdefault(t.name.split(".")[0] if route else "", []).append(t)

    kind = pa.schema(
        [
            ("key", pa.int64()),
            ("table_name", pa.string()),
            ("ordinals", pa.list_(pa.int32())),
            ("columns", pa.map_(pa.string(), pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[str, dict] = {r: {} for r in by}
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            size = 0
            routes = b.column(2) if route else None
            for i in range(b.num_rows):
                to = routes[i].as_py() if routes is not None else ""
                if to not in by:
                    continue
                for name, at, cols in pivot(valid_triples(b.column(1)[i].as_py()), by[to], uses[to]):
                    out[0].append(b.column(0)[i].as_py())
                    out[1].append(name)
                    out[2].append(at)
                    out[3].append([(k, None if v is None else v.encode("utf-8", "replace").decode()) for k, v in cols.items()])
                    size += 1
                if size >= 20_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)
                    out, size = ([], [], [], []), 0
            if size:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, kind)], schema=kind)

    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("table_name", T.StringType()),
            T.StructField("ordinals", T.ArrayType(T.IntegerType())),
            T.StructField("columns", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    return df.select(*names).mapInArrow(run, schema).withColumnRenamed("key", key)
