"""Problem 3: deeply nested JSON records become related flat tables (shared inlining).

One pass reads the graph of which element occurs in which, and how: an element that is ever repeated,
that occurs below several elements, or that can contain itself gets a table of its own; every other
element is a column of the nearest ancestor with a table. A second pass writes the rows, each with its
path of positions and that of its parent, which is the foreign key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More element names than this are data, not a schema; the graph is gathered to the driver.
MAX_EDGES = 20_000


def _reject(constant: str) -> None:
    raise ValueError(constant)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _load_deep(text: str) -> object:
    """As json.loads, with a stack of its own: nested as deep as memory allows. ValueError where invalid."""
    skip = lambda i: _SPACE.match(text, i).end()
    stack: list[tuple[object, str | None]] = []  # open containers, each with the key it waits at

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return name, skip(i + 1)

    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            i = skip(i + 1)
            value: object = {} if c == "{" else []
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, i = key(i)
                stack.append((value, name))
                continue
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif number := _NUMBER.match(text, i):
            value = float(number[0]) if number[2] or number[3] else int(number[0])
            i = number.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError(i)
            value, i = _WORDS[word], i + len(word)
        # put the value into its container, and close those that end here
        while True:
            i = skip(i)
            if not stack:
                if i < len(text):
                    raise ValueError(i)
                return value
            holder, name = stack.pop()
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            c = text[i : i + 1]
            if c == ",":
                i, name = skip(i + 1), None
                if isinstance(holder, dict):
                    name, i = key(i)
                stack.append((holder, name))
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(i)
            value, i = holder, i + 1


def _load(text: object) -> object:
    """The JSON value of `text`, or ... where it isn't valid JSON (NaN and Infinity aren't)."""
    if not isinstance(text, str):
        return ...
    try:
        return json.loads(text, parse_constant=_reject)
    except RecursionError:
        pass
    except ValueError:
        return ...
    try:
        return _load_deep(text)
    except ValueError:
        return ...


def _enter(document: object, root: str) -> object:
    """The element `root` of a document; it may itself be JSON text. ... where there is none."""
    value = document.get(root, ...) if isinstance(document, dict) else ...
    while isinstance(value, str):
        value = _load(value)
    return value


def _edges(value: object, root: str) -> set[tuple[str, str, str]]:
    """(element, element in it, `many`, `object` or `value`) of one record."""
    found: set[tuple[str, str, str]] = set()
    stack = [(root, value)]
    while stack:
        name, item = stack.pop()
        if isinstance(item, list):
            stack.extend((name, x) for x in item)
        elif isinstance(item, dict):
            for key, x in item.items():
                found.add((name, key, "many" if isinstance(x, list) else "object" if isinstance(x, dict) else "value"))
                if isinstance(x, (list, dict)):
                    stack.append((key, x))
    return found


def schema_graph(df: DataFrame, doc: str, root: str) -> DataFrame:
    """Distinct (parent, child, kind) over all records; kind is `many`, `object` or `value`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str, str]] = set()
        for pdf in batches:
            for text in pdf[doc]:
                seen |= _edges(_enter(_load(text), root), root)
        yield pd.DataFrame(sorted(seen), columns=["parent", "child", "kind"])

    return df.select(doc).mapInPandas(read, "parent string, child string, kind string").distinct()


def table_elements(edges: list[tuple[str, str, str]], root: str, repeated: set[str] = frozenset()) -> dict[str, str]:
    """Why each element with its own table has one: `repeated`, `recursive` or `shared`."""
    below: dict[str, set[str]] = {}
    above: dict[str, set[str]] = {}
    why: dict[str, str] = {}
    structured = {c for _, c, kind in edges if kind != "value"}
    for parent, child, kind in edges:
        below.setdefault(parent, set()).add(child)
        above.setdefault(child, set()).add(parent)
        if kind == "many" or child in repeated:
            why[child] = "repeated"
    for name in structured:
        reached, todo = set(), [name]
        while todo:
            for x in below.get(todo.pop(), ()):
                if x not in reached:
                    reached.add(x)
                    todo.append(x)
        if name in reached:
            why[name] = "recursive"
        elif len(above[name]) > 1:
            why.setdefault(name, "shared")
    why.pop(root, None)
    return why


def _rows(value: object, root: str, tables: frozenset[str], wanted: frozenset[str], with_values: bool) -> Iterator[tuple]:
    """(element, path, parent element, parent path, position, values) of one record."""
    stack: list[tuple[str, str, dict | None, object, str]] = []

    def visit(owner: str, path: str, values: dict | None, item: dict, prefix: str) -> None:
        # children last to first, so that the stack gives rows in document order
        for key, x in reversed(list(item.items())):
            if key in tables:
                several = x if isinstance(x, list) else [x] if isinstance(x, dict) else []
                for pos in range(len(several) - 1, -1, -1):
                    stack.append((key, f"{path}.{pos}" if path else str(pos), None, several[pos], f"{owner}\t{path}\t{pos}"))
            elif isinstance(x, dict):
                visit(owner, path, values, x, f"{prefix}{key}.")
            elif values is not None and x is not None:
                values[prefix + key] = x if isinstance(x, str) else json.dumps(x)

    if isinstance(value, dict):
        visit(root, "", None, value, "")
    elif isinstance(value, list):
        for pos in range(len(value) - 1, -1, -1):
            if isinstance(value[pos], dict):
                visit(root, "", None, value[pos], "")
    while stack:
        name, path, _, item, link = stack.pop()
        values: dict | None = {} if with_values and name in wanted else None
        if isinstance(item, dict):
            visit(name, path, values, item, "")
        elif values is not None and item is not None:
            values["value"] = item if isinstance(item, str) else json.dumps(item)
        if name in wanted:
            owner, parent_path, pos = link.split("\t")
            yield name, path, owner, parent_path, int(pos), values


def shred(df: DataFrame, row_id: str, doc: str, root: str, repeated: set[str], wanted: set[str] | None = None, with_values: bool = True) -> DataFrame:
    """Rows of the flat tables below `root` of the JSON text `doc`.

    Columns: row_id, element (the table), path, parent_element, parent_path, pos, and values
    (map of inlined columns) when asked for. `repeated` names the elements known to be lists from
    the format, whatever the data at hand show. An object that stands where a list belongs is a list
    of one; any other value there holds no element. A doc that is null, empty or not valid JSON, or
    has no `root`, gives no rows; a record delivered twice gives its rows twice.
    """
    graph = [tuple(r) for r in schema_graph(df, doc, root).limit(MAX_EDGES + 1).collect()]
    if len(graph) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} links between element names: names hold data")
    tables = frozenset(table_elements(graph, root, repeated)) | frozenset(repeated)
    chosen = frozenset(wanted) if wanted is not None else tables

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["element", "path", "parent_element", "parent_path", "pos", "values"]
        for pdf in batches:
            out, ids = [], []
            for key, text in zip(pdf[row_id], pdf[doc], strict=True):
                for row in _rows(_enter(_load(text), root), root, tables, chosen, with_values):
                    ids.append(key)
                    out.append(row)
            made = pd.DataFrame(out, columns=names)
            made.insert(0, row_id, pd.Series(ids, dtype=pdf[row_id].dtype))
            yield made if with_values else made.drop(columns="values")

    kind = df.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, element string, path string, parent_element string, parent_path string, pos bigint"
    return df.select(row_id, doc).mapInPandas(write, schema + ", values map<string,string>" * with_values)


# Names of the vulnerability feed's format.
CONFIGURATIONS = "configurations"
LISTS = {"nodes", "children", "cpe_match"}


def configuration_nodes(df: DataFrame, row_id: str, doc: str) -> DataFrame:
    """The node table: row_id, node_path, parent_path (null at the top), depth, operator, negate."""
    rows = shred(df, row_id, doc, CONFIGURATIONS, LISTS, {"nodes", "children"})
    return rows.select(
        row_id,
        F.col("path").alias("node_path"),
        F.when(F.col("parent_path") != "", F.col("parent_path")).alias("parent_path"),
        (F.size(F.split("path", r"\.")) - 1).cast("bigint").alias("depth"),
        F.col("values")["operator"].alias("operator"),
        F.coalesce(F.col("values")["negate"] == "true", F.lit(False)).alias("negate"),
    )


def configuration_matches(df: DataFrame, row_id: str, doc: str, with_values: bool = True) -> DataFrame:
    """The match table: row_id, node_path (the foreign key), match_pos and the match's own columns.

    A missing `vulnerable` counts as false.
    """
    rows = shred(df, row_id, doc, CONFIGURATIONS, LISTS, {"cpe_match"}, with_values)
    keys = [F.col(row_id), F.col("parent_path").alias("node_path"), F.col("pos").alias("match_pos")]
    if not with_values:
        return rows.select(*keys)
    value = lambda name: F.col("values")[name]
    bounds = ["versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding"]
    return rows.select(*keys, F.coalesce(value("vulnerable") == "true", F.lit(False)).alias("vulnerable"), value("cpe23Uri").alias("cpe23uri"), *[value(b).alias(b) for b in bounds])
