"""Functions and macros of C and C++ texts, read by tokens and matching brackets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z))|(?P<directive>(?:(?<=\n)|\A)[ \t]*\#(?:\\\r?\n|[^\n])*)|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z_~]\w*)|(?P<other>.)""",
    re.S | re.X,
)
# Words before a bracket that make no function, and words that open other blocks.
NO_FUNCTION = {"if", "for", "while", "switch", "catch", "return", "sizeof"}
_BLOCKS = {"struct", "class", "union", "enum", "namespace"}


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    return [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]


def _closing(tokens: list[tuple], at: int) -> int:
    """The index of the brace that closes the one at `at`, or -1."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i][0] == "other":
            depth += (tokens[i][1] == "{") - (tokens[i][1] == "}")
            if not depth:
                return i
    return -1


def _declared(tokens: list[tuple]) -> str | None:
    """The name of the function that the tokens before a `{` declare, or None."""
    depth, name, before = 0, None, None
    for kind, value, _, _ in tokens:
        if kind == "other" and value in "([":
            if value == "(" and not depth and name is None and before and before[0] == "word":
                name = before[1]
            depth += 1
        elif kind == "other" and value in ")]":
            depth -= 1
        elif not depth and kind == "other" and value == "=" and name is None:
            return None
        before = (kind, value)
    words = [v for k, v, _, _ in tokens if k == "word"]
    return name if name and name not in NO_FUNCTION and not (words and words[0] in _BLOCKS and ")" not in [v for _, v, _, _ in tokens]) else None


def parsed_functions(text: str) -> list[tuple[str, int, str]]:
    """(name, first line, source) of the functions that are defined in `text`, also within classes and namespaces.

    A body that is never closed is no function. `if` and its like are no names.
    """
    tokens = _tokens(text)
    found, start, i = [], 0, 0
    while i < len(tokens):
        kind, value = tokens[i][:2]
        if kind == "directive" or (kind == "other" and value in ";}"):
            start = i + 1
        elif kind == "other" and value == "{":
            head = tokens[start:i]
            name = _declared(head)
            ends_in_list = name and any(v == ":" for _, v, _, _ in head[len(head) // 2 :]) and head[-1][0] == "word" and head[-1][1] not in ("const", "noexcept", "override", "final", "volatile")
            if name or any(k == "other" and v == "=" for k, v, _, _ in head):
                end = _closing(tokens, i)
                if end < 0:
                    break
                if ends_in_list:
                    i = end + 1
                    continue
                if name:
                    a, b = head[0][2], tokens[end][3]
                    found.append((name, text.count("\n", 0, a) + 1, text[a:b]))
                    start = end + 1
                i = end
            else:
                start = i + 1
        i += 1
    return found


def functions_in(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """row_id, pos, name, line_no, func_hash, func of every function in the texts; null texts have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf[row_id], pdf[content], strict=True):
                for pos, (name, line, func) in enumerate(parsed_functions(text) if isinstance(text, str) else [], 1):
                    out.append((key, pos, name, line, hashlib.sha256(func.encode("utf-8", "surrogatepass")).hexdigest(), func))
            yield pd.DataFrame(out, columns=[row_id, "pos", "name", "line_no", "func_hash", "func"])

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, content).mapInPandas(read, f"`{row_id}` {kind}, pos int, name string, line_no int, func_hash string, func string")


_DEFINE = re.compile(r"[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\([^)]*\))?(.*)\Z", re.S)
_NEAR = r"""() \n\t,{}=;"'\\\[\]"""
_HEAD = re.compile(r"#[ \t]*(?:define|ifdef|ifndef)[ \t]*\Z")


def macros(text: str) -> dict[str, str]:
    """The macros of a text that stand for a quoted text, and those that quote a parameter (its place from 0)."""
    found: dict[str, str] = {}
    for kind, value, _, _ in _tokens(text):
        m = _DEFINE.match(value) if kind == "directive" else None
        if m is None:
            continue
        body = re.sub(r"//[^\n]*|/\*.*?\*/", "", m[3].replace("\\\n", " "), flags=re.S).strip()
        if m[2]:
            for i, name in enumerate(p.strip() for p in m[2][1:-1].split(",")):
                if name and re.search(rf"(?<!#)#\s*{re.escape(name)}\b", body) and not re.search(rf"##\s*{re.escape(name)}\b", body):
                    found[m[1]] = str(i)
        elif len(body) > 1 and body[0] == body[-1] == '"':
            found[m[1]] = body
    return found


def with_macros(text: str, known: dict[str, str]) -> tuple[str, list[str]]:
    """The text with the names of text macros replaced, and the distinct values put in, in order of their names.

    A name counts between blanks, brackets and the like only; not behind #define and #ifdef, and not
    within quotes or comments.
    """
    used = []
    for name, value in known.items():
        if not value.startswith('"'):
            continue
        closed = [(m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup == "text" or (m.lastgroup == "skip" and m.group().strip())]

        def put(m: re.Match, value: str = value, closed: list = closed, text: str = text) -> str:
            if _HEAD.search(text, max(0, m.start() - 40), m.start()) or any(a <= m.start() < b for a, b in closed):
                return m.group()
            used.append(value)
            return value

        text = re.sub(rf"(?<![^{_NEAR}]){re.escape(name)}(?![^{_NEAR}])", put, text)
    return text, list(dict.fromkeys(used))


def replaced_macros(df: DataFrame, row_id: str, content: str) -> DataFrame:
    """row_id, macros (map), replaced (the text), used (values put in) of every non-null text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf[row_id], pdf[content], strict=True):
                if isinstance(text, str):
                    known = macros(text) if "#" in text else {}
                    out.append((key, known, *with_macros(text, known)))
            yield pd.DataFrame(out, columns=[row_id, "macros", "replaced", "used"])

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, content).mapInPandas(read, f"`{row_id}` {kind}, macros map<string,string>, replaced string, used array<string>")
