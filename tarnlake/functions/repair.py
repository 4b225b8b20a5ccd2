"""Repair of lenient JSON by one pass over its tokens with a stack of open brackets.

States of a place: before a key, before a colon, before a value, after a value. In each state the next token is taken as what
it must be there:

* a bare or single-quoted key is quoted; a key without a value has null, and so has one with an empty text;
* True, FALSE, None, NULL and the like are the literals; other bare words, up to the next comma, bracket or line end, are a text;
* 007 is 7, .5 is 0.5, 5. is 5.0;
* a text in single quotes is one in double quotes; a text that is still open at the end of its line, or of all, ends there, so a
  text does not go over several lines;
* a missing comma between elements is put in, commas too many are left out.

Nothing is repaired inside a text that is closed. A text without a top-level object or array, with brackets that do not match, or
with more after the end, cannot be repaired.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import ship_package

# groups: text, text in single quotes, open text, mark, bare word; then the end
_TOKEN = re.compile(
    r"""\s*(?:("(?:[^"\\\n]++|\\.)*+")"""
    r"""|('(?:[^'\\\n]++|\\.)*+')"""
    r"""|(["'][^\n]*)"""
    r"""|([{}\[\],:])"""
    r"""|([^\s"',:{}\[\]][^",:{}\[\]\n]*)|\Z)""",
)
TEXT, SINGLE, OPEN, MARK, BARE = range(1, 6)
_NUMBER = re.compile(r"(-?)0*+(\d*+)(?:\.(\d*))?([eE][+-]?\d+)?")
LITERALS = {
    "true": "true", "True": "true", "TRUE": "true", "false": "false", "False": "false", "FALSE": "false",
    "null": "null", "Null": "null", "NULL": "null", "None": "null",
}
KEY, COLON, VALUE, AFTER = range(4)


def _bare(text: str) -> str:
    """A bare word as value."""
    text = text.rstrip()
    if text in LITERALS:
        return LITERALS[text]
    m = _NUMBER.fullmatch(text)
    if m and any(c.isdigit() for c in text.partition("e")[0].partition("E")[0]):
        fraction = "" if m[3] is None else f".{m[3] or '0'}"
        return f"{m[1]}{m[2] or '0'}{fraction}{m[4] or ''}"
    return _quoted(text)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _text(kind: int, token: str) -> str:
    if kind == TEXT:
        return token
    if kind == OPEN:
        return '"' + token[1:].replace('"', '\\"') + '"'
    return '"' + token[1:-1].replace("\\'", "'").replace('"', '\\"') + '"'


def repaired(text: str | None) -> str | None:
    """JSON text, or None."""
    if text is None:
        return None
    out: list[str] = []
    stack: list[str] = []
    state, inside, add = VALUE, "", out.append
    following = _TOKEN.scanner(text).match
    while (m := following()) is not None and (kind := m.lastindex) is not None:
        token = m[kind]
        if not inside and (out or token not in ("{", "[")):
            return None
        if kind == MARK:
            if token == ":":
                if state != COLON:
                    return None
                add(":")
                state = VALUE
                continue
            if token in ",}]":
                # what stands before is at its end
                if inside == "{" and state in (VALUE, COLON):
                    add("null" if state == VALUE else ":null")
                if token == ",":
                    state = KEY if inside == "{" else VALUE
                    continue
                if inside != ("{" if token == "}" else "["):
                    return None
                add(token)
                stack.pop()
                inside, state = stack[-1] if stack else "", AFTER
                continue
        # a key or a value begins here
        if state == COLON:
            return None
        if state == AFTER:
            state = KEY if inside == "{" else VALUE
        if (state == KEY or inside == "[") and out[-1] not in "{[":
            add(",")
        if state == KEY:
            if kind == MARK or kind == OPEN:
                return None
            add(_quoted(token.rstrip()) if kind == BARE else _text(kind, token))
            state = COLON
        elif kind == MARK:
            add(token)
            stack.append(token)
            inside, state = token, KEY if token == "{" else VALUE
        else:
            value = _bare(token) if kind == BARE else _text(kind, token)
            add("null" if value == '""' and inside == "{" else value)
            state = AFTER
    return "".join(out) if out and not stack and m is not None else None


def repaired_column(c: Column) -> Column:
    """:func:`repaired` over Arrow batches; nulls cost nothing."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return pd.Series([repaired(t) for t in texts], dtype=object)

    return repair(c)
