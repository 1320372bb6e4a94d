"""JSON out of the prose that models write, cut short or not."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN_KEYS = ("needsMoreInfo", "report")  # fixed values: what a report's object has


def closed(text: str) -> str | None:
    """A JSON object that breaks off, closed after its last whole member; None if nothing is open."""
    stack: list[str] = []
    safe = None  # where the text can be cut, and what then stays open
    i, n = text.find("{"), len(text)
    if i < 0:
        return None
    start, expect_key = i, False
    while i < n:
        c = text[i]
        if c == '"':
            j = i + 1
            while j < n and text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            if j >= n:
                break
            i = j
            if not (stack and stack[-1] == "}" and expect_key):
                safe = (i + 1, list(stack))
            expect_key = False
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            expect_key = c == "{"
            safe = (i + 1, list(stack))
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            safe = (i + 1, list(stack))
            if not stack:
                return None
        elif c == ",":
            expect_key = bool(stack) and stack[-1] == "}"
            safe = (i, list(stack))
        i += 1
    return text[start : safe[0]] + "".join(reversed(safe[1])) if safe else None


def find_object(text: str | None) -> dict | None:
    """The object in a text: the text itself, a fenced block, the largest object in it (known keys first), or a mended one."""
    if not text:
        return None
    decoder = json.JSONDecoder(strict=False)  # line breaks in strings are let pass

    def whole(s: str) -> dict | None:
        try:
            x = decoder.decode(s.strip())
        except ValueError:
            return None
        return x if isinstance(x, dict) else None

    for s in (text, *re.findall(r"```(?:json)?\s*\n?(.*?)```", text, re.DOTALL | re.IGNORECASE)):
        if (x := whole(s)) is not None:
            return x
    found, i = [], text.find("{")
    while i >= 0:
        try:
            x, end = decoder.raw_decode(text, i)
            found.append((not any(k in x for k in KNOWN_KEYS), i - end, x))
            i = text.find("{", end)
        except ValueError:
            i = text.find("{", i + 1)
    mended = closed(re.sub(r"```(?:json)?", "", text))
    if mended and (x := whole(mended)) is not None and (not found or len(mended) > -min(f[1] for f in found)):
        return x
    return min(found, key=lambda f: f[:2])[2] if found else None


def mended_json(text: Column) -> Column:
    """The object in a text as JSON, null if there is none. Try try_parse_json first: this goes through Python."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        found = (find_object(t) for t in texts.to_pylist())
        return pa.array([None if x is None else json.dumps(x, ensure_ascii=False) for x in found], pa.string())

    return of(text)
