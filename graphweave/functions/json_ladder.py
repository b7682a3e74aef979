"""JSON out of free text, tried in steps: the text itself, fenced blocks, the first object that parses."""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = re.compile(r"```[ \t]*(?:json|JSON)?\s*(.*?)```", re.S)
DECODER = json.JSONDecoder()
#: What a value may begin with; decoding anything else would only make an error.
FIRST = frozenset('{["-0123456789tfnNI')
#: Opening signs before what may follow them in a value.
BEGINS = {"{": re.compile(r'\{(?=[ \t\n\r]*["}])'), "[": re.compile(r'\[(?=[ \t\n\r]*[\]\[{"\-0-9tfnNI])')}


def find_json(text: str | None, opening: str = "{") -> object | None:
    """The first value found; None if there is none. opening: '{' for objects, '[' for arrays."""
    text = (text or "").strip()
    for t in chain([text], (m[1].strip() for m in FENCE.finditer(text))):
        if t[:1] not in FIRST:
            continue
        try:
            return DECODER.decode(t)
        except (ValueError, RecursionError):  # nested too deep counts as broken
            pass
    # An opening sign inside a value that failed is tried too, so noise before an object does no harm.
    broken: set[int] = set()
    for at in (m.start() for m in BEGINS[opening].finditer(text)):
        if at not in broken:
            try:
                return decoded(text, at)
            except json.JSONDecodeError as e:
                broken |= hopeless(text, at, at + e.pos)
            except RecursionError:
                broken |= hopeless(text, at, len(text))
    return None


def decoded(text: str, at: int) -> object:
    """The object or array that begins at a place. Errors count from there; they count the lines before them, so the
    decoder sees no more of a long text than it needs."""
    size = 1 << 10
    while True:
        try:
            return DECODER.raw_decode(text[at : at + size])[0]
        except json.JSONDecodeError as e:
            # Where a part ends within a string or word, that is no error.
            if at + size >= len(text) or e.pos < size - 32 and not e.msg.startswith("Unterminated"):
                raise
        size *= 4


#: What opens, closes or quotes.
SIGN = re.compile(r'[{}\[\]"]')
#: The rest of a string from behind its quote.
STRING = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"?', re.S)


@cache
def deepest() -> int:
    """How deep values may be nested for the decoder, about."""
    low, high = 1, 1 << 20
    while low + 1 < high:
        n = (low + high) // 2
        try:
            DECODER.raw_decode("[" * n + "]" * n)
            low = n
        except RecursionError:
            high = n
    return low


def hopeless(text: str, at: int, end: int) -> set[int]:
    """Of the values that begin in a value which begins at `at` and is in order up to `end`: those that are still open
    there, which break where it broke, and those nested too deep. One pass, so a text costs what it is long, however
    much of it is nested; what stands in strings is not judged."""
    open_: list[list[int]] = []  # where each begins, levels found in it
    out: set[int] = set()
    while at < end and (m := SIGN.search(text, at, end)):
        sign, at = m[0], m.end()
        if sign == '"':
            at = STRING.match(text, at).end()
        elif sign in "{[":
            open_.append([m.start(), 0])
        elif open_ and text[open_[-1][0]] == ("{" if sign == "}" else "["):
            start, levels = open_.pop()
            if levels + 1 > deepest():
                out.add(start)
            if open_:
                open_[-1][1] = max(open_[-1][1], levels + 1)
        else:
            break
        if not open_:
            break
    return out | {start for start, _ in open_}


def has_keys(value: object, keys: tuple[str, ...]) -> bool:
    """Whether a value is an object with all the keys."""
    return isinstance(value, dict) and all(k in value for k in keys)


def json_or(text: str | None, default: object = None, keys: tuple[str, ...] = ()) -> object:
    """The object in a text if there is one with the keys, else the default; never an error."""
    found = find_json(text)
    return found if found is not None and (not keys or has_keys(found, keys)) else default


def _as_text(opening: str):
    def run(s: pd.Series) -> pd.Series:
        found = (find_json(x, opening) for x in s)
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found], dtype=object)

    return run


#: The object (or whatever the whole text is) as JSON text; null where there is none.
json_object = F.pandas_udf(_as_text("{"), StringType())
json_array = F.pandas_udf(_as_text("["), StringType())


def object_or(text: Column, keys: tuple[str, ...], default: str) -> Column:
    """The object in a text as JSON if it has all the keys, else the default."""
    found = json_object(text)
    doc = F.try_parse_json(found)
    whole = doc.isNotNull() & F.startswith(found, F.lit("{"))
    for k in keys:
        whole = whole & F.try_variant_get(doc, f"$.{k}", "variant").isNotNull()
    return F.when(whole, found).otherwise(F.lit(default))
