"""JSON text whose numbers keep their spelling, for use inside Arrow functions."""

from __future__ import annotations

import json
import re
from typing import Any


class Number(str):
    """A number, as it was written."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON value")


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)
_LONE = re.compile("[\ud800-\udfff]")
_EDGE = " \t\n\r"
#: Characters that are written as escapes although JSON would not need it.
_ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}
_TO_ESCAPE = re.compile("[<>&  ]")


def decode(text: str) -> Any:
    """The one value in the text; raises ValueError on anything else, trailing data included."""
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip(_EDGE)))
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    if text[end:].strip(_EDGE):
        raise ValueError("trailing data")
    return value


def is_valid(text: str | None) -> bool:
    if text is None:
        return False
    try:
        decode(text)
    except ValueError:
        return False
    return True


def quote(text: str, html: bool = True) -> str:
    """A JSON string; with ``html``, the characters of ``_ESCAPED`` are escaped too."""
    out = json.dumps(_LONE.sub("�", text), ensure_ascii=False)
    return _TO_ESCAPE.sub(lambda m: _ESCAPED[m.group()], out) if html else out


def encode(value: Any) -> str:
    """Compact text with sorted keys and numbers as they were written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{quote(k)}:{encode(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(encode, value)) + "]"
    return json.dumps(value)
