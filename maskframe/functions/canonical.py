"""Canonical JSON after RFC 8785: numbers as ECMAScript writes doubles, keys by UTF-16 units, least escapes."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beyond this, doubles no longer tell whole numbers apart.
SAFE = (1 << 53) - 1


def number(x: float) -> str:
    """The shortest decimal that reads back as the double, in ECMAScript's form."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    digits, exponent = f"{float.__repr__(x):s}", 0
    if "e" in digits:
        digits, power = digits.split("e")
        exponent = int(power)
    whole, _, fraction = digits.partition(".")
    fraction = "" if fraction == "0" else fraction
    point = len(whole) + exponent  # places before the point
    figures = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len(figures)
    figures = figures.rstrip("0")
    k = len(figures)
    if k <= point <= 21:
        return sign + figures + "0" * (point - k)
    if 0 < point <= 21:
        return sign + figures[:point] + "." + figures[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + figures
    power = point - 1
    return sign + figures[0] + ("." + figures[1:] if k > 1 else "") + f"e{'+' if power > 0 else '-'}{abs(power)}"


def dumps(value) -> str:
    """A parsed JSON value in canonical form."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_text(k)}:{dumps(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    if isinstance(value, str):
        return _text(value)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, int) and abs(value) <= SAFE:
        return str(value)
    return number(value)


def _text(text: str) -> str:
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        raise ValueError("half of a pair of surrogates is no text")
    return json.dumps(text, ensure_ascii=False)


def _canonical(lines: pd.Series) -> pd.Series:
    return lines.map(lambda t: None if t is None else dumps(json.loads(t)))


_canonical.__annotations__ = {"lines": pd.Series, "return": pd.Series}


def canonical_json(text: Column) -> Column:
    """JSON text in canonical form; null stays null, and what is no JSON is an error."""
    return F.pandas_udf(_canonical, "string")(text)
