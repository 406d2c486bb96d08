"""The grammar of placeholders, ``[LABEL_n]`` with an optional ``#`` and 16 hexadecimal digits, and their numbers.

n has five digits at most. Numbers go on past 99,999 in blocks: number 99,999 b + i is ``[LABEL_i]`` with
the block b as its suffix, so every number has one spelling that is in the grammar and can be restored.
Other suffixes come from collisions: they belong to the label, and their numbers end at 99,999.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar.
LABEL, NUMBER, SUFFIX = "[A-Z]{2,12}", "[1-9][0-9]{0,4}", "#[0-9a-f]{16}"
LARGEST = 99_999
GRAMMAR = rf"\[{LABEL}_{NUMBER}\]({SUFFIX})?"
PLACEHOLDER = re.compile(rf"\[{LABEL}_{NUMBER}\](?:{SUFFIX})?")
#: What could still become a placeholder at the end of a text, with or without its suffix.
OPEN = re.compile(rf"\[(?:[A-Z]{{0,12}}|{LABEL}_(?:{NUMBER})?)$|\[{LABEL}_{NUMBER}\](?:#[0-9a-f]{{0,15}})?$")
_WHOLE = rf"^\[({LABEL})_({NUMBER})\]({SUFFIX})?$"
#: Suffixes of blocks begin with eight zeros, as one drawn at random does once in four billion.
_BLOCK = "#00000000"


def _part(placeholder: Column, i: int) -> Column:
    return F.regexp_extract(placeholder, _WHOLE, i)


def is_placeholder(text: Column) -> Column:
    return text.rlike(_WHOLE)


def label(placeholder: Column) -> Column:
    return _part(placeholder, 1)


def suffix(placeholder: Column) -> Column:
    """The suffix that belongs to the label; '' for none and for blocks of numbers."""
    own = _part(placeholder, 3)
    return F.when(own.startswith(_BLOCK), "").otherwise(own)


def number(placeholder: Column) -> Column:
    """The number among the placeholders of its label and suffix; null for other texts."""
    own = _part(placeholder, 3)
    block = F.when(own.startswith(_BLOCK), F.conv(F.substring(own, 10, 8), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(is_placeholder(placeholder), _part(placeholder, 2).cast("long") + block * LARGEST)


def spelled(label: Column, n: Column, suffix: Column | None = None) -> Column:
    """The placeholder of a number; null where a suffix of its own leaves no room for it."""
    own = F.lit("") if suffix is None else suffix
    block = F.floor((n - 1) / LARGEST)
    tail = F.when(block > 0, F.concat(F.lit(_BLOCK), F.lower(F.lpad(F.hex(block.cast("long")), 8, "0")))).otherwise(own)
    text = F.concat(F.lit("["), label, F.lit("_"), ((n - 1) % LARGEST + 1).cast("string"), F.lit("]"), tail)
    return F.when((own == "") | (n <= LARGEST), text)


def parts_of(placeholder: str) -> tuple[str, str, int] | None:
    """Label, suffix and number of a placeholder, as the columns above tell them."""
    m = re.fullmatch(rf"\[({LABEL})_({NUMBER})\]({SUFFIX})?", placeholder)
    if m is None:
        return None
    own = m[3] or ""
    return (m[1], "", int(m[2]) + int(own[9:], 16) * LARGEST) if own.startswith(_BLOCK) else (m[1], own, int(m[2]))


def spell(label: str, n: int, suffix: str = "") -> str | None:
    block, i = divmod(n - 1, LARGEST)
    if block and suffix:
        return None
    return f"[{label}_{i + 1}]{f'{_BLOCK}{block:08x}' if block else suffix}"
