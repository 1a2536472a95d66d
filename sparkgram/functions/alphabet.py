"""Alphabets as regular-expression character classes.

An alphabet is a list of names: ``english``, ``russian`` and ``numbers`` stand
for their characters, any other name for the set of its own characters.  The
union of a list is one class body, so membership and splitting need no UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the named alphabets
NAMED = {"english": "a-z", "russian": "а-яё", "numbers": "0-9"}
SIZES = {"english": 26, "russian": 32, "numbers": 10}


def _escaped(chars: str) -> str:
    return "".join("\\" + c if c in "\\[]^-&$.|?*+(){}/~#@!=<>,;:'\"`% " and not c.isspace() else c for c in dict.fromkeys(chars))


def class_body(names: Sequence[str]) -> str:
    """The inside of ``[...]`` for the union of the alphabets."""
    body = "".join(NAMED.get(name) or _escaped(name) for name in names)
    if not body:
        raise ValueError("an alphabet needs at least one character")
    return body


def size(names: Sequence[str]) -> int:
    """Number of characters; the Russian ё is accepted but not counted."""
    return sum(SIZES.get(name) or len(set(name)) for name in names)


def chars(names: Sequence[str]) -> list[str]:
    """The characters of the alphabets, each once, in order of first appearance;
    the Russian ё is accepted but not listed."""
    out: list[str] = []
    for name in names:
        span = NAMED.get(name)
        if span is None:
            out += name
        else:
            out += [chr(c) for c in range(ord(span[0]), ord(span[2]) + 1)]
    return list(dict.fromkeys(out))


def has(char: Column, names: Sequence[str]) -> Column:
    """Whether a one-character column belongs to the alphabet."""
    return char.rlike(f"^[{class_body(names)}]$")
