"""JSON descriptions of search indexes and language models."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

DRIVERS = ("RAM", "DISC")


@dataclass(frozen=True)
class IndexDescription:
    """A search index.  ``driver`` RAM keeps it cached, DISC as Parquet."""

    name: str
    n: int
    alphabet: tuple[str, ...]
    pad: str = "$"
    wrap: tuple[str, str] = ("$", "$")
    driver: str = "RAM"
    source: str = ""
    output: str = ""

    def __post_init__(self):
        if self.driver not in DRIVERS:
            raise ValueError(f"driver must be one of {DRIVERS}")
        if not 1 <= self.n <= 8:
            raise ValueError("n must be 1 to 8")


@dataclass(frozen=True)
class LanguageModelConfig:
    name: str
    order: int
    alphabet: tuple[str, ...]
    separators: tuple[str, ...]
    start: str = "<S>"
    end: str = "</S>"
    source: str = ""
    output: str = ""

    def __post_init__(self):
        if self.order < 1:
            raise ValueError("the order must be positive")


def _resolved(base: str, path: str) -> str:
    return path if not path or os.path.isabs(path) or "://" in path else os.path.join(base, path)


def read_index_descriptions(path: str) -> list[IndexDescription]:
    """A list of indexes; relative paths start at the file's folder."""
    with open(path, encoding="utf-8") as f:
        items = json.load(f)
    base = os.path.dirname(os.path.abspath(path))
    return [
        IndexDescription(
            name=x["name"], n=x["nGramSize"], alphabet=tuple(x["alphabet"]), pad=x.get("pad", ""), wrap=tuple(x.get("wrap", ("", ""))),
            driver=x.get("driver", "RAM"), source=_resolved(base, x.get("source", "")), output=_resolved(base, x.get("output", "")),
        )
        for x in items
    ]


def read_language_model_config(path: str) -> LanguageModelConfig:
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    base = os.path.dirname(os.path.abspath(path))
    return LanguageModelConfig(
        name=x["name"], order=x["nGramOrder"], alphabet=tuple(x["alphabet"]), separators=tuple(x["separators"]),
        start=x.get("startSymbol", "<S>"), end=x.get("endSymbol", "</S>"), source=_resolved(base, x.get("source", "")), output=_resolved(base, x.get("output", "")),
    )
