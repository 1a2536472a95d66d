"""Text analysis as Column expressions: wrapping, n-grams, words, sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgram.functions.alphabet import class_body

MAX_N = 8


def wrapped(text: Column, start: str, end: str) -> Column:
    return F.concat(F.lit(start), text, F.lit(end))


def folded(text: Column) -> Column:
    """Lower case, without spaces (U+0020 only) at both ends."""
    return F.btrim(F.lower(text), F.lit(" "))


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams in order of first occurrence.

    Fewer than ``n`` bytes give none; up to ``n`` characters give the text.
    """
    if not 1 <= n <= MAX_N:
        raise ValueError(f"n must be 1 to {MAX_N}")
    grams = F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: text.substr(i, F.lit(n)))
    none = F.array().cast("array<string>")
    return F.when(F.octet_length(text) < n, none).when(F.char_length(text) <= n, F.array(text)).otherwise(F.array_distinct(grams))


def normalized(grams: Column, names: Sequence[str], pad: str) -> Column:
    """Characters outside the alphabet become ``pad``; grams may then repeat."""
    pattern = F.lit(f"[^{class_body(names)}]")
    return F.transform(grams, lambda g: F.regexp_replace(g, pattern, F.lit(pad.replace("\\", "\\\\").replace("$", "\\$"))))


def with_grams(rows: DataFrame, text_col: str, n: int, names: Sequence[str], pad: str, start: str, end: str, out: str = "grams") -> DataFrame:
    """Adds the gram list of a text: wrap, fold, n-gram, normalise."""
    folded_col = f"_{out}_text"
    rows = rows.withColumn(folded_col, folded(wrapped(F.col(text_col), start, end)))
    return rows.withColumn(out, normalized(ngrams(F.col(folded_col), n), names, pad)).drop(folded_col)


def words(text: Column, names: Sequence[str]) -> Column:
    """Maximal runs of alphabet characters of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(f"[{class_body(names)}]+"), F.lit(0))


def sentences(text: Column, separators: Sequence[str]) -> Column:
    """Pieces between separator characters; empty ones are still there."""
    return F.split(text, f"[{class_body(['' .join(separators)])}]")


def without_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Tokens that are no stop words; case matters."""
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words)))  # a hash set once there are many


def windows(tokens: Column, n: int) -> Column:
    """All full windows of ``n`` tokens; none if there are fewer."""
    none = F.array().cast("array<array<string>>")
    full = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))
    return F.when(F.size(tokens) >= n, full).otherwise(none)
