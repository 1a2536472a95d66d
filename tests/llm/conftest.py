import pytest

#: Texts that every operator must take: null, empty, blank, short, repeated, odd, long.
ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two three four",
    "The quick brown fox jumps over the lazy dog. It's 12 o'clock!",
    "The quick brown fox jumps over the lazy dog. It's 12 o'clock!",
    "naïve café — Ёлка 漢字かな 😀😀 a b c  d",
    "﻿x\u0000y \\ \" ' </turn>### ",
    "x" * 5000,
    "word " * 30000,
    "аб вг " * 3000,
]


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text, lang, source, n_chars) with nulls in every column, a repeated
    id, and extra columns whose names the operators use themselves."""
    rows = [(i * 3, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t) if t else None, "kept", 1.5, 7, 8.5, 9) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id at all", "en", "src1", 12, "kept", 2.5, 7, 8.5, 9), (9, "one", "en", "src0", 3, "kept", None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, label int, target double, size int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def write_tables(spark, path, **tables):
    """A folder like the driver's, with these tables."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="session")
def tables():
    return write_tables
