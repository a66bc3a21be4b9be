import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, fp long, h string, __h long, kept boolean, n long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnml") for _ in range(r.randint(2, 8))) for _ in range(n))


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text), "x", 1, "y", 2, False, 3)


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    a, long = prose(1, 80), prose(2, 30_000)
    out = [row(i, prose(10 + i, 40 + i), "en", f"s{i % 3}") for i in range(25)]
    out += [row(100, a), row(101, a + " end"), row(102, a), row(102, a), row(102, a), row(103, a.upper())]
    out += [row(None, a), row(None, None), row(200, None), row(201, ""), row(202, " \t\n"), row(203, "one"), row(204, "one two")]
    out += [(None,) * 11, (None,) * 11, row(300, long), row(301, long, None, None), row(302, "w" * 50_000), row(303, "é" * 300 + "\n\n" + a)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
