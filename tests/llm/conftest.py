import pytest

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, node int, label int, piece string"


@pytest.fixture(scope="session")
def rows():
    return brute.corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus as documents, with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None if k % 7 == 0 else "xy"[k % 2], "s", None, 0.5, "kept", 1, None, "p") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(i, k % 2, int(k % 3 == 0)) for k, (i, _) in enumerate(rows)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def collected(df, *columns):
    key = lambda t: tuple((x is None, x) for x in t)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


@pytest.fixture
def same():
    key = lambda t: tuple((x is None, x) for x in t)

    def check(df, columns, expected):
        assert collected(df, *columns) == sorted(expected, key=key)

    return check
