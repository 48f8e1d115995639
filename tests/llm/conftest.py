"""Small documents for the training-data operators."""

import pytest

from odd_rows import ODD


@pytest.fixture
def make(spark):
    def docs(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return docs


@pytest.fixture
def simple(make):
    """Texts to documents, numbered from 0; source s<number mod 3>."""

    def docs(texts, start=0):
        return make([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts, start)])

    return docs


@pytest.fixture
def odd(make):
    """ODD with each row twice, a null id and a null language and source."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    return make([*rows, *rows, (None, "no id at all in this row", None, None, None), (None, None, None, None, None)])
