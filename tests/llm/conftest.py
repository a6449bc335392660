import datetime

import pytest


@pytest.fixture
def awkward(spark):
    """A table with missing, empty, long, tied and repeated rows and clashing extra columns."""

    def make(texts, first=1, **extra):
        rows = [
            (first + i if i != 2 else None, text, "x", i, 0.5, datetime.date(2024, 1, 1), [i])
            for i, text in enumerate(texts)
        ]
        columns = (
            "doc_id long, text string, row string, chunk int, score double, fp date, kept array<int>"
        )
        return spark.createDataFrame(rows, columns)

    return make
