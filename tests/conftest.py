import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hexwarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Evaluate a column over rows of named texts or numbers; returns the values in order."""

    def run(build, schema, rows):
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"i int, {schema}")
        return [row.out for row in df.select("i", build().alias("out")).orderBy("i").collect()]

    return run
