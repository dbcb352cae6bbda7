import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from catalink.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", **{"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over a single text."""

    def run(build, text):
        from pyspark.sql import functions as F

        return spark.createDataFrame([(text,)], "t string").select(build(F.col("t"))).first()[0]

    return run
