import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from terravet.session import build_session
    session = build_session("tests", "local[8]", 8, **{"spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over a single row."""
    base = spark.range(1)

    def evaluate(expr):
        return base.select(expr.alias("v")).first()[0]
    return evaluate
