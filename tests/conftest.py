import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from dossierlake.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("dossierlake.spread", "8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column expression on one row of literals."""

    def run(expression):
        return spark.range(1).select(expression.alias("x")).first()[0]

    return run
