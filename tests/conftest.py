import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from factorspark.session import local_session

    s = local_session(8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from check_queries import connect

    return connect(SMALL)


@pytest.fixture(scope="session")
def check(spark, duck):
    """Run a registered query and compare it with its SQL."""
    from check_queries import differences

    from factorspark.catalog import ORACLES, QUERIES

    def run(name: str) -> None:
        got = QUERIES[name](spark, SMALL).toPandas()
        if name in ORACLES:
            assert differences(got, duck.execute(ORACLES[name]).df()) is None
        else:
            assert len(got)

    return run
