import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from beliefloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="8", **{"spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
