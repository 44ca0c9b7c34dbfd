import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from heronlake.functions.session import local_session

    s = local_session(4, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-tests-"), "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
