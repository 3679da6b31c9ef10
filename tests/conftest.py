import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from skyledger.session import build_session
    shared = tempfile.mkdtemp(prefix="skyledger-test-ckpt-")
    s = build_session("local[4]", 4, app_name="skyledger-tests", extra={"spark.checkpoint.dir": shared})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="skyledger-test-")
