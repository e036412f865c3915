import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("CARTOLITH_WAREHOUSE", tempfile.mkdtemp(prefix="run-", dir="/tmp"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cartolith.session import local_session
    return local_session("4", 4)


@pytest.fixture(scope="session")
def sf():
    return SF
