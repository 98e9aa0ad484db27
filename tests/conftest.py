import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from slotvalue.session import local_session
    s = local_session(4, 4, app_name="slotvalue-tests",
                      scratch=tempfile.mkdtemp(prefix="slotvalue-tests-", dir="/tmp"))
    yield s
    s.stop()
