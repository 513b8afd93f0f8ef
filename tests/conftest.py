import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerlens.session import get_session, work_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(master="local[4]", app="ledgerlens-tests", shuffle_partitions=8)
    work_dir(s)  # sets a checkpoint folder only when the session has none
    yield s
