import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from cohortspark.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="cohortspark-tests")
    yield s
    s.stop()
