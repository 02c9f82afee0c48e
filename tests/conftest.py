import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from framewise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("FRAMEWISE_DATA", "/root/testdata") + "/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables not present")
    return path
