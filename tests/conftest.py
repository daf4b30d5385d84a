import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    yield session()


@pytest.fixture(scope="session")
def con():
    from oracle import duck

    return duck("/root/testdata/sf0.001")


sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
