import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lumora.session import local_session

    return local_session(4, "tests", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def small():
    return os.environ.get("LUMORA_TEST_DATA", "/root/testdata/sf0.001")
