import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("LEXSPARK_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from lexspark.session import local_session

    s = local_session("*", 8)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"
