import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trailcast.session import local_session

    return local_session("4", 4)


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
