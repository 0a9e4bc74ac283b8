import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import local_session

    s = local_session(app="tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
