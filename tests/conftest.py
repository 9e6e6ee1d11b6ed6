import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from attestry.session import local_session

    session = local_session(4, app="tests", memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
