import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from regloom.session import build_session, prepare

    session = prepare(build_session("local[4]", 4))
    yield session
    session.stop()
