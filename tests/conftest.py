import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from wardlake.session import local_session

    s = local_session("4", "wardlake-tests")
    yield s
    s.stop()
