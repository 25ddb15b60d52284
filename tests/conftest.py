import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from frostline.session import local_session, ship_package

    session = local_session(4, "tests")
    ship_package(session)
    return session
