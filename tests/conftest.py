import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from splicelake.session import local_session, ship

    session = local_session(4, 4, "4g")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """Folder of the smallest driver tables; tests that need it are skipped without."""
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("driver tables are absent")
    return str(folder)
