import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelweave.session import drop_stages, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "panelweave-tests")
    yield session
    drop_stages(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
