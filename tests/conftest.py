import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracewake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
