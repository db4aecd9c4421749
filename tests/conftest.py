import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from foliomark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Only tests set a folder of their own, where none is given; a cluster names a shared one.
    session = local_session("tests", 8, str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()
