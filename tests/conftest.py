import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from raggedly.session import clear_folders, local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "4", "4g", str(tmp_path_factory.mktemp("shared")))
    yield session
    clear_folders(session)
    session.stop()
