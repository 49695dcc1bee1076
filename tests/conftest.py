import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = make_session(4)
    session.sparkContext.setLogLevel("ERROR")
    return session
