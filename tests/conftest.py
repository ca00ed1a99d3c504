import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from worktrail.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g")
