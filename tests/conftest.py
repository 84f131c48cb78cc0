import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fedseek.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, 8, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()
