import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session  # noqa: E402

DATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, app="tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
