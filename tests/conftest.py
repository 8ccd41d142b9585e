import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pagelake.session import local_session  # noqa: E402
from pagelake.streaming.metrics import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", spark__sql__streaming__stateStore__providerClass=STATE_STORE)
    yield session
    session.stop()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
