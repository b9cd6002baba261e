"""One local session for all tests."""

import pytest

from isobar.session import get_session


@pytest.fixture(scope="session")
def spark():
    """A small local session in UTC."""
    s = get_session("tests", 4, 4, spark__driver__memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
