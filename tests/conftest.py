import pytest

from patchlens import session


@pytest.fixture(scope="session")
def spark():
    s = session.local(4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
