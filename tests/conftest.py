import pytest

from rectifold.session import build


@pytest.fixture(scope="session")
def spark():
    s = build(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
