import pytest

from corrobora.session import session


@pytest.fixture(scope="session")
def spark():
    found = session("local[4]", 4, "4g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
