import pytest

from tests.oracle import duck, make_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = make_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SF)
