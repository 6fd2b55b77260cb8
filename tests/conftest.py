import pytest

from attestor.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("attestor-tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
