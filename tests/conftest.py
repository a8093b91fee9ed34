import pytest

from strandframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, shuffle_partitions=4, driver_memory="4g")
    yield session
    session.stop()
