import pytest

from tallymark.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus=8, shuffle_partitions=4, memory="6g")
    yield s
    s.stop()
