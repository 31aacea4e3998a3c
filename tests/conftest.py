import pytest

from plazalens.session import local_session, prepare


@pytest.fixture(scope="session")
def spark():
    return prepare(local_session("*", shuffle_partitions=4, memory="6g"))
