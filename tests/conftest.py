import pytest

from pairlens.session import session, ship_path

ship_path()


@pytest.fixture(scope="session")
def spark():
    s = session(cores=8, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
