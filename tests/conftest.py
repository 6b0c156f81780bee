import pytest

from quern.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = get_session("tests", cpus=4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
