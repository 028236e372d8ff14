import pytest

from rillmark.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s
