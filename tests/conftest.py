import pytest

from kestrel.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(s)
    return s
