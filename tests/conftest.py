import pytest

from tidemark.session import local_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def table(spark):
    from workloads.derived import table as load
    return lambda name: load(spark, SF_DIR, name)
