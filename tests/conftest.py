import pytest

from quillspar.session import build


@pytest.fixture(scope="session")
def spark():
    session = build("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
