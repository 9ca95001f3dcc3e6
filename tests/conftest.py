import pytest

from rasterloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 4, **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
