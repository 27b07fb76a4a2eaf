import pytest

from mealgrid.session import local_session, tune


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "mealgrid-tests", **{"spark.sql.shuffle.partitions": "4"})
    tune(session)
    yield session
    session.stop()
