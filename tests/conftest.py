import pytest

from evidence.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "evidence-tests")


@pytest.fixture()
def rows(spark):
    """Collect a frame as a sorted list of tuples."""

    def collect(df, *columns):
        return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())

    return collect
