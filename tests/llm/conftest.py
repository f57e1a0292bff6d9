import pytest


@pytest.fixture
def as_list():
    """Rows as sorted tuples."""
    return lambda df: sorted(map(tuple, df.collect()), key=str)
