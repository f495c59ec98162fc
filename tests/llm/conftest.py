import pytest


@pytest.fixture(scope="session")
def empty(spark):
    """Tables of the right columns without a row."""

    def make(schema):
        return spark.createDataFrame([], schema)

    return make
