import pytest

from millrace.llm.common import ship


@pytest.fixture(scope="session")
def sp(spark):
    ship(spark)
    return spark
