import pytest

from tests.llm import cases


@pytest.fixture(scope="session")
def rows():
    return cases.documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return cases.frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return cases.frame(spark, [])
