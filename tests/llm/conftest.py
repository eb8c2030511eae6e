from turnlake.llm.common import prepare
import pytest


@pytest.fixture(autouse=True, scope="session")
def prepared(spark):
    prepare(spark)
