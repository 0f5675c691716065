import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def session(spark):
    from stayline.llm.common import prepared

    return prepared(spark)


@pytest.fixture(scope="session")
def documents(session):
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return session.read.parquet(f"{SMALL}/documents.parquet")
