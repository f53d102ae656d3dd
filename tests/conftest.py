import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from henhouse.session import get_session

    s = get_session("local[*]", 8)
    # tests set their own checkpoint folder (the cluster names one otherwise)
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="henhouse-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def tables_small(spark):
    from henhouse.sources.tables import Tables

    return Tables.from_testdata(spark, SF_SMALL)


@pytest.fixture(scope="session")
def tables_mid(spark):
    from henhouse.sources.tables import Tables

    return Tables.from_testdata(spark, SF_MID)
