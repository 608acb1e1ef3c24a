import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = os.environ.get("COMMITLENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from commitlens.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="commitlens-tests", driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


def one_col(spark, values, name="x", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
