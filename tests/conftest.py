import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from slatekit.session import local_session
    s = local_session(4, 4, "slatekit-tests")
    yield s
    s.stop()


@pytest.fixture()
def small_split(spark):
    """Force the hot-group path of the ordered scan / history halo split."""
    spark.conf.set("spark.slatekit.splitRows", "7")
    yield 7
    spark.conf.unset("spark.slatekit.splitRows")
