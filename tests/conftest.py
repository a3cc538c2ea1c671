import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session
    s = local_session(shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def _no_tables_cached_for_other_modules(spark):
    """Tables that a module's fixtures cached go with the module."""
    yield
    spark.catalog.clearCache()
