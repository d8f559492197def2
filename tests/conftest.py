import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from basketry.session import ensure_checkpoint_dir, local_session
    s = local_session(cores="4", shuffle_partitions=8, app="basketry-tests")
    ensure_checkpoint_dir(s)   # the configured spark.checkpoint.dir, or a scratch one if unset
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    from basketry.plans.tables import Tables
    return Tables.from_fixtures(spark, SF_SMALL)
