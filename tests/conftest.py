import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from decantry.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", app="decantry-tests", shuffle_partitions=4,
                      extra={"spark.driver.memory": "4g",
                             "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="decantry-test-ckpt-", dir="/tmp"))
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="decantry-test-", dir="/tmp")
