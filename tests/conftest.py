import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from commitlens.session import get_session

    s = get_session("local[*]", 8)
    # tests run without a cluster checkpoint folder: set our own (unset before)
    if not s.sparkContext.getConf().get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="commitlens-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()
