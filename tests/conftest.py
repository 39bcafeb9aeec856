import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from logweave import get_session

    s = get_session("local[4]", **{"spark.sql.shuffle.partitions": "8"})
    if s.sparkContext.getCheckpointDir() is None:  # tests set their own shared folder
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="logweave-test-")
