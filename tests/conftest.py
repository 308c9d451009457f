import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from catalogflow.session import build_session
    s = build_session("local[2]", 4, app_name="catalogflow-tests")
    # tests are the place where a private checkpoint folder is set
    if s.sparkContext.getCheckpointDir() is None:
        d = tempfile.mkdtemp(prefix="cf-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="cf-test-")
