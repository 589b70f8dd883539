import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark
    scratch = tempfile.mkdtemp(prefix="quarry-test-")
    s = get_spark("local[4]", app="quarry-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="quarry-t-")
