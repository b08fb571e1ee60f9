import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.session import get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("local[4]", app="faultline-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s


@pytest.fixture(scope="session")
def sf001():
    return SF001
