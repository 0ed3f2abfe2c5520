import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paysift.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8,
                    driver_memory="8g",
                    checkpoint_dir=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()
