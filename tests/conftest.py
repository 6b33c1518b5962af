import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import checkpoint_dir, get_spark
    s = get_spark("local[8]", 8)
    checkpoint_dir(s)  # sets a scratch folder only because none is configured here
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
