import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohortlab.session import local_session
    s = local_session(cores=4, shuffle_partitions=8, app="cohortlab-tests")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
