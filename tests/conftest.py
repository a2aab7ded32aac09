import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
os.environ.setdefault("GOSSAMER_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from gossamer.session import get_spark

    return get_spark("tests", shuffle=4)
