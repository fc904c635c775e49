import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from veridix.session import local_session

    s = local_session(int(os.environ.get("TEST_CPUS", "4")), 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
