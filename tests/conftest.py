import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TIDEMARK_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    s = build_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
