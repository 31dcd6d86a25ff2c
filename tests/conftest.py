import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tracewright.session import session

    made = session("local[8]", 8)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
