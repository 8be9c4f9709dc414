import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from cohortlake.session import session

    made = session("tests", spark__master="local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__driver__memory="2g", spark__ui__showConsoleProgress="false")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
