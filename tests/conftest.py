import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, HOME)
os.environ["PYTHONPATH"] = os.pathsep.join([HOME, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trackloom.session import local_session

    session = local_session(cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    return DATA
