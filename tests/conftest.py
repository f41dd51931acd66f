import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from plumbline.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
