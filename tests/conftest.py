import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from headway.session import session

    s = session("local[8]", "tests", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="6g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")), spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
