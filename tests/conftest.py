import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evidmill.session import session

    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")), spark__ui__showConsoleProgress="false"
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
