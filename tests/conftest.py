import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = "file://" + str(tmp_path_factory.mktemp("shared"))
    session = build_session("local[8]", 8, spark__driver__memory="8g", spark__checkpoint__dir=folder)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if not order else [tuple(r) for r in df.orderBy(*order).collect()]
