import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import session

    s = session("local[4]", partitions=4)
    yield s
    s.stop()


def pytest_collection_modifyitems(items):
    items.sort(key=lambda i: "llm" in str(i.fspath))
