"""One small session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quarrycast.runtime import local_session

    return local_session("tests", 4, "4g")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


def rows(df, *columns):
    """The rows of df as a sorted list of tuples."""
    got = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in got), key=lambda r: tuple((x is None, str(x)) for x in r))
