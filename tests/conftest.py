import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from loadlens.session import get_session
    s = get_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def held_tables_are_given_back(request):
    """Sections hold their grouped pass until it is released; no test leaves one to the next."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]
