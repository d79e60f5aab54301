import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from feedlake.session import build_session
    s = build_session("local[*]", 8, app_name="feedlake-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a list of tuples (small test frames only)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
