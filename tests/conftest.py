import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("CORPUSMILL_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from corpusmill.runtime import local_session, shared_dir, ship

    session = local_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    shared_dir(session)
    return session


@pytest.fixture(scope="session")
def rows():
    """A frame's rows as a sorted list of tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
