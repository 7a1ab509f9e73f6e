import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from airtoll.session import local_session  # noqa: E402
from airtoll.sources.staging import remove_staged  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_staged(session)
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted by the given columns."""
    data = [tuple(r) for r in df.collect()]
    at = [df.columns.index(c) for c in order]
    return sorted(data, key=lambda r: [(r[i] is None, r[i]) for i in at])
