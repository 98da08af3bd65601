import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rubric.session import clear_scratch, get_session
    s = get_session("local[*]", app="rubric-tests", shuffle_partitions=8)
    yield s
    clear_scratch(s)
    s.stop()
