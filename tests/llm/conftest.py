import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from cases import EDGE, make_docs  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return make_docs(spark, EDGE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return make_docs(spark, [])
