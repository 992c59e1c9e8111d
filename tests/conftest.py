import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from creditframe.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s


def rows(df, *cols):
    """Collect as sorted tuples (order-insensitive comparisons)."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
