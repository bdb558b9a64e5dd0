import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from replyscope.session import local_session

    s = local_session(cores=4, shuffle_partitions=4)
    yield s
    s.stop()


def one(df, col):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0][col]
