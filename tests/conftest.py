import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagewright.session import local_session

    s = local_session("tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "2")  # small inputs: the jobs' own cost is what counts
    s.conf.set("spark.sql.adaptive.enabled", "false")
    return s
