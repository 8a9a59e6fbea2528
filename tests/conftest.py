import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.runtime import local_session

    session = local_session(4, "4g", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "2")  # the fixtures are small
    return session
