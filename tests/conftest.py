import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inkwell.session import local_session  # noqa: E402
from inkwell.shipping import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4"})
    ship(session)
    return session


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL
