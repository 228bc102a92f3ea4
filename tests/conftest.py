"""One Spark session for all tests, with a shared folder of its own."""

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from freshet.session import session

    shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    settings = {"spark__master": "local[8]", "spark__driver__memory": "6g", "spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__checkpoint__dir": shared}
    s = session("tests", **settings)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture
def many_ranges(spark):
    """Small tables in as many ranges as there are shuffle partitions, not in one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
