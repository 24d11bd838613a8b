import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cinderframe.functions.grid import Grid  # noqa: E402
from cinderframe.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def small_grid():
    return Grid(0.0, 21.0, 3.0, 7, 7)


@pytest.fixture
def mask_of(spark):
    def make(cells):
        return spark.createDataFrame(sorted(cells), "r int, c int")

    return make


@pytest.fixture
def cells_of():
    def take(df):
        return {(row["r"], row["c"]) for row in df.select("r", "c").collect()}

    return take
