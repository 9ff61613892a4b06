import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cohort_gaps.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4",
                                    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                    "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def values(spark):
    """Rows of one column in input order."""
    def of(df, column, order="i"):
        return [r[column] for r in df.orderBy(order).collect()]
    return of
