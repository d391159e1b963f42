import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stylematch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def value(spark):
    """Evaluate one column on a one-row table."""
    from pyspark.sql import functions as F

    def evaluate(make, *args):
        df = spark.range(1).select(*[F.lit(a).alias(f"a{i}") for i, a in enumerate(args)])
        return df.select(make(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]

    return evaluate
