import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[8]", shuffle_partitions=8, extra={
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression built from literal inputs: one(fn, *values)."""
    def run(fn, *values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([tuple(values)], [f"v{i}" for i in range(len(values))]) if values else spark.range(1)
        return df.select(fn(*[F.col(f"v{i}") for i in range(len(values))]).alias("r")).first()["r"]
    return run
