import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from portcullis.session import builder
    session = builder("portcullis-tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column function over a list of values in one job."""
    from pyspark.sql import functions as F

    def run(given, kind, fn):
        df = spark.createDataFrame(list(enumerate(given)), f"i int, v {kind}")
        return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]
    return run
