import os
import tempfile

import pytest
from pyspark.sql import SparkSession

from flowtrail.session import prepare


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[4]"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="flowtrail-tests-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()
