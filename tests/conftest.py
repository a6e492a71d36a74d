import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession


# Python workers find the package wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parent.parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
