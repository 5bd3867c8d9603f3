import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.local.dir": local, "spark.driver.memory": "6g"}
    session = SparkSession.builder.master("local[8]").config(map=conf | {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
