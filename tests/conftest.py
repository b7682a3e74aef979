import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["TZ"] = "UTC"
    folder = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").appName("graphweave-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(folder / "shared")).config("spark.sql.warehouse.dir", str(folder / "wh"))
        .config("spark.local.dir", str(folder / "local")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
