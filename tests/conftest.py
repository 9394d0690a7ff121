import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

REPO = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    found = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
